"""Each stage of the pipeline against brute force, with repeated ids, repeated rows and null ids."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from rushes.llm import quality_classifier
from rushes.llm.queries import tokenizer_file

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, n_chars int"


def make_rows():
    draw = random.Random(8)
    text = lambda n: " ".join(f"w{draw.randint(0, 400)}" for _ in range(n))
    a, b, c, d, e, passage = text(80), text(80), text(80), text(80), text(80), text(30)
    rows = [(5, a), (7, a + " more"), (7, b), (7, b), (9, c), (9, c), (9, c), (None, d), (None, d), (None, d + " more"), (3, d + " else"), (None, e), (None, e), (None, "more " + e)]
    rows += [(9, b.replace(" ", "  ", 1)), (4, a.upper()), (4, a)]
    rows += [(None, None), (None, None), (8, ""), (8, ""), (8, " \n"), (6, "one two"), (6, "One two"), (1, "one two three")]
    rows += [(20 + i % 9, f"{text(40)}\n A Common line\t\n{passage if i % 3 == 0 else ''} {text(4)}") for i in range(15)]
    return [(i, t, "en", None if t is None else len(t)) for i, t in rows]


ROWS = make_rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def counted(frame):
    return Counter(tuple(r) for r in frame.collect())


def test_quality_classifier(spark):
    path = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    docs = docs.union(docs.where("doc_id % 7 = 0")).union(docs.where("doc_id % 9 = 0").withColumn("doc_id", docs["doc_id"] * 0))
    model = quality_classifier.fit_quality(docs, spark.read.parquet(f"{path}/labels.parquet"))
    table = docs.toArrow()
    bounds, index, value = quality_classifier.features(table.column("text").combine_chunks())
    must, may = Counter(), Counter()
    for n, row in enumerate(table.to_pylist()):
        at = slice(bounds[n], bounds[n + 1])
        v = model.factors[index[at]] * value[at][:, None]
        raw = model.bias + float(model.linear[index[at]] @ value[at]) + float((v.sum(0) ** 2 - (v * v).sum(0)).sum()) / 2
        score = 1 / (1 + math.exp(-raw))
        must[tuple(row.values())] += score >= 0.31
        may[tuple(row.values())] += score >= 0.29
    got = counted(stage("quality classifier")(spark, docs, path))
    assert must <= got <= may and got.total()


def test_line_dedup(spark, docs):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    has = Counter(k for _, t, *_ in ROWS for k in {key(x) for x in (t or "").split("\n")} if k)
    want = Counter()
    for i, t, lang, _ in ROWS:
        kept = None if t is None else "\n".join(x for x in t.split("\n") if not key(x) or has[key(x)] < 10)
        want[i, kept, lang, None if kept is None else len(kept)] += 1
    got = counted(stage("line dedup")(spark, docs, ""))
    assert Counter({(i, t or None, g, n or None): c for (i, t, g, n), c in got.items() if t}) == Counter({(i, t, g, n): c for (i, t, g, n), c in want.items() if t})
    assert got.total() == want.total()


def test_batches_stay_small(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for rows, want in ((10_000, 1000), (0, 1000), (70, 70)):
            spark.conf.set(name, rows)
            stage("packing")(spark, spark.createDataFrame([(1, "a b")], "doc_id long, text string"), "")
            assert int(spark.conf.get(name)) == want
    finally:
        spark.conf.set(name, before)


@pytest.mark.parametrize("broadcast_rows", [100_000, -1])
def test_jaccard_join(spark, docs, monkeypatch, broadcast_rows):
    monkeypatch.setattr(corpus_pipeline, "BROADCAST_ROWS", broadcast_rows)
    sets = []
    for _, t, *_ in ROWS:
        words = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(words[j : j + 5]) for j in range(len(words) - 4)} or ({tuple(words)} if words else set()))
    label = list(range(len(ROWS)))
    for a in range(len(ROWS)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                label = [label[b] if x == label[a] else x for x in label]
    got = counted(stage("n-gram Jaccard join")(spark, docs, ""))
    assert got <= Counter(ROWS)
    for one in set(label):
        group = [ROWS[n] for n, x in enumerate(label) if x == one]
        if not sets[one]:
            continue
        left = [r for r in set(group) for _ in range(got[r])]
        # one row of each component, of the smallest id; other components have other texts
        assert len(left) == 1
        ids = [r[0] for r in group if r[0] is not None]
        assert left[0][0] == (min(ids) if ids else None)
    wordless = Counter(r for r, s in zip(ROWS, sets) if not s)
    assert {r: got[r] for r in wordless} == dict(wordless)


def test_substring_dedup(spark):
    # as the stage before leaves them: no row twice
    rows = sorted(set(ROWS), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    seen, want = set(), Counter()
    for i, t, lang, n in rows:
        words = WORD.findall(t or "")
        gone = [False] * len(words)
        for s in range(len(words) - 19):
            found = tuple(words[s : s + 20])
            if found in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(found)
        kept = " ".join(w for w, g in zip(words, gone) if not g) if any(gone) else t
        want[i, kept, lang, None if kept is None else len(kept)] += 1
    assert counted(stage("substring dedup")(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "")) == want


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(tokenizer_file("word_bpe_49k.json"))
    want, sequences = Counter(), defaultdict(list)
    for i, t, *_ in ROWS:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += Counter((i, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes()), len(ids)) for a in range(0, len(ids), 2048))
    rows = stage("packing")(spark, docs, "").collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 2048


ODD = ["_kept", "_score", "a.b", "x`y", "_row_key", "_sha", "own0", "_n_words", "component_id", "id", "unit"]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_clashing_names(spark, name):
    """Columns named like an operator's own keep their values with the row they came with."""
    path = "/root/testdata/sf0.001"
    plain = spark.createDataFrame(ROWS, SCHEMA)
    rows = [(*r, *[f"{n}-{i}" for n in ODD]) for i, r in enumerate(ROWS)]
    odd = spark.createDataFrame(rows, ", ".join([SCHEMA] + ["`" + n.replace("`", "``") + "` string" for n in ODD])).repartition(3)
    out = stage(name)(spark, odd, path)
    assert out.columns == odd.columns
    got = out.collect()
    if name != "n-gram Jaccard join":  # of equal rows any one stays
        assert Counter(tuple(r)[:4] for r in got) == counted(stage(name)(spark, plain.repartition(3), path))
    for r in got:
        i = int(r[4].rpartition("-")[2])
        assert tuple(r)[4:] == tuple(f"{n}-{i}" for n in ODD)
        assert r[0] == ROWS[i][0]

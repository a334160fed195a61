"""Each operator against brute force on a small table with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from rushes.llm import jaccard_join, katz, license_scan, quality_classifier, quality_rules, topk_search
from rushes.llm.bpe import code_texts
from rushes.llm.line_dedup import dedup_lines
from rushes.llm.packing import first_fit_decreasing, pack_documents
from rushes.llm.queries import tokenizer_file
from rushes.llm.substring_dedup import dedup_substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, n_words string, bucket int, lang string"


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def make_rows():
    draw = random.Random(3)
    vocabulary = ["the", "of", "Éa", "tion", "straße", "x'll", "42", "end.", "A,", "日本"] + [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    passage, line = text(30), "  A Common Line \t"
    texts = [None, "", " \n\t", "one", "one two", text(5000), "a" * 9000, "MIT License and apache\nLICENSE, mit license", "<|endoftext|> x <|endoftext|>", "é̂ ﬁ Ǆ     x\u0085y"]
    for i in range(60):
        body = text(draw.randint(20, 120))
        texts.append(body + (f"\n{line}\n" if i % 2 else "\n") + (passage if i % 3 == 0 else "") + text(5))
    copy = texts[-1]
    texts += [copy, copy, copy + " w1", copy.replace("w3", "w4", 1)]
    return [(i, t, "clash", 7, None) for i, t in enumerate(texts)]


ROWS = make_rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_packing(docs, empty, spark):
    from tokenizers import Tokenizer

    content = tokenizer_file("word_bpe_49k.json")
    tokenizer = Tokenizer.from_str(content)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in pack_documents(docs, content, room=256, group_rows=20).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, t, *_ in ROWS:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 256
    assert pack_documents(empty, content).collect() == []
    assert pack_documents(spark.createDataFrame([(None, "a b", "", 0, "")] * 3, SCHEMA), content).count() == 3


def test_first_fit_decreasing_matches_plain_first_fit():
    sizes = np.array([random.Random(5).randint(1, 100) for _ in range(300)])
    bins, _ = first_fit_decreasing(sizes, 100)
    rooms: list[int] = []
    for i in np.argsort(-sizes, kind="stable"):
        at = next((b for b, room in enumerate(rooms) if room >= sizes[i]), len(rooms))
        rooms += [100] * (at == len(rooms))
        rooms[at] -= sizes[i]
        assert bins[i] == at


def substring_truth(rows, k):
    seen, out = set(), {}
    for i, t in sorted(rows):
        words = WORD.findall(t or "")
        gone = [False] * len(words)
        for s in range(len(words) - k + 1):
            key = tuple(words[s : s + k])
            if key in seen:
                gone[s : s + k] = [True] * k
            seen.add(key)
        out[i] = (len(words), sum(gone), sha(" ".join(w for w, g in zip(words, gone) if not g)))
    return out


@pytest.mark.parametrize("block", [2000, 24 << 20])
def test_substring_dedup(docs, empty, block):
    got = {r.doc_id: (r._n_words, r._n_removed, r._sha) for r in dedup_substrings(docs, block_bytes=block).collect()}
    assert got == substring_truth([r[:2] for r in ROWS], 20)
    assert dedup_substrings(empty).collect() == []
    assert "lang" in dedup_substrings(docs).columns


def test_substring_dedup_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "", 0, "")] * 2 + [(2, text, "", 0, ""), (None, text, "", 0, "")]
    got = sorted((r.doc_id or -1, r._n_removed) for r in dedup_substrings(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(-1, 0), (1, 40), (1, 40), (2, 40)]


def test_bpe(docs, empty):
    from tokenizers import Tokenizer

    content = tokenizer_file("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_str(content)
    got = {r.doc_id: r for r in code_texts(docs, content, ids=True).collect()}
    for i, t, *_ in ROWS:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert got[i]._ids == ids
        assert got[i]._decoded == tokenizer.decode(ids, skip_special_tokens=False) == (t or "")
    assert code_texts(empty, content).collect() == []


def test_line_dedup(docs, empty, spark):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    has = Counter(k for _, t, *_ in ROWS for k in {key(x) for x in (t or "").split("\n")} if k)
    got = {r.doc_id: r for r in dedup_lines(docs).collect()}
    for i, t, *_ in ROWS:
        lines = (t or "").split("\n")
        keep = [not key(x) or has[key(x)] < 10 for x in lines]
        bits = np.unpackbits(np.frombuffer(zlib.decompress(got[i]._bitmap), np.uint8))[: len(lines)]
        assert bits.tolist() == [int(k) for k in keep]
        assert (got[i]._n_lines, got[i]._n_dropped, got[i]._sha) == (len(lines), len(lines) - sum(keep), sha("\n".join(x for x, k in zip(lines, keep) if k)))
    assert dedup_lines(empty).collect() == []
    many = dedup_lines(spark.createDataFrame([(None, "same", "", 0, "")] * 10, SCHEMA)).collect()
    assert [r._n_dropped for r in many] == [1] * 10


@pytest.mark.parametrize("rarity", [katz.RARITY, 90, 1])
def test_katz(docs, empty, rarity):
    rows = {r.doc_id: r for r in katz.score_katz(docs, rarity=rarity).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in ROWS}
    tokens = {i: WORD.findall((t or "").translate(LOWER)) + [None] for i, t, *_ in ROWS}
    count = Counter(w for i in tokens if not held[i] for w in tokens[i])
    total, types = sum(count.values()), len(count)
    pairs = Counter((h, w) for i in tokens if not held[i] for h, w in zip(["<s>", *tokens[i]], tokens[i]))
    times = np.array([0.0] + [sum(c == r for c in pairs.values()) for r in range(1, 7)])
    d = katz.discounts(times)
    share = lambda w: (count[w] + 1) / (total + types + 1)
    after = defaultdict(dict)
    for (h, w), c in pairs.items():
        after[h][w] = c
    starts = sum(not x for x in held.values())

    def probability(h, w):
        seen = after.get(h)
        if not seen:
            return share(w)
        mass = sum((d[c] if c <= 5 else 1) * c for c in seen.values())
        n = starts if h == "<s>" else count[h]
        n += mass >= n * (1 - 1e-12)
        if w in seen:
            return (d[seen[w]] if seen[w] <= 5 else 1) * seen[w] / n
        return (1 - mass / n) / (1 - sum(map(share, seen))) * share(w)

    for i, words in tokens.items():
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(words), sum(count[w] > 0 for w in words), total)
        assert r.base_score == pytest.approx(sum(math.log10(share(w)) for w in words))
        assert r.score == pytest.approx(sum(math.log10(probability(h, w)) for h, w in zip(["<s>", *words], words)))
    for h in list(after)[:20]:  # exactly normalised, with one unseen type
        assert sum(probability(h, w) for w in [*count, "unseen"]) == pytest.approx(1)
    assert katz.score_katz(empty).collect() == []


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_jaccard_join(docs, empty, n, percent):
    sets = {}
    for i, t, *_ in ROWS:
        words = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(words[j : j + n]) for j in range(len(words) - n + 1)} or ({tuple(words)} if words else set())
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                old, new = label[b], label[a]
                label = {k: min(old, new) if v in (old, new) else v for k, v in label.items()}
    got = {r.id: (r.n_shingles, r.component_id) for r in jaccard_join.link_components(docs, gram=n, percent=percent).collect()}
    assert got == {i: (len(s), label[i]) for i, s in sets.items()}
    assert jaccard_join.link_components(empty).collect() == []


def test_license_scan(docs, empty, spark):
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs).collect()}
    row = got[7]
    assert (row._n_words, row._n_base, row._first_word, row._last_word, row._base_labels, row._score) == (7, 3, 0, 5, "apache,mit", 1.0)
    assert (got[0]._n_words, got[0]._n_base, got[0]._first_word, got[0]._labels, got[0]._score) == (0, 0, None, "", 0.0)
    notice = "x Permision is hereby granted, free of charge to any persn obtaining\na copy y"
    found = license_scan.scan_licenses(spark.createDataFrame([(1, notice, "", 0, "")], SCHEMA)).first()
    assert found._labels == "mit-notice" and 0.9 < found._score < 1
    assert [(n.first_word, n.n_words, n.edits) for n in found._notices] == [(1, 13, 2)]
    assert license_scan.scan_licenses(empty).collect() == []


def test_quality_rules(docs, empty):
    got = {r.doc_id: r for r in quality_rules.apply_quality_rules(docs).collect()}
    for i, t, *_ in ROWS:
        t = t or ""
        words = WORD.findall(t)
        windows = Counter(tuple(words[j : j + 8]) for j in range(len(words) - 7))
        inside = {x for j in range(len(words) - 7) if windows[tuple(words[j : j + 8])] > 1 for x in range(j, j + 8)}
        seen, again = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                again += line in seen
                seen.add(line)
        failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
        r = got[i]
        assert (r._n_words, r._word_chars, r._n_symbols, r._n_dup_lines, r._n_repeat_words, r._base_failed) == (len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), again, len(inside), failed)
        assert not (failed and r._kept)
    assert quality_rules.apply_quality_rules(empty).collect() == []


def test_quality_classifier(spark, docs, empty):
    path = "/root/testdata/sf0.01"
    table, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    model = quality_classifier.fit_quality(table, labels)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [(r._score >= 0.3, truth[r.doc_id]) for r in quality_classifier.score_quality(table, model).collect() if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(p == bool(t) for p, t in held) / len(held) > 0.9
    bounds, index, value = quality_classifier.features(docs.select("text").toArrow().column(0))
    v = model.factors[index[bounds[9] : bounds[10]]] * value[bounds[9] : bounds[10]][:, None]
    pairs = sum(float(v[i] @ v[j]) for j in range(len(v)) for i in range(j))
    linear = float(model.linear[index[bounds[9] : bounds[10]]] @ value[bounds[9] : bounds[10]])
    assert model.raw(bounds, index, value)[0][9] == pytest.approx(model.bias + linear + pairs, rel=1e-3, abs=1e-3)
    scores = [r._score for r in quality_classifier.score_quality(docs, model).collect()]
    assert len(scores) == len(ROWS) and all(0 <= s <= 1 for s in scores)
    assert quality_classifier.score_quality(empty, model).collect() == []


def test_topk_search(spark):
    draw = np.random.default_rng(2)
    x = np.round(draw.normal(0, 0.4, (300, 16)), 3)
    x[100:200] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, None), (401, [None] * 16), (402, [float("nan")] * 16), (None, x[0].tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    q = np.floor(x * 256).astype(int)
    want = set()
    for i in range(0, 300, 50):
        score = q @ q[i]
        order = [j for j in np.lexsort((np.arange(300), -score)) if j != i][:5]
        want |= {(i, k + 1, int(j), int(score[j])) for k, j in enumerate(order)}
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in topk_search.search_top_k(table, row_block=64).collect()}
    assert got == want
    assert topk_search.search_top_k(table.where("false")).collect() == []


@pytest.mark.parametrize("size", [20_000.0, 3e7, 1e12, 1e30, 1e300])
def test_topk_search_large_components(spark, size):
    draw = np.random.default_rng(4)
    x = np.round(draw.normal(0, 0.4, (300, 16)), 3)
    x[::3] *= size  # a third of rows and queries; the rest as they are
    x[120:150] = x[120]  # ties
    x[1] = 0.0
    x[60] = np.where(np.arange(16) % 2, 1, -1) * 1.7e308 if size == 1e300 else x[60]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    q = [[int(Fraction(v) * 256 // 1) for v in row] for _, row in rows]
    want = set()
    for i in range(0, 300, 50):
        score = [sum(a * b for a, b in zip(q[i], other)) for other in q]
        order = sorted((j for j in range(300) if j != i), key=lambda j: (-score[j], j))[:5]
        want |= {(i, k + 1, j, score[j] if abs(score[j]) < 2**63 else None) for k, j in enumerate(order)}
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in topk_search.search_top_k(table, row_block=64).collect()}
    assert got == want


@pytest.mark.parametrize(("block", "pivots"), [(8, 3), (8, 10**6), (512, 8)])
def test_jaccard_join_crowds(spark, monkeypatch, block, pivots):
    """Chains, near copies of one text that don't link with each other, null and repeated ids, a common prefix."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "MEETING", block)
    monkeypatch.setattr(jaccard_join, "PIVOTS", pivots)
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", 0 if pivots == 3 else 10**5)
    draw = random.Random(6)
    word = lambda: f"w{draw.randint(0, 10**6)}"
    texts = []
    for size, copies, edits in ((120, 40, 1), (120, 40, 3), (300, 30, 6), (40, 20, 1)):
        body = [word() for _ in range(size)]
        texts.append(" ".join(body))
        for _ in range(copies):
            other = list(body)
            for _ in range(edits):
                other[draw.randrange(size)] = word()
            texts.append(" ".join(other))
    chain = [word() for _ in range(200)]
    for k in range(25):
        chain = chain[4:] + [word() for _ in range(4)]
        texts.append(" ".join(chain))
    texts += [texts[3], texts[3].upper(), texts[-1] + " more"]
    rows = [(None if k % 11 == 5 else 7 if k % 13 == 4 else k, t, "", 0, "") for k, t in enumerate(texts)]
    draw.shuffle(rows)
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (WORD.findall(t.translate(LOWER)) for _, t, *_ in rows)]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root = [root[b] if x == root[a] else x for x in root]
    least = {r: min((rows[i][0] for i, x in enumerate(root) if x == r and rows[i][0] is not None), default=None) for r in set(root)}
    want = Counter((rows[i][0], len(sets[i]), least[x]) for i, x in enumerate(root))
    got = Counter((r.id, r.n_shingles, r.component_id) for r in jaccard_join.link_components(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect())
    assert got == want


@pytest.mark.parametrize("percent", [80, 90])
def test_candidates_share_what_links_need(percent):
    """Sets that link are candidates; sets that share half of their grams are none."""
    draw = np.random.default_rng(4)
    for size in (3, 20, 41, 200, 900):
        whole = [np.sort(draw.choice(10**9, size, replace=False).astype(np.uint64))]
        for edits in sorted({1, size // 40, size // 12, size // 9, size // 5, size // 2}):
            other = np.unique(np.r_[draw.choice(whole[0], size - edits, replace=False), draw.choice(10**9, draw.integers(0, edits + 1)).astype(np.uint64)])
            whole.append(other if len(other) else whole[0])
        sizes = np.array([len(x) for x in whole])
        levels = jaccard_join.level(sizes, percent)
        heads = [x[: n - jaccard_join.overlap(n, percent) + int(k)] for x, n, k in zip(whole, sizes.tolist(), levels)]
        found = set(zip(*(x.tolist() for x in jaccard_join.near(sizes, levels, jaccard_join._common(heads), percent))))
        for a in range(len(whole)):
            for b in range(a + 1, len(whole)):
                both = len(np.intersect1d(whole[a], whole[b]))
                if 100 * both >= percent * (sizes[a] + sizes[b] - both):
                    assert (a, b) in found
    # half of the prefixes is shared: what lies behind can't make up for it
    sizes = np.array([400, 400])
    levels = jaccard_join.level(sizes, percent)
    length = 400 - jaccard_join.overlap(400, percent) + int(levels[0])
    assert not len(jaccard_join.near(sizes, levels, np.full((2, 2), length // 2), percent)[0])


def test_substring_tasks_stay_small():
    """A task's arrays don't grow with the batch that it gets, a bucket's stay below ten times its text."""
    import tracemalloc

    import pyarrow as pa
    import zstandard

    from rushes.llm import substring_dedup

    draw = random.Random(3)
    texts = [" ".join(f"w{draw.randint(0, 50_000)}" for _ in range(350)) for _ in range(2000)]
    text, ids = "\n".join(texts).encode(), np.arange(len(texts), dtype=np.int64)
    hot = type("Shared", (), {"value": np.zeros(0, np.uint64)})
    z = lambda x: zstandard.ZstdCompressor(level=3).compress(x if isinstance(x, bytes) else x.tobytes())
    bucket = pa.table({"bucket": [0], "ids": [z(np.diff(ids, prepend=0))], "tags": [z(np.zeros((len(ids), 2), np.int64))], "starts": [z(np.zeros(len(ids), np.int32))], "counts": pa.array([None], pa.binary()), "text": [z(text)]})
    batch = pa.record_batch({"id": ids, "tag1": ids * 0, "tag2": ids * 0, "text": texts})
    tracemalloc.start()
    try:
        assert substring_dedup.repeats(20)(bucket).num_rows == 0
        assert tracemalloc.get_traced_memory()[1] < 10 * len(text)
        tracemalloc.reset_peak()
        before = tracemalloc.get_traced_memory()[0]
        for _ in substring_dedup.stretches(20, 4, 64, 1 << 20, hot)(iter([batch])):
            pass
        assert tracemalloc.get_traced_memory()[1] - before < 6 * len(text)
    finally:
        tracemalloc.stop()


def test_substring_dedup_hot_minimisers(spark, monkeypatch):
    from rushes.llm import substring_dedup

    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 2000)
    draw = random.Random(9)
    word = lambda: f"w{draw.randint(0, 10**5)}"
    common = "in the middle of the common piece".split()
    rows = [(i, " ".join([word() for _ in range(15)] + common + [word() for _ in range(15)]), "", 0, "") for i in range(300)]
    rows += [(300 + i, rows[i][1], "", 0, "") for i in range(0, 60, 3)] + [(999, " ".join(common * 9), "", 0, "")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    hot = substring_dedup.hot_pieces(docs.select("text"), 20, 4, 3 * sum(len(r[1]) for r in rows))
    assert len(hot)
    got = {r.doc_id: (r._n_words, r._n_removed, r._sha) for r in dedup_substrings(docs).collect()}
    assert got == substring_truth([r[:2] for r in rows], 20)


def test_long_texts_are_encoded_in_blocks():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from rushes.llm._text import utf8
    from rushes.llm.packing import WordTokens, text_blocks

    content = tokenizer_file("word_bpe_49k.json")
    tokenizer, encode = Tokenizer.from_str(content), WordTokens(content, most_bytes=5000)
    texts = [t or "" for _, t, *_ in ROWS] + ["x" * 700 + " it's <|ENDOFTEXT|> <|endoftext|>, İΣ. A, " + "ß" * 300]
    data, offsets = utf8(pa.array(texts))
    got, held = [], []
    for a, b, part, bound, whole in text_blocks(data, offsets, size=200):
        ids, at = encode(part, bound, 1)
        if not whole:
            held += ids[:-1].tolist()
            continue
        got += [held + ids[x:y].tolist() for x, y in zip(at[:-1], at[1:])] if b == a + 1 else [ids[x:y].tolist() for x, y in zip(at[:-1], at[1:])]
        held = []
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids + [1] for t in texts]


def test_packing_groups_do_not_depend_on_batches():
    import pyarrow as pa

    from rushes.llm.packing import pieces

    content = tokenizer_file("word_bpe_49k.json")
    table = pa.table({"id": [r[0] for r in ROWS], "text": [r[1] for r in ROWS]})
    seen = [sorted(t for out in pieces(content, 7, 256, 1)(iter(table.to_batches(max_chunksize=n))) for t in zip(*out.to_pydict().values())) for n in (3, 1000)]
    assert seen[0] == seen[1]


def test_license_scan_against_brute_force(docs):
    draw = random.Random(12)
    words = ["mit", "MIT", "license", "License,", "apache", "general", "public", "x", "é", "licenseé", "rights", "all", "reserved"]
    texts = [" ".join(draw.choice(words) + draw.choice(["", ".", "\n", "-"]) for _ in range(draw.randint(0, 60))) for _ in range(200)] + [None, ""]
    rows = [(i, t, "", 0, "") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs.sparkSession.createDataFrame(rows, SCHEMA)).collect()}
    for i, t, *_ in rows:
        found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        places = [(w, label) for phrase, label in license_scan.PHRASES.items() for w in range(len(found)) if found[w : w + len(phrase.split())] == phrase.split()]
        at = [w for w, _ in places]
        labels = ",".join(sorted({label for _, label in places}))
        assert (got[i]._n_words, got[i]._n_base, got[i]._first_word, got[i]._last_word, got[i]._base_labels) == (len(found), len(places), min(at, default=None), max(at, default=None), labels)
        assert set(filter(None, labels.split(","))) <= set(filter(None, got[i]._labels.split(",")))


def test_columns_of_any_name_clash_with_nothing(spark):
    names = ["doc_id", "text", "_whole", "_id", "_tag", "id", "unit", "own0", "_own_id", "n_words", "a`b", "range"]
    table = spark.createDataFrame([tuple([1, "one two three"] + [f"v{i}" for i in range(len(names) - 2)])], ", ".join(f"`{n.replace('`', '``')}` {'long' if n == 'doc_id' else 'string'}" for n in names))
    content = tokenizer_file("byte_bpe_50k.json")
    for made in (dedup_substrings(table), dedup_lines(table.drop("a`b")), code_texts(table, content), license_scan.scan_licenses(table), quality_rules.apply_quality_rules(table)):
        row = made.first()
        assert all(row[n] == f"v{i}" for i, n in enumerate(names[2:]) if n in made.columns)
        assert {"_whole", "_id", "own0", "range"} <= set(made.columns)


@pytest.mark.parametrize("apply", [
    lambda t, c: code_texts(t, c), lambda t, c: license_scan.scan_licenses(t), lambda t, c: quality_rules.apply_quality_rules(t), lambda t, c: katz.score_katz(t), lambda t, c: jaccard_join.link_components(t)
])
def test_null_and_repeated_ids(spark, apply):
    rows = [(None, "a b c", "", 0, ""), (None, None, "", 0, ""), (4, "a b c", "", 0, ""), (4, "other words here", "", 0, ""), (4, "a b c", "", 0, "")]
    assert apply(spark.createDataFrame(rows, SCHEMA), tokenizer_file("byte_bpe_50k.json")).count() == len(rows)


def same_crc(a: str, b: str) -> str:
    """b with eight letters behind that give it the crc32 of a."""
    want = zlib.crc32(a.encode())
    # crc32 is affine in the bits of the letters: solve for the bits of 16 letters out of a and c
    n = 48
    start = (b + " " + "a" * n).encode()
    base = zlib.crc32(start)
    rows = []
    for i in range(n):
        flipped = bytearray(start)
        flipped[len(start) - n + i] ^= 2
        rows.append((zlib.crc32(bytes(flipped)) ^ base, 1 << i))
    left, mask, pivots = want ^ base, 0, {}
    for value, which in rows:
        for bit in sorted(pivots, reverse=True):
            if value >> bit & 1:
                value, which = value ^ pivots[bit][0], which ^ pivots[bit][1]
        if value:
            pivots[value.bit_length() - 1] = value, which
    for bit in sorted(pivots, reverse=True):
        if left >> bit & 1:
            left, mask = left ^ pivots[bit][0], mask ^ pivots[bit][1]
    out = bytearray(start)
    for i in range(n):
        if mask >> i & 1:
            out[len(start) - n + i] ^= 2
    assert not left and zlib.crc32(bytes(out)) == want
    return out.decode()


@pytest.mark.parametrize("ident", [None, 7])
def test_substrings_of_rows_that_share_id_and_crc(spark, ident):
    """What one of two rows with one id loses is not taken from the other."""
    draw = random.Random(2)
    text = lambda n: " ".join(f"v{draw.randint(0, 10**6)}" for _ in range(n))
    passage = text(25)
    a = f"{passage} {text(6)} {passage}"
    b = same_crc(a, text(len(a.split())))
    rows = {r._kept: r._n_removed for r in dedup_substrings(spark.createDataFrame([(ident, a), (ident, b)], "doc_id long, text string")).collect()}
    assert rows[b] == 0 and sorted(rows.values()) == [0, 25]


def test_lines_of_one_text_without_ids(spark):
    """Many rows without id, of one length, are documents of their own, over several units."""
    rows = [(None, f"common\nown {i:06d}", "x", 1, "en") for i in range(20000)]
    out = dedup_lines(spark.createDataFrame(rows, SCHEMA).repartition(4), digests=False)
    assert {(r._n_dropped, len(r._kept)) for r in out.select("_n_dropped", "_kept").distinct().collect()} == {(1, 10)}


def test_packing_refuses_other_tokenizers(empty):
    from tokenizers import Tokenizer, models, pre_tokenizers

    plain = Tokenizer(models.WordLevel({"[UNK]": 0, "us": 1, "Us": 2, ".": 3}, unk_token="[UNK]"))
    plain.pre_tokenizer = pre_tokenizers.Whitespace()
    with pytest.raises(ValueError):
        pack_documents(empty, plain.to_str())


def test_notices_beside_each_other(spark):
    """A worse match before the best one is a span of its own."""
    text = "all rights reservd all rights reserved and all rigts reserved"
    (row,) = license_scan.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    spans = sorted(str(x) for x in row._notices)
    assert len(spans) == 3, spans

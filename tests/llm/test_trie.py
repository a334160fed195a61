"""The prefix trie of conversations against brute force and SQL."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from rushes.llm import conversation_trie as trie_module
from rushes.llm.conversation_trie import conversation_trie
from rushes.llm.queries import ORACLES, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, pos int, `a.b` int, owner int, `x``y` int"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """rows without two turns of the same number in a conversation, but for equal ones."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(x, key=lambda t: t[:2])] for c, x in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        paths[c] = tuple(own.get(base, [])[:h]) + tuple(turns[h:])
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    out = []
    for node in members:
        below = [v for v in members if v[: len(node)] == node]
        leaf = lambda v: not any(len(w) == len(v) + 1 and w[:-1] == v for w in members)
        kids = [v for v in below if len(v) == len(node) + 1]
        saved = sum((len(members[v]) - 1) * len(v[-1][1].encode()) for v in below if v)
        ends = ",".join(str(c) for c in sorted(members[node]) if len(paths[c]) == len(node))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(kids), sum(map(leaf, below)), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def made(seed, n_convs, longest):
    draw = random.Random(seed)
    shared = [("user", f"shared {i} é") for i in range(longest)]
    rows = []
    for c in draw.sample(range(-20, 4 * n_convs), n_convs):
        n = draw.randint(1, longest)
        turns = shared[:n] if draw.random() < 0.5 else [draw.choice([("user", "a"), ("assistant", "b"), (None, None), ("", "")]) for _ in range(n)]
        if draw.random() < 0.3:
            turns = shared[: n // 2] + turns[n // 2 :]
        rows += [(c, i if i or draw.random() < 0.5 else None, *t) for i, t in enumerate(turns)]
    return rows


def result(spark, rows, parts=3):
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA).repartition(parts)
    out = conversation_trie(docs)
    assert out.columns == NAMES
    return sorted(map(tuple, out.collect()), key=str)


@pytest.mark.parametrize("seed, stretch", [(1, 4096), (2, 8)])
def test_trie(spark, monkeypatch, seed, stretch):
    """Copies, common beginnings that end in and between blocks, null ids, roles and texts; scans over several stretches."""
    monkeypatch.setattr(trie_module, "STRETCH", stretch)
    monkeypatch.setattr(trie_module, "CHUNK_IDS", 3)
    monkeypatch.setattr(trie_module, "SHARE", 4 if seed == 1 else 1024)
    rows = made(seed, 60, 23) + [(None, 1, "user", "no id"), (None, None, None, None)]
    # a turn that occurs several times
    rows += [(10**12, 5, "user", "again")] * 7 + [(10**12 + 1, 5, "user", "again")] * 9
    assert result(spark, rows) == brute(rows)


def test_one_conversation_over_all_tasks(spark):
    rows = [(5, i, "user", str(i % 7)) for i in range(9000)] + [(6, i, "user", str(i % 7)) for i in range(20)]
    got = result(spark, rows)
    assert len(got) == 9001
    root = next(r for r in got if r[1] == 0)
    assert root[:6] == (5, 0, None, 2, 1, 1)
    deepest = max(got, key=lambda r: r[1])
    assert deepest[1] == 9000 and deepest[7] == hashlib.sha256(b"5").hexdigest()


def test_small_tables(spark):
    assert result(spark, []) == []
    assert result(spark, [(None, 0, "a", "b")]) == []
    # turns fewer than the head, donor absent: only the root is left
    c = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    rows = [(c, 0, "user", "x")]
    assert result(spark, rows) == brute(rows) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_against_sql(spark):
    got = sorted(map(tuple, QUERIES["op13_conversation_trie"](spark, "/root/testdata/sf0.01").select(*NAMES).collect()), key=str)
    con = duckdb.connect()
    con.sql("create view conversations as select * from '/root/testdata/sf0.01/conversations.parquet'")
    assert got == sorted(con.sql(f"select {', '.join(NAMES)} from ({ORACLES['op13_conversation_trie']})").fetchall(), key=str)

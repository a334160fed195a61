"""The search at a size where each query must not cost a call for each block, and where bounds leave few rows."""

import time

import numpy as np
import pytest

from rushes.llm import topk_search


def table_of(spark, folder, vectors):
    import pyarrow as pa
    import pyarrow.parquet as pq

    rows = pa.array(list(vectors.astype(np.float32)), pa.list_(pa.float32()))
    pq.write_table(pa.table({"vec_id": np.arange(len(vectors)), "embedding": rows}), folder / "embeddings.parquet", row_group_size=5000)
    return spark.read.parquet(str(folder / "embeddings.parquet"))


def plain(vectors, every, k=5):
    x = np.floor(vectors.astype(np.float32).astype(float) * 256)
    out = {}
    for q in range(0, len(x), every):
        score = x @ x[q]
        score[q] = -np.inf
        best = np.lexsort((np.arange(len(x)), -score))[:k]
        out |= {(q, rank + 1): (int(i), int(score[i])) for rank, i in enumerate(best.tolist())}
    return out


def found(out):
    return {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in out.collect()}


def test_many_queries(spark, tmp_path):
    """200 million pairs of vectors without any structure: some minutes if a query is looked at block by block."""
    draw = np.random.default_rng(3).normal(size=(40_000, 64))
    vectors = draw / np.linalg.norm(draw, axis=1, keepdims=True)
    table = table_of(spark, tmp_path, vectors)
    began = time.time()
    got = found(topk_search.search_top_k(table, query_every=8))
    assert time.time() - began < 40
    assert len(got) == 5000 * 5
    want = plain(vectors, 400)
    assert {key: got[key] for key in want} == want


@pytest.mark.parametrize("every", [3, 100])
def test_bounds_that_leave_few(spark, tmp_path, every):
    """Clusters far apart by their segments' means, copies among them: groups of rows and rows are left out, results stay."""
    r = np.random.default_rng(5)
    centres = np.repeat(r.normal(size=(40, 16)) * 3, 4, axis=1)
    vectors = centres[r.integers(0, 40, 9000)] + r.normal(size=(9000, 64)) * 0.05
    vectors[r.integers(0, 9000, 300)] = vectors[7]
    got = found(topk_search.search_top_k(table_of(spark, tmp_path, vectors), query_every=every))
    assert got == plain(vectors, every)


def test_rows_left_out(monkeypatch):
    """On such clusters most products are not computed, group by group and row by row."""
    r = np.random.default_rng(6)
    centres = np.repeat(r.normal(size=(40, 16)) * 3, 4, axis=1)
    x = np.floor((centres[r.integers(0, 40, 4096)] + r.normal(size=(4096, 64)) * 0.05) * 256).astype(np.int64)
    rows, queries = topk_search.Rows(x, np.arange(4096)), topk_search.Queries(x[:64], np.arange(64), 5)
    topk_search.meet(queries, rows)
    entered = []
    monkeypatch.setattr(topk_search.Queries, "add", lambda self, at, found, score: entered.append(len(at)))
    topk_search.meet(queries, rows)
    assert sum(entered) < 64 * 4096 / 100
    score = (x[:64] @ x.T).astype(float)
    score[np.arange(64), np.arange(64)] = -np.inf
    assert queries.score.reshape(64, 5).tolist() == np.sort(score, axis=1)[:, :-6:-1].tolist()

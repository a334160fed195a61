"""Frames whose directions are equally rough, against the SQL of the queries: the last bit decides."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from rushes.plans.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def tied(tmp_path_factory):
    """400 frames of few levels, where ties are frequent."""
    draw, folder = random.Random(4), tmp_path_factory.mktemp("tied")
    levels = [draw.randrange(65535) for _ in range(9)]
    frames = [[(draw.choice(levels) + 0.5) / 65535 - 0.6 for _ in range(64)] for _ in range(400)]
    pq.write_table(pa.table({"vec_id": pa.array(range(400), pa.int64()), "embedding": pa.array(frames, pa.list_(pa.float32()))}), folder / "embeddings.parquet")
    return str(folder)


def both(spark, folder, name):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{folder}/embeddings.parquet'")
    want = con.sql(ORACLES[name]).df()
    columns = sorted(want.columns)
    rows = lambda frame: list(frame[columns].sort_values([c for c in ("frame", "y", "x") if c in columns]).itertuples(index=False, name=None))
    return rows(QUERIES[name](spark, folder).toPandas()), rows(want)


def test_chroma_at_chroma(spark, tied):
    got, want = both(spark, tied, "d5_chroma_at_chroma")
    assert got == want and len(got) == 400 * 32


def test_development(spark, tied):
    """The development's SQL has sums of another order."""
    got, want = both(spark, tied, "d16_develop")
    assert len(got) == 400
    assert all(a == pytest.approx(b, abs=1e-9) for a, b in zip(got, want))


@pytest.mark.parametrize("name", ["d4_debayer_green", "d6_chroma_at_green", "d7_debayer"])
def test_colours(spark, tied, name):
    got, want = both(spark, tied, name)
    assert got == want and len(got) == 400 * (64 if name == "d7_debayer" else 32)

"""The growing catalogue with many folders, long clip numbers, and its keyed twin."""

import time

import duckdb
from pyspark.sql import functions as F

from rushes.plans.registry import ORACLES, QUERIES
from rushes.streaming import catalogue

COLUMNS = ["folder", "first_path", "last_path", "first_frame", "last_frame", "n_frames", "n_missing", "gaps"]


def test_many_folders(spark, tmp_path):
    """80,000 folders in two batches of files in any order: more than a minute if each is a call of its own."""
    paths = spark.range(240_000).selectExpr("concat('/a/C', id % 80000, '/x_', lpad(id div 80000 * (1 + id % 3) + 1, 4, '0'), '.dng') as path")
    for k in range(2):
        paths.where(F.pmod(F.xxhash64("path"), F.lit(2)) == k).repartition(1).write.parquet(str(tmp_path / "in" / f"part={k}"))
    stream = spark.readStream.schema("path string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    began = time.time()
    query = catalogue.stream_catalogue(stream, str(tmp_path / "table"), str(tmp_path / "check"))
    assert query.awaitTermination(300)
    assert time.time() - began < 40
    got, want = catalogue.current_catalogue(spark, str(tmp_path / "table")).select(COLUMNS), catalogue.clip_runs(paths).select(COLUMNS)
    assert got.count() == want.count() == 80_000
    assert got.exceptAll(want).count() == 0


def test_clips_of_more_than_six_digits(spark, tmp_path):
    """Names have six digits; clips whose first six agree stay apart."""
    keys = [7, 150_000, 1_500_000, 1_500_005, 1_500_020, 150_000_040]
    rows = [(k, n) for k in keys for n in ((1, 2, 5, 5) if k % 2 == 0 else (3, 4))]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int").coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{folder}/lineitem.parquet/*.parquet'")
    got = QUERIES["f9_stream_catalogue"](spark, folder).select(COLUMNS).toPandas()
    want = con.sql(ORACLES["f9_stream_catalogue"]).df()[COLUMNS]
    rows_of = lambda frame: sorted(frame.itertuples(index=False, name=None))
    assert rows_of(got) == rows_of(want) and len(got) == len(keys)


def test_keyed_twin(spark, tmp_path):
    """stream_clips tells a folder's row anew after each batch that touches it."""
    listing = [("/y/a_1.dng", 0), ("/y/a_4.dng", 0), ("/z/b.dng", 0), ("/y/a_2.dng", 1)]
    for k in range(2):
        spark.createDataFrame([(p,) for p, part in listing if part == k], "path string").coalesce(1).write.parquet(str(tmp_path / "in" / f"part={k}"))
    stream = spark.readStream.schema("path string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = catalogue.stream_clips(stream).writeStream.format("memory").queryName("clips").outputMode("update").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    told = {(r.folder, r.n_frames, r.n_missing, tuple(tuple(g) for g in r.gaps)) for r in spark.table("clips").collect()}
    assert ("/y", 3, 1, ((3, 3),)) in told and ("/z", 0, 0, ()) in told

"""Frames in bands against the long form and plain Python."""

import random

import numpy as np
import pytest

from rushes.operators import bands, mosaic
from rushes.operators import lut as luts

WHITE = (2.0, 1.0, 1.6)
MATRIX = [1.2, -0.15, -0.05, -0.1, 1.15, -0.05, 0.0, -0.2, 1.2]
SCHEMA = "frame long, y long, x long, v double, pattern string"


def frames(sizes, patterns, seed=1):
    draw = random.Random(seed)
    return [(f, y, x, draw.choice([draw.random(), 1.0, 0.99, 0.0]), p) for f, ((h, w), p) in enumerate(zip(sizes, patterns)) for y in range(h) for x in range(w)]


def rows_of(df, *columns):
    near = lambda v: None if v is None else round(v, 9)
    return {(r.frame, r.y, r.x): tuple(near(r[c]) for c in columns) for r in df.collect()}


@pytest.mark.parametrize("rows", [2, 3, 64])
def test_bands_and_long_form(spark, rows):
    """All four patterns, frames cut within the halo's reach of each other, frames of one row and one column, an odd pattern and none."""
    sizes = [(8, 6), (7, 5), (9, 4), (8, 8), (1, 6), (5, 1), (4, 4), (6, 6)]
    data = frames(sizes, ["RGGB", "BGGR", "GRBG", "GBRG", "RGGB", "BGGR", "RGBW", None])
    pixels = spark.createDataFrame(data, SCHEMA).repartition(5)
    want = rows_of(mosaic.debayer(pixels), "r", "g", "b")
    got = bands.debayer_bands(pixels, rows)
    assert rows_of(got, "r", "g", "b") == want and got.count() == len(data)
    assert {r.site for r in got.where("frame = 6").collect()} == {None}


@pytest.mark.parametrize("gamma, recover", [("Rec709", True), ("sRGB", False), ("LogC3", True), ("Log3G10", False), ("FilmGen5", True)])
def test_development(spark, gamma, recover):
    data = frames([(8, 6), (7, 5), (9, 4), (8, 8)], bands.PATTERNS, seed=3)
    pixels = spark.createDataFrame(data, SCHEMA).repartition(3)
    want = rows_of(mosaic.develop(pixels, 0.05, 0.95, WHITE, MATRIX, 0.5, gamma, recover), "r", "g", "b")
    got = rows_of(bands.develop_bands(pixels, 0.05, 0.95, WHITE, MATRIX, 0.5, gamma, recover, rows=3), "r", "g", "b")
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-7) for k in want)


def test_curve_table_and_mono(spark):
    """Curve, colours and table in one pass are those steps one after the other; a frame without pattern takes the mono chain."""
    data = frames([(6, 6), (6, 6), (5, 4)], ["RGGB", "GBRG", None], seed=5)
    curve = [float(i * i * 200) for i in range(16)]
    pixels = spark.createDataFrame([(*d[:3], d[3] / 16, d[4], curve if d[0] else None) for d in data], SCHEMA + ", linearisation array<double>")
    n = 5
    draw = random.Random(2)
    table = spark.createDataFrame([("look", n, r, g, b, draw.random(), draw.random(), draw.random()) for r in range(n) for g in range(n) for b in range(n)], "lut string, size long, ri long, gi long, bi long, r double, g double, b double")
    got = rows_of(bands.develop_bands(pixels, 0.0, 0.05, WHITE, MATRIX, gamma="LogC3", lut=table, rows=2), "r", "g", "b")
    straight = mosaic.linearise(pixels.where("frame = 1").withColumnRenamed("linearisation", "curve"), "curve").unionByName(pixels.where("frame = 0").drop("linearisation"))
    chain = mosaic.develop(straight, 0.0, 0.05, WHITE, MATRIX, gamma="LogC3").selectExpr("*", "'look' as lut")
    want = rows_of(luts.apply_lut(chain, table), "r", "g", "b")
    assert all(got[k] == pytest.approx(want[k], abs=1e-7) for k in want)
    _, points = luts.packed_tables(table)["look"]
    for f, y, x, v, _ in data:
        if f == 2:
            v = bands.linearised(np.array([v / 16]), curve, 12)[0] / 0.05
            log = bands.curve(np.array([v]), "LogC3")
            assert got[f, y, x] == pytest.approx(tuple(luts.gather(points, n, np.column_stack([log] * 3))[0]), abs=1e-7)


def test_mono_tone(spark):
    data = frames([(3, 4)], [None], seed=7)
    got = rows_of(bands.develop_bands(spark.createDataFrame(data, SCHEMA), 0.1, 0.9, WHITE, MATRIX, 1.0, "sRGB"), "r", "g", "b")
    for f, y, x, v, _ in data:
        lit = (v - 0.1) / 0.8 * 2 * 2**2.5
        lit = lit / (lit + 1)
        lit = lit * 12.92 if lit < 0.0031308 else 1.055 * lit ** (1 / 2.4) - 0.055
        assert got[f, y, x] == pytest.approx((lit,) * 3, abs=1e-8)


def test_a_frame_lies_in_several_tasks(spark):
    """No task gets more of a frame than its bands: the largest band key has its rows and the halo."""
    pixels = spark.range(96 * 40).selectExpr("0L as frame", "id div 40 as y", "id % 40 as x", "rand(1) as v", "'RGGB' as pattern")
    sizes = [r["count"] for r in bands.in_bands(pixels, 8).groupBy("frame", "band").count().collect()]
    assert max(sizes) == (8 + 2 * bands.HALO) * 40 and len(sizes) == 13
    # small tasks are put together unless that is switched off
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    tasks = bands.in_bands(pixels, 8).selectExpr("spark_partition_id() as t").distinct().count()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tasks > 1
    with pytest.raises(Exception, match="whole rectangle"):
        bands.debayer_bands(pixels.where("x < 30 or y < 20")).collect()
    assert bands.debayer_bands(pixels.limit(0)).collect() == []


@pytest.mark.parametrize("predictor", [1, 2, 3, 4])
@pytest.mark.parametrize("rows", [1, 3, 64])
def test_prediction_in_bands(spark, predictor, rows):
    """Against plain Python: wide, tall, one-row and one-column frames."""
    draw = random.Random(predictor)
    sizes, data, want = [(8, 6), (13, 4), (5, 11), (1, 6), (6, 1)], [], {}
    for f, (h, w) in enumerate(sizes):
        v = {}
        for y in range(h):
            for x in range(w):
                d = draw.randint(-40000, 40000)
                data.append((f, y, x, d))
                if x == 0 and y == 0:
                    guess = 32768
                elif y == 0:
                    guess = v[y, x - 1]
                elif x == 0:
                    guess = v[y - 1, x]
                else:
                    a, b, c = v[y, x - 1], v[y - 1, x], v[y - 1, x - 1]
                    guess = {1: a, 2: b, 3: c, 4: a + b - c}[predictor]
                v[y, x] = (guess + d) % 65536
                want[f, y, x] = v[y, x]
    residuals = spark.createDataFrame(data, "frame long, y long, x long, d long").repartition(4)
    got = {(r.frame, r.y, r.x): r.v for r in bands.rebuild_bands(residuals, predictor, rows=rows).collect()}
    assert got == want

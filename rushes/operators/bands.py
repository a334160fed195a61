"""Mosaic frames in bands of rows: colours and the whole development in numpy blocks.

A frame is cut into bands of so many rows, each with a halo of two rows of its
neighbours; the border rows are copied to the neighbours' keys, so no task needs a
frame and a large one spreads over many. Bands of one shape in an Arrow batch are
worked on together. Frames are whole rectangles of samples from (0, 0).
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rushes.operators import lut as luts

HALO = 2
ROWS = 64
CLIP = 0.99
SMALL, EPS = 1e-4, 1e-3
#: Samples that are worked on at once.
SAMPLES = 1 << 18
# Sites of the patterns by parity of row and column, latitude in stops, roll-off by level (lower edge in stops, power).
PATTERNS = ("RGGB", "BGGR", "GRBG", "GBRG")
LATITUDE, MONO_LATITUDE = 1.0, 2.5
ROLL_OFF = {"low": (-2.0, 0.5), "medium": (-2.5, 0.4), "high": (-2.5, 0.3)}


def whole_bands(batches, keys=("frame", "band")):
    """Batches of sorted rows cut anew, so that a band never lies in two."""
    kept = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            c = batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False)
            new[1:] |= c[1:] != c[:-1]
        if kept and any(kept[-1].column(kept[-1].schema.get_field_index(k))[-1] != batch.column(batch.schema.get_field_index(k))[0] for k in keys):
            new[0] = True
        cuts = np.flatnonzero(new)
        if len(cuts):
            if cuts[-1]:
                kept.append(batch.slice(0, int(cuts[-1])))
            if kept:
                yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
            kept = [batch.slice(int(cuts[-1]))]
        else:
            kept.append(batch)
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]


def blocks_of(batch: pa.RecordBatch):
    """(frames, band, rows of each sample's y, columns' x, index of samples) of bands of one shape: index is bands x rows x columns."""
    frame, band, y, x = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("frame", "band", "y", "x"))
    begin = np.flatnonzero(np.r_[True, (frame[1:] != frame[:-1]) | (band[1:] != band[:-1])])
    size = np.diff(begin, append=len(frame))
    wide = x[begin + size - 1] + 1
    if (size % wide).any():
        raise ValueError("a frame is no whole rectangle of samples")
    shape = np.column_stack([y[begin], size // wide, wide])
    for one in np.unique(shape, axis=0):
        of = np.flatnonzero((shape == one).all(1))
        step = max(1, SAMPLES // int(one[1] * one[2]))
        for k in range(0, len(of), step):
            some = of[k : k + step]
            index = begin[some][:, None] + np.arange(int(one[1] * one[2]))
            yield some, one, index.reshape(len(some), int(one[1]), int(one[2]))


def near(v: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """The samples so many rows and columns away, edges repeated."""
    rows, columns = np.clip(np.arange(v.shape[1]) + dy, 0, v.shape[1] - 1), np.clip(np.arange(v.shape[2]) + dx, 0, v.shape[2] - 1)
    return v[:, rows][:, :, columns]


def colours(v: np.ndarray, y0: int, pattern: np.ndarray, doubled: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(r, g, b) of bands x rows x columns of mosaic samples whose first row is y0; pattern: an index into PATTERNS for each band.

    Whether two directions are equally rough can hang on the last bit, so the order of the sums is part of the result: differences
    from both sides are added, as the reference does, or, if doubled, both sides are taken from twice the sample, as the development does.
    """
    left, right, above, below = near(v, 0, -1), near(v, 0, 1), near(v, -1, 0), near(v, 1, 0)
    bend = lambda a, b: 2 * v - a - b if doubled else (v - a) + (v - b)
    across2, down2 = bend(near(v, 0, -2), near(v, 0, 2)), bend(near(v, -2, 0), near(v, 2, 0))
    rough_h, rough_v = np.abs(left - right + np.abs(across2)), np.abs(above - below + np.abs(down2))
    smooth_h, smooth_v = (left + right) / 2 + across2 / 4, (above + below) / 2 + down2 / 4
    both = (smooth_h + smooth_v) / 2 if doubled else (above + below + left + right) / 4 + (across2 + down2) / 8
    green = np.where(rough_h == rough_v, both, np.where(rough_h > rough_v, smooth_v, smooth_h))

    corners = {(dy, dx): near(v, dy, dx) for dy in (-1, 1) for dx in (-1, 1)}
    side_v, side_h = {-1: above, 1: below}, {-1: left, 1: right}
    weights = {k: 1 / np.maximum(SMALL, np.abs(green - (side_v[k[0]] + side_h[k[1]]) / 2)) for k in corners}
    other = sum(corners[k] * weights[k] for k in corners) / sum(weights.values())

    def blend(first, second, one, two):
        p, q = np.abs((first[0] + first[1]) / 2 - v), np.abs((second[0] + second[1]) / 2 - v)
        return one + (two - one) * np.clip(p / np.maximum(SMALL, p + q), 0, 1)

    down = blend((corners[-1, -1], corners[-1, 1]), (corners[1, -1], corners[1, 1]), above, below)
    across = blend((corners[-1, -1], corners[1, -1]), (corners[-1, 1], corners[1, 1]), left, right)

    parity = (np.arange(v.shape[1]) + y0)[:, None] % 2 * 2 + np.arange(v.shape[2]) % 2
    letters = np.array([[ord(c) for c in p] for p in PATTERNS])
    site = letters[pattern][:, parity]
    beside = letters[pattern][:, parity ^ 1]
    chroma = lambda c: np.where(site == ord(c), v, np.where(site == ord("G"), np.where(beside == ord(c), across, down), other))
    return chroma("R"), np.where(site == ord("G"), v, green), chroma("B")


def step(a, b, x):
    t = np.clip((x - a) / (b - a), 0, 1)
    return t * t * (3 - 2 * t)


def mix(a, b, t):
    return a + (b - a) * t


def recovered(c: list[np.ndarray], white) -> list[np.ndarray]:
    """Clipped channels from those that are not; white is the camera's white by its smallest channel."""
    two = {}
    for u in range(3):
        others = [k for k in range(3) if k != u]
        want = {k: c[u] * (white[k] / max(EPS, white[u])) for k in others}
        over = (c[others[0]] > want[others[0]]) | (c[others[1]] > want[others[1]])
        scale = sum(c[k] / np.maximum(EPS, want[k]) for k in others) / 2
        t = step(CLIP / 4, CLIP, c[u])
        two[u, u] = mix(c[u], white[u], t)
        for k in others:
            high = np.maximum(c[k], want[k])
            two[u, k] = mix(np.where(over, high * 0.4 + want[k] * scale * 0.6, high), white[k], t)
    one = {}
    for k in range(3):
        u1, u2 = [n for n in range(3) if n != k]
        a, b = c[u1], c[u2]
        gray = np.log2(np.maximum(1e-30, a) / np.maximum(EPS, b))
        middle, at_middle = np.where(a < b, b, a), np.where(a < b, white[u2], white[u1])
        ratio = at_middle / np.maximum(EPS, middle)
        low = np.minimum(middle, at_middle * ratio)
        t, e = step(-0.5, 0.5, gray), step(low, np.maximum(CLIP, low + 1e-12), middle)
        for n in range(3):
            one[k, n] = mix(mix(two[u1, n], two[u2, n], t), white[n] * ratio, e)
    clipped = [x >= CLIP for x in c]
    count = sum(x.astype(int) for x in clipped)
    top = np.maximum(np.maximum(c[0], c[1]), c[2])
    largest = np.where(c[0] == top, 0, np.where(c[1] == top, 1, 2))
    of_one = np.where(count == 1, np.where(clipped[0], 0, np.where(clipped[1], 1, 2)), largest)
    free = np.where(~clipped[0], 0, np.where(~clipped[1], 1, 2))
    close = step(CLIP / 2, CLIP, top)
    pick = lambda kind, by, n: np.where(by == 0, kind[0, n], np.where(by == 1, kind[1, n], kind[2, n]))
    return [np.where(count == 3, white[n], np.where(count == 2, pick(two, free, n), np.where(count == 1, pick(one, of_one, n), mix(c[n], pick(one, of_one, n), close)))) for n in range(3)]


def curve(x: np.ndarray, space: str) -> np.ndarray:
    """Transfer curves; the constants are fixed values of the named spaces. Linear is none."""
    if space == "Rec709":
        a = 1.09929682680944
        return np.where(x < 0.018053968510807, x * 4.5, np.abs(x) ** (1 / 2.2) * a - (a - 1))
    if space == "sRGB":
        return np.where(x < 0.0031308, x * 12.92, np.abs(x) ** (1 / 2.4) * 1.055 - 0.055)
    if space == "LogC3":
        return np.where(x > 0.010591, np.log10(np.maximum(x, 0) * 5.555556 + 0.052272) * 0.247190 + 0.385537, x * 5.367655 + 0.092809)
    if space == "Log3G10":
        y = x + 0.01
        return np.where(y < 0, y * 15.1927, np.log10(np.maximum(y, 0) * 155.975327 + 1) * 0.224282)
    if space == "FilmGen5":
        return np.where(x < 0.005, x * 8.283605932402494 + 0.09246575342465753, np.log(np.maximum(x, 0) + 0.005494072432257808) * 0.08692876065491224 + 0.5300133392291939)
    if space == "Linear":
        return x
    raise ValueError(space)


def linearised(v: np.ndarray, table, bits: int, decoded: int = 16) -> np.ndarray:
    """Samples of 0 to 1 through a curve of 16-bit codes: linear between texel centres, clamped to the ends."""
    table = np.asarray(table, float)
    at = v / (((1 << bits) - 1) / ((1 << decoded) - 1)) * len(table) - 0.5
    low = np.floor(at)
    place = [np.clip(low + k, 0, len(table) - 1).astype(np.intp) for k in (0, 1)]
    return mix(table[place[0]], table[place[1]], at - low) / 65535


def developed(c: list[np.ndarray], settings: dict) -> list[np.ndarray]:
    """Camera colours to display: levels, highlights, exposure, matrix, tone, roll-off, gamut, curve, look-up table."""
    s = settings
    c = [(x - s["black"]) / (s["white_level"] - s["black"]) for x in c]
    white = s["white"]
    if s["recover"]:
        c = recovered(c, [w / min(white) for w in white])
    else:
        t = step(CLIP * 2**-0.5, CLIP, np.maximum(np.maximum(c[0], c[1]), c[2]))
        c = [mix(x, w / max(white), t) for x, w in zip(c, white)]
    c = [x * 2.0 ** s["stops"] for x in c]
    m = s["matrix"]
    c = [np.maximum(0, c[0] * m[3 * i] + c[1] * m[3 * i + 1] + c[2] * m[3 * i + 2]) for i in range(3)]
    light = lambda c: c[0] * 0.2126 + c[1] * 0.7152 + c[2] * 0.0722
    if s["gamma"] in ("Rec709", "sRGB"):
        if s["tone"]:
            c = [x * 2.0**LATITUDE for x in c]
            bright = light(c)
            c = [x / (bright + 1) for x in c]
        if s["roll_off"]:
            under, power = ROLL_OFF[s["roll_off"]]
            bright = light(c)
            t = np.clip(step(2.0**under, 2**0.25, bright) ** power, 0, 1)
            c = [mix(x, bright, t) for x in c]
        if s["gamut"]:
            most = np.maximum(np.maximum(c[0], c[1]), c[2])
            k = 0.1 / 0.2**0.5
            scale = np.where(most == 0, 1, np.abs(most))
            out = []
            for x in c:
                d = np.where(most == 0, 0, (most - x) / scale)
                far = np.sqrt(np.maximum(0, d - 0.9 + k * k / 4)) * k - k * (k * k / 4) ** 0.5 + 0.9
                out.append(most - np.where(d < 0.9, d, far) * np.abs(most))
            c = out
    c = [curve(x, s["gamma"]) for x in c]
    return through_table(c, s["lut"])


def developed_mono(v: np.ndarray, settings: dict) -> list[np.ndarray]:
    """Samples of a monochrome frame to display: levels, exposure, tone, curve, look-up table, in three channels."""
    s = settings
    v = (v - s["black"]) / (s["white_level"] - s["black"]) * 2.0 ** s["stops"]
    if s["gamma"] in ("Rec709", "sRGB") and s["tone"]:
        v = v * 2.0**MONO_LATITUDE
        v = v / (v + 1)
    v = curve(v, s["gamma"])
    return through_table([v, v, v], s["lut"])


def through_table(c: list[np.ndarray], table) -> list[np.ndarray]:
    if table is None:
        return c
    size, points = table
    flat = luts.gather(points, size, np.column_stack([x.ravel() for x in c]))
    return [flat[:, k].reshape(c[0].shape) for k in range(3)]


def in_bands(pixels: DataFrame, rows: int, halo: int = HALO) -> DataFrame:
    """pixels with band: every sample in its own band and in each whose halo it lies in; the bands are spread over tasks and sorted."""
    if rows < halo:
        raise ValueError("a band has at least as many rows as its halo")
    at = lambda shift: F.floor((F.col("y") + shift) / rows).cast("long")
    # the band below the last row is made of halo rows alone and gives nothing
    bands = F.array_distinct(F.array(at(0), F.greatest(F.lit(0).cast("long"), at(-halo)), at(halo)))
    spread = pixels.withColumn("band", F.explode(bands))
    return spread.repartition("frame", "band").sortWithinPartitions("frame", "band", "y", "x")


def _map_bands(pixels: DataFrame, work, rows: int, bits: int) -> DataFrame:
    """frame, y, x, r, g, b, pattern: work(v, first row, pattern, curve) for the bands of one shape, pattern and curve."""
    kind = pixels.schema["frame"].dataType.simpleString()
    curves = "linearisation" in pixels.columns

    def run(batches):
        for batch in whole_bands(batches):
            column = lambda name: batch.column(batch.schema.get_field_index(name))
            v, y, x = (column(n).to_numpy(zero_copy_only=False) for n in ("v", "y", "x"))
            band = column("band").to_numpy()
            pattern = column("pattern").to_pylist()
            for _, shape, index in blocks_of(batch):
                first = index[:, 0, 0]
                tables = [column("linearisation")[int(i)].as_py() or None if curves else None for i in first]
                kinds = [pattern[i] for i in first.tolist()]
                keys = sorted({(k, tuple(t) if t else None) for k, t in zip(kinds, tables)}, key=str)
                for key in keys:
                    of = np.array([i for i, (k, t) in enumerate(zip(kinds, tables)) if (k, tuple(t) if t else None) == key])
                    some = index[of]
                    block = v[some].astype(float)
                    if key[1]:
                        block = linearised(block, key[1], bits)
                    c = work(block, int(shape[0]), key[0])
                    own = y[some] // rows == band[some]
                    place = some[own]
                    yield pa.RecordBatch.from_arrays([column("frame").take(pa.array(place)), pa.array(y[place].astype(np.int64)), pa.array(x[place].astype(np.int64)), *[pa.array(k[own]) for k in c], pa.array([key[0]] * len(place), pa.string())], names=["frame", "y", "x", "r", "g", "b", "pattern"])

    out = in_bands(pixels, rows).select("frame", "band", "y", "x", "v", "pattern", *(["linearisation"] if curves else []))
    return out.mapInArrow(run, f"frame {kind}, y long, x long, r double, g double, b double, pattern string")


def debayer_bands(pixels: DataFrame, rows: int = ROWS) -> DataFrame:
    """frame, y, x, site (R, G, B), r, g, b of mosaic samples (frame, y, x, v, pattern); null colours for a pattern that is none of the four."""

    def work(v, y0, pattern):
        if pattern not in PATTERNS:
            return [np.full_like(v, np.nan)] * 3
        return colours(v, y0, np.full(len(v), PATTERNS.index(pattern)))

    out = _map_bands(pixels, work, rows, 12)
    known = F.col("pattern").isin(*PATTERNS)
    site = F.when(known, F.substring(F.col("pattern"), (F.col("y") % 2 * 2 + F.col("x") % 2 + 1).cast("int"), F.lit(1)))
    return out.select("frame", "y", "x", site.alias("site"), *[F.when(known, F.col(c)).alias(c) for c in "rgb"])


def develop_bands(pixels: DataFrame, black: float, white_level: float, white: tuple[float, float, float], matrix: list[float], stops: float = 0.0, gamma: str = "Rec709", recover: bool = True, tone: bool = True, roll_off: str | None = "medium", gamut: bool = True, lut: DataFrame | None = None, bits: int = 12, rows: int = ROWS) -> DataFrame:
    """frame, y, x, r, g, b on display: the whole chain in one pass over bands.

    pixels: frame, y, x, v (0 to 1) and pattern, one of the four or null for a
    monochrome frame, whose chain is levels, exposure, tone, curve and table; another
    pattern gives null colours. A column linearisation (array of 16-bit codes, null or empty
    where a frame has none; bits are the depth its indices have) is applied before the colours.
    Tone, roll-off (low, medium, high or None) and gamut serve Rec709 and sRGB only. lut: rows of one table
    of at most lut.GATHER_POINTS points; of larger ones use apply_lut on the result.
    Each frame is a whole rectangle from (0, 0): another one raises ValueError.
    """
    table = None
    if lut is not None:
        if lut.count() > luts.GATHER_POINTS:
            raise ValueError("the table is too large to travel: use apply_lut on the result")
        (table,) = luts.packed_tables(lut).values()
    settings = {"black": black, "white_level": white_level, "white": white, "matrix": matrix, "stops": stops, "gamma": gamma, "recover": recover, "tone": tone, "roll_off": roll_off, "gamut": gamut, "lut": table}
    shared = pixels.sparkSession.sparkContext.broadcast(settings)

    def work(v, y0, pattern):
        if pattern is None:
            return developed_mono(v, shared.value)
        if pattern not in PATTERNS:
            return [np.full_like(v, np.nan)] * 3
        with np.errstate(all="ignore"):
            return developed(list(colours(v, y0, np.full(len(v), PATTERNS.index(pattern)), doubled=True)), shared.value)

    out = _map_bands(pixels, work, rows, bits)
    return out.select("frame", "y", "x", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in "rgb"])


def _before(sums: DataFrame, place: str) -> DataFrame:
    """frame, band, place, before: what a column's or diagonal's earlier bands add up to. sums: frame, band, place, s."""
    earlier = Window.partitionBy("frame", place).orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("frame", "band", place, F.sum("s").over(earlier).alias("before"))


def rebuild_bands(residuals: DataFrame, predictor: int, precision: int = 16, point: int = 0, rows: int = ROWS) -> DataFrame:
    """frame, y, x, v from residuals d by predictor 1 (left), 2 (up), 3 (diagonal) or 4 (left + up - diagonal), as mosaic.rebuild_samples.

    Prefix sums in two levels: a band adds up its own residuals, and what the bands
    above add is summed by column (by diagonal for predictor 3) over one row for each band, so no
    task holds a frame. That sum travels to its band as a row of samples at y = -1. Each frame
    is a whole rectangle from (0, 0); a part after a restart needs its own frame key.
    """
    if predictor not in (1, 2, 3, 4):
        raise ValueError(predictor)
    band = F.floor(F.col("y") / rows).cast("long")
    every = residuals.select("frame", band.alias("band"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("d").cast("long").alias("d"))
    along = lambda keep, order: F.sum("d").over(Window.partitionBy("frame").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias(keep)
    if predictor == 3:
        # the edges are sums along the edge; from there diagonals add up
        top = every.where("y = 0").select("frame", "band", "y", "x", along("d", "x"))
        left = every.where("x = 0 and y > 0").unionByName(every.where("x = 0 and y = 0")).select("frame", "band", "y", "x", along("d", "y")).where("y > 0")
        every = every.where("x > 0 and y > 0").unionByName(top).unionByName(left)
        sums = every.groupBy("frame", "band", (F.col("x") - F.col("y")).alias("line")).agg(F.sum("d").alias("s"))
        # a diagonal passes through the bands below it, whether or not it has samples left there
        last = every.groupBy("frame").agg(F.max("x").alias("wide"))
        carried = _before(sums, "line").where("before is not null").join(last, "frame").withColumn("x", F.col("line") + F.col("band") * rows).where("x between 1 and wide").select("frame", "band", "x", F.col("before").alias("d"))
    else:
        sums = every.groupBy("frame", "band", "x").agg(F.sum("d").alias("s"))
        carried = _before(sums, "x").where("before is not null").select("frame", "band", "x", F.col("before").alias("d"))
        if predictor == 2:
            top = every.where("y = 0").select("frame", "x", along("a", "x"), "d").select("frame", "x", (F.col("a") - F.col("d")).alias("a"))
            bands_of = every.select("frame", "band").distinct()
            first = bands_of.join(top, "frame").select("frame", "band", "x", F.col("a").alias("d"))
            carried = carried.unionByName(first)
    carried = carried.groupBy("frame", "band", "x").agg(F.sum("d").alias("d"))
    # a band has a row of sums for all of its columns, zeros where nothing is carried
    widths = every.select("frame", "band", "x").distinct().withColumn("d", F.lit(0).cast("long"))
    offsets = widths.unionByName(carried).groupBy("frame", "band", "x").agg(F.sum("d").alias("d")).withColumn("y", F.lit(-1).cast("long"))
    spread = every.unionByName(offsets).repartition("frame", "band").sortWithinPartitions("frame", "band", "y", "x")
    kind = residuals.schema["frame"].dataType.simpleString()
    seed = 1 << (precision - point - 1)

    def run(batches):
        for batch in whole_bands(batches):
            column = lambda name: batch.column(batch.schema.get_field_index(name))
            d, y, x = (column(n).to_numpy() for n in ("d", "y", "x"))
            for _, _, index in blocks_of(batch):
                carry, block = d[index[:, 0]], d[index[:, 1:]]
                if predictor == 1:
                    total = np.cumsum(block, 2) + (np.cumsum(block[:, :, 0], 1) - block[:, :, 0] + carry[:, :1])[:, :, None]
                elif predictor == 2:
                    total = np.cumsum(block, 1) + carry[:, None]
                elif predictor == 4:
                    total = np.cumsum(np.cumsum(block, 1) + carry[:, None], 2)
                else:
                    total = block.copy()
                    total[:, 0] += carry
                    for r in range(1, block.shape[1]):
                        total[:, r, 1:] += total[:, r - 1, :-1]
                place = index[:, 1:].ravel()
                yield pa.RecordBatch.from_arrays([column("frame").take(pa.array(place)), pa.array(y[place]), pa.array(x[place]), pa.array((total.ravel() + seed) % 65536)], names=["frame", "y", "x", "v"])

    return spread.mapInArrow(run, f"frame {kind}, y long, x long, v long")

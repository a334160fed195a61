"""Mosaic samples in long form (keys, y, x, v): unpacking, prediction, tiles, interpolation of colours, recovery.

Rows and columns of a frame need its pixels together, so a frame is one key: pixels
move once, by frame, and both window directions use that partitioning.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rushes.operators import develop as dev

SMALL = 1e-4


def unpack_bits(packed: str, bits: int, n_bytes: int) -> Column:
    """array<int> of the samples of so many bits in the first n_bytes of a byte array, highest bit first."""
    if bits not in (10, 12, 14):
        raise ValueError(bits)
    at = f"cast(i * {bits} div 8 as int)"
    byte = lambda k: f"coalesce(try_element_at({packed}, {at} + {k + 1}), 0)"
    return F.expr(f"transform(sequence(0, {n_bytes * 8 // bits - 1}), i -> shiftright({byte(0)} * 65536 + {byte(1)} * 256 + {byte(2)}, cast({24 - bits} - i * {bits} % 8 as int)) & {(1 << bits) - 1})")


def expand_precision(v: Column, bits: int, precision: int) -> Column:
    return F.shiftleft(v, bits - precision)


def assemble_tiles(tiles: DataFrame, tile_w: int, tile_h: int, width: int, height: int) -> DataFrame:
    """frame, y, x, v of tiles (frame, tile, samples) in row order, without padding."""
    across = -(-width // tile_w)
    rows = tiles.select("frame", "tile", F.posexplode("samples").alias("i", "v"))
    place = rows.select("frame", F.expr(f"tile div {across} * {tile_h} + i div {tile_w}").alias("y"), F.expr(f"tile % {across} * {tile_w} + i % {tile_w}").alias("x"), "v")
    return place.where((F.col("x") < width) & (F.col("y") < height))


def crop_orient(pixels: DataFrame, crop: tuple[int, int, int, int], orientation: str) -> DataFrame:
    """The crop (x, y, w, h), each brought down to an even number, turned by the TIFF code in a column."""
    x0, y0, w, h = (n // 2 * 2 for n in crop)
    inside = pixels.where(F.col("x").between(x0, x0 + w - 1) & F.col("y").between(y0, y0 + h - 1))
    x, y = F.col("x") - x0, F.col("y") - y0
    far_x, far_y = F.lit(w - 1) - x, F.lit(h - 1) - y
    turned = {1: (x, y), 2: (far_x, y), 3: (far_x, far_y), 4: (x, far_y), 5: (y, x), 6: (far_y, x), 7: (far_y, far_x), 8: (y, far_x)}
    new = [F.coalesce(*[F.when(F.col(orientation) == code, place[axis]) for code, place in turned.items()], (x, y)[axis]) for axis in (0, 1)]
    return inside.withColumns({"_x": new[0], "_y": new[1]}).drop("x", "y").withColumnsRenamed({"_x": "x", "_y": "y"})


def rebuild_samples(residuals: DataFrame, predictor: int, precision: int = 16, point: int = 0) -> DataFrame:
    """frame, y, x, v from residuals d by predictor 1 (left), 2 (up), 3 (diagonal) or 4 (left + up - diagonal).

    The top row is predicted from the left and the left column from above, from a seed
    of half the range; values wrap at 16 bits. A part after a restart needs its own frame key.
    """
    row, column = Window.partitionBy("frame", "y").orderBy("x"), Window.partitionBy("frame", "x").orderBy("y")
    up_to = Window.unboundedPreceding, Window.currentRow
    out = residuals.repartition("frame").withColumn("_a", F.sum("d").over(row.rowsBetween(*up_to))).withColumn("_b", F.sum("d").over(column.rowsBetween(*up_to)))
    if predictor == 1:
        total = F.first("_b").over(row) + F.col("_a") - F.first("d").over(row)
    elif predictor == 2:
        total = F.first("_a").over(column) + F.col("_b") - F.first("d").over(column)
    elif predictor == 3:
        diagonal = Window.partitionBy("frame", F.col("x") - F.col("y")).orderBy("y")
        out = out.withColumn("_edge", F.when(F.col("y") == 0, F.col("_a")).otherwise(F.col("_b")))
        total = F.first("_edge").over(diagonal) + F.sum("d").over(diagonal.rowsBetween(*up_to)) - F.first("d").over(diagonal)
    elif predictor == 4:
        total = F.sum("_a").over(column.rowsBetween(*up_to))
    else:
        raise ValueError(predictor)
    return out.select("frame", "y", "x", F.pmod(total + (1 << (precision - point - 1)), F.lit(65536)).alias("v"))


def linearise(pixels: DataFrame, table: str, bits: int = 12, decoded: int = 16) -> DataFrame:
    """v (0 to 1) through a curve of 16-bit codes in an array column: linear between texel centres, clamped to the ends."""
    span = ((1 << bits) - 1) / ((1 << decoded) - 1)
    out = pixels.withColumn("_p", F.col("v") / span * F.size(table) - 0.5).withColumn("_i", F.floor("_p"))
    at = lambda k: F.expr(f"{table}[cast(greatest(0, least(size({table}) - 1, _i + {k})) as int)]")
    mixed = at(0) + (at(1) - at(0)) * (F.col("_p") - F.col("_i"))
    return out.withColumn("v", mixed / 65535).drop("_p", "_i", table)


def _neighbours(pixels: DataFrame) -> DataFrame:
    """Adds the samples around each one, edges repeated: l1 l2 r1 r2, a1 a2 b1 b2, and corners al ar bl br."""
    row, column = Window.partitionBy("frame", "y").orderBy("x"), Window.partitionBy("frame", "x").orderBy("y")

    def near(c, over, names):
        before, after = F.coalesce(F.lag(c).over(over), F.col(c)), F.coalesce(F.lead(c).over(over), F.col(c))
        return {names[0]: before, names[1]: after}

    def far(over, names):
        return {names[0]: F.coalesce(F.lag("v", 2).over(over), F.lag("v").over(over), F.col("v")), names[1]: F.coalesce(F.lead("v", 2).over(over), F.lead("v").over(over), F.col("v"))}

    out = pixels.repartition("frame").withColumns(near("v", row, ("l1", "r1")) | far(row, ("l2", "r2")))
    return out.withColumns(near("v", column, ("a1", "b1")) | far(column, ("a2", "b2")) | near("l1", column, ("al", "bl")) | near("r1", column, ("ar", "br")))


def _at_chroma(out: DataFrame, doubled: bool) -> DataFrame:
    """Adds green and other: at a red or blue site, green along the smoother direction and the opposite colour; doubled as in bands.colours."""
    c = {n: F.col(n) for n in ("l1", "l2", "r1", "r2", "a1", "a2", "b1", "b2", "v")}
    bend = lambda a, b: c["v"] * 2 - a - b if doubled else (c["v"] - a) + (c["v"] - b)
    dh, dv = bend(c["l2"], c["r2"]), bend(c["a2"], c["b2"])
    out = out.withColumns({"_gh": F.abs(c["l1"] - c["r1"] + F.abs(dh)), "_gv": F.abs(c["a1"] - c["b1"] + F.abs(dv)), "_h": (c["l1"] + c["r1"]) / 2 + dh / 4, "_v": (c["a1"] + c["b1"]) / 2 + dv / 4})
    both = (F.col("_h") + F.col("_v")) / 2 if doubled else (c["a1"] + c["b1"] + c["l1"] + c["r1"]) / 4 + (dh + dv) / 8
    green = F.when(F.col("_gh") == F.col("_gv"), both).when(F.col("_gh") > F.col("_gv"), F.col("_v")).otherwise(F.col("_h"))
    out = out.withColumn("green", green)
    pairs = {"al": ("a1", "l1"), "ar": ("a1", "r1"), "bl": ("b1", "l1"), "br": ("b1", "r1")}
    out = out.withColumns({f"_w{k}": F.lit(1.0) / F.greatest(F.lit(SMALL), F.abs(F.col("green") - (c[p] + c[q]) / 2)) for k, (p, q) in pairs.items()})
    weights = sum((F.col(f"_w{k}") for k in pairs), F.lit(0.0))
    return out.withColumn("other", sum((F.col(k) * F.col(f"_w{k}") for k in pairs), F.lit(0.0)) / weights)


def _at_green(out: DataFrame) -> DataFrame:
    """Adds across and down: at a green site, the colours of its row and of its column."""

    def blend(first, second, one, two):
        p, q = (F.abs((F.col(a) + F.col(b)) / 2 - F.col("v")) for a, b in (first, second))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), p / F.greatest(F.lit(SMALL), p + q)))
        return F.col(one) + (F.col(two) - F.col(one)) * t

    return out.withColumns({"down": blend(("al", "ar"), ("bl", "br"), "a1", "b1"), "across": blend(("al", "bl"), ("ar", "br"), "l1", "r1")})


def debayer(pixels: DataFrame, pattern: str = "pattern", doubled: bool = False) -> DataFrame:
    """frame, y, x, site (R, G, B), r, g, b of mosaic samples; the column pattern is RGGB, BGGR, GRBG or GBRG.

    Another pattern, or none, gives null colours. doubled: the order of sums, as in bands.colours.
    """
    place = (F.col("y") % 2 * 2 + F.col("x") % 2 + 1).cast("int")
    own = F.when(F.col(pattern).isin("RGGB", "BGGR", "GRBG", "GBRG"), F.substring(F.col(pattern), place, F.lit(1)))
    # the other colour of a green site's row
    beside = F.substring(F.col(pattern), (F.col("y") % 2 * 2 + (F.col("x") + 1) % 2 + 1).cast("int"), F.lit(1))
    out = _at_green(_at_chroma(_neighbours(pixels.withColumns({"site": own, "_beside": beside})), doubled))
    chroma = lambda c: F.when(F.col("site") == c, F.col("v")).when(F.col("site") == "G", F.when(F.col("_beside") == c, F.col("across")).otherwise(F.col("down"))).when(F.col("site").isNotNull(), F.col("other"))
    green = F.when(F.col("site") == "G", F.col("v")).when(F.col("site").isNotNull(), F.col("green"))
    return out.select("frame", "y", "x", "site", chroma("R").alias("r"), green.alias("g"), chroma("B").alias("b"))


def highlight_recovery(rgb: DataFrame, white: tuple[float, float, float]) -> DataFrame:
    """Clipped channels from those that are not; white is the camera's white by its smallest channel."""
    level, eps = dev.CLIP_LEVEL, 1e-3
    mix = lambda a, b, t: a + (b - a) * t
    names = ("r", "g", "b")
    out = rgb

    # by one channel that is not clipped: two(u) for each u, as columns
    for u in range(3):
        others = [k for k in range(3) if k != u]
        base = F.col(names[u])
        out = out.withColumns({f"_y{u}{k}": base * (white[k] / max(eps, white[u])) for k in others})
        over = F.lit(False)
        for k in others:
            over = over | (F.col(names[k]) > F.col(f"_y{u}{k}"))
        scale = sum((F.col(names[k]) / F.greatest(F.lit(eps), F.col(f"_y{u}{k}")) for k in others), F.lit(0.0)) / 2
        out = out.withColumns({f"_o{u}": over, f"_s{u}": scale, f"_t{u}": dev.smoothstep(level / 4, level, base)})
        new = {f"_two{u}{u}": mix(base, F.lit(white[u]), F.col(f"_t{u}"))}
        for k in others:
            high = F.greatest(F.col(names[k]), F.col(f"_y{u}{k}"))
            new[f"_two{u}{k}"] = mix(F.when(F.col(f"_o{u}"), high * 0.4 + F.col(f"_y{u}{k}") * F.col(f"_s{u}") * 0.6).otherwise(high), F.lit(white[k]), F.col(f"_t{u}"))
        out = out.withColumns(new)

    # one clipped channel c: a blend of both by how the others compare
    for c in range(3):
        u1, u2 = [k for k in range(3) if k != c]
        a, b = F.col(names[u1]), F.col(names[u2])
        gray = F.log2(F.greatest(F.lit(1e-30), a) / F.greatest(F.lit(eps), b))
        mid, at_mid = F.when(a < b, b).otherwise(a), F.when(a < b, F.lit(white[u2])).otherwise(F.lit(white[u1]))
        out = out.withColumns({f"_m{c}": mid, f"_r{c}": at_mid / F.greatest(F.lit(eps), mid), f"_t": dev.smoothstep(-0.5, 0.5, gray), f"_ws": at_mid * at_mid / F.greatest(F.lit(eps), mid)})
        low = F.least(F.col(f"_m{c}"), F.col("_ws"))
        out = out.withColumn("_e", dev.smoothstep(low, F.greatest(F.lit(level), low + 1e-12), F.col(f"_m{c}")))
        out = out.withColumns({f"_one{c}{k}": mix(mix(F.col(f"_two{u1}{k}"), F.col(f"_two{u2}{k}"), F.col("_t")), F.lit(white[k]) * F.col(f"_r{c}"), F.col("_e")) for k in range(3)})

    clipped = [F.col(n) >= level for n in names]
    count = sum((f.cast("int") for f in clipped), F.lit(0))
    top = F.greatest(*names)
    largest = F.when(F.col("r") == top, 0).when(F.col("g") == top, 1).otherwise(2)
    out = out.withColumns({"_n": count, "_top": top, "_c": F.when(count == 1, F.when(clipped[0], 0).when(clipped[1], 1).otherwise(2)).otherwise(largest), "_u": F.when(~clipped[0], 0).when(~clipped[1], 1).otherwise(2)})
    pick = lambda kind, by, k: F.when(F.col(by) == 0, F.col(f"_{kind}0{k}")).when(F.col(by) == 1, F.col(f"_{kind}1{k}")).otherwise(F.col(f"_{kind}2{k}"))
    near = dev.smoothstep(level / 2, level, F.col("_top"))
    new = {n: F.when(F.col("_n") == 3, F.lit(white[k])).when(F.col("_n") == 2, pick("two", "_u", k)).when(F.col("_n") == 1, pick("one", "_c", k)).otherwise(mix(F.col(n), pick("one", "_c", k), near)) for k, n in enumerate(names)}
    return out.select(*[c for c in rgb.columns if c not in names], *[c.alias(n) for n, c in new.items()])


def develop(pixels: DataFrame, black: float, white_level: float, white: tuple[float, float, float], matrix: list[float], stops: float = 0.0, gamma: str = "Rec709", recover: bool = True) -> DataFrame:
    """The whole chain: colours, levels, highlights, exposure, matrix, tone, roll-off, gamut, curve.

    pixels: frame, y, x, v (0 to 1), pattern. Tone, roll-off and gamut serve Rec709 and sRGB only.
    """
    rgb = debayer(pixels, doubled=True).where("site is not null").drop("site")
    rgb = rgb.withColumns({c: (F.col(c) - black) / (white_level - black) for c in "rgb"})
    if recover:
        rgb = highlight_recovery(rgb, tuple(w / min(white) for w in white))
    else:
        rgb = dev.highlight_correct(rgb, tuple(w / max(white) for w in white))
    rgb = dev.to_display(dev.exposure(rgb, stops), matrix)
    if gamma in ("Rec709", "sRGB"):
        rgb = dev.gamut_compress(dev.highlight_rolloff(dev.tone_map(rgb)))
    return rgb.withColumns({c: dev.encode_gamma(F.col(c), gamma) for c in "rgb"})

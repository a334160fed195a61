"""Frame metadata: defaults, checks, drift, reports."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_tag_defaults(meta: DataFrame) -> DataFrame:
    """Values that stand in for absent tags; what the table has no column for is left out.

    White level: all bits set. Black level: 0, fractions cut off. Pixel aspect: 1 to 1.
    Active area (top, left, bottom, right): the whole image. Rate: 24000/1001.
    """
    white = F.coalesce("white_level", F.expr("shiftleft(1L, bits) - 1"))
    out = {"black_level": F.coalesce("black_level", F.lit(0)).cast("long"), "white_level": white.cast("long"), "exposure": F.coalesce("baseline_exposure", F.lit(0.0)), "rate_num": F.coalesce("rate_num", F.lit(24000)).cast("long"), "rate_den": F.coalesce("rate_den", F.lit(1001)).cast("long")}
    if "scale" in meta.columns:
        out |= {"pixel_w": F.coalesce(F.get("scale", F.lit(0)), F.lit(1.0)), "pixel_h": F.coalesce(F.get("scale", F.lit(1)), F.lit(1.0))}
    if "active_area" in meta.columns:
        whole = F.array(F.lit(0), F.lit(0), "height", "width").cast("array<long>")
        out["active_area"] = F.coalesce("active_area", whole)
    if "model" in meta.columns:
        out["model"] = F.coalesce("model", F.lit(""))
    return meta.select("clip", *[c.alias(n) for n, c in out.items()])


def decoded_depth(meta: DataFrame) -> DataFrame:
    depth = F.when(F.col("compression") == 1, F.when(F.col("bits") > 8, 16).otherwise(8)).when(F.col("compression") == 7, 16).otherwise(F.col("bits"))
    return meta.select("clip", depth.cast("long").alias("decoded_bits"), F.expr("cast(floor(width * height * bits / 8) as bigint)").alias("packed_bytes"))


def padded_dimensions(meta: DataFrame) -> DataFrame:
    up = lambda size, tile: F.coalesce(F.ceil(F.col(size) / F.col(tile)) * F.col(tile), F.col(size)).cast("long")
    return meta.select("clip", up("width", "tile_w").alias("padded_w"), up("height", "tile_h").alias("padded_h"))


def tile_grid(meta: DataFrame) -> DataFrame:
    """A row for each tile of tiled images, row by row: its place, the part of it that shows, and where its samples begin among the decoded ones.

    A clip's tiles are made where its row lies; nothing is shuffled.
    """
    across, down = F.ceil(F.col("width") / F.col("tile_w")), F.ceil(F.col("height") / F.col("tile_h"))
    each = meta.where("tile_w > 0 and tile_h > 0").withColumn("across", across).withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), across * down - 1)))
    x, y = F.col("tile") % F.col("across") * F.col("tile_w"), F.floor(F.col("tile") / F.col("across")) * F.col("tile_h")
    shown = lambda size, at, tile: F.least(F.col(tile), F.col(size) - at).cast("long")
    return each.select("clip", "tile", x.cast("long").alias("x"), y.cast("long").alias("y"), shown("width", x, "tile_w").alias("shown_w"), shown("height", y, "tile_h").alias("shown_h"), (F.col("tile") * F.col("tile_w") * F.col("tile_h")).cast("long").alias("first_sample"))


def display_geometry(meta: DataFrame) -> DataFrame:
    """Size on display and aspect ratio (of the crop, or else the image, times the pixels' aspect; not reduced); both are swapped where the orientation transposes."""
    w, h = F.coalesce("crop_w", "width").cast("long"), F.coalesce("crop_h", "height").cast("long")
    turned = F.col("orientation").isin(5, 6, 7, 8)
    scale = [F.coalesce(F.get("scale", F.lit(i)), F.lit(1.0)) if "scale" in meta.columns else F.lit(1.0) for i in (0, 1)]
    num, den = (F.floor(size * by).cast("long") for size, by in zip((w, h), scale))
    swapped = lambda a, b, name: F.when(turned, b).otherwise(a).alias(name)
    return meta.select("clip", swapped(w, h, "display_w"), swapped(h, w, "display_h"), swapped(num, den, "aspect_num"), swapped(den, num, "aspect_den"))


def support_status(meta: DataFrame) -> DataFrame:
    """meta with `support`: why a frame cannot be decoded, or None.

    In this order: a file that could not be read, a colour pattern that is none of
    the four and not absent, no segments or as many places as sizes not, a compression
    other than 1 and 7, a depth of uncompressed samples other than 8, 10, 12, 14, 16,
    and segments that don't unpack to the padded image: those of 8 and 16 bits must
    have its bytes at least, those of 10, 12 and 14 fill it exactly (each unpacks to whole
    bytes, none beyond the image), a single compressed one must be as large as it.
    """
    tile = lambda c: F.when(F.col("tiled"), F.col(c))
    up = lambda size, by: F.coalesce(F.ceil(F.col(size) / by) * by, F.col(size)).cast("long")
    area = up("width", tile("tile_w")) * up("height", tile("tile_h"))
    size = F.floor(area * F.col("bits") / 8)
    cut = lambda acc, n: F.greatest(F.least(n, size - acc["read"]), F.lit(0).cast("long"))
    step = lambda acc, n: F.struct((acc["read"] + cut(acc, n)).alias("read"), (acc["out"] + F.floor(cut(acc, n) * 16 / F.col("bits"))).alias("out"))
    zero = F.lit(0).cast("long")
    unpacked = F.aggregate("byte_counts", F.struct(zero.alias("read"), zero.alias("out")), step)["out"]
    total = F.aggregate("byte_counts", zero, lambda acc, n: acc + n)
    segment = F.when(F.col("tiled"), F.col("tile_w") * F.col("tile_h")).otherwise(area)
    none = F.coalesce(F.size("offsets"), F.lit(0)) <= 0
    status = (
        F.when(F.col("status") != "None", F.col("status"))
        .when(cfa_pattern(F.col("cfa")) == "Unknown", "UnsupportedPattern")
        .when(none | (F.size("offsets") != F.coalesce(F.size("byte_counts"), F.lit(0))), "BadImageData")
        .when(~F.col("compression").isin(1, 7), "NotImplemented")
        .when((F.col("compression") == 1) & ~F.col("bits").isin(8, 10, 12, 14, 16), "NotImplemented")
        .when((F.col("compression") == 1) & F.col("bits").isin(8, 16) & (total < size), "BadImageData")
        .when((F.col("compression") == 1) & F.col("bits").isin(10, 12, 14) & (unpacked != area * 2), "BadImageData")
        .when((F.col("compression") == 7) & (F.size("offsets") == 1) & (segment != area), "BadImageData")
        .otherwise("None")
    )
    return meta.withColumn("support", status)


def support_audit(meta: DataFrame) -> DataFrame:
    """How many frames can be decoded, and how many cannot for which reason (support_status)."""
    return support_status(meta).groupBy(F.col("support").alias("status")).agg(F.count("*").alias("n"))


def metadata_drift(frame_meta: DataFrame) -> DataFrame:
    """Fields that change within a clip."""
    long = frame_meta.select("clip", *[F.col(c).cast("long").alias(c) for c in ("width", "height", "compression", "bits")]).unpivot("clip", ["width", "height", "compression", "bits"], "field", "value")
    return long.groupBy("clip", "field").agg(F.count_distinct("value").alias("n_values")).where("n_values > 1")


def storage_report(segments: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """Segments of each clip, their bytes and the largest; with meta also the share of what its frames have decoded."""
    out = segments.groupBy("clip").agg(F.count("*").alias("n_segments"), F.sum("byte_count").alias("packed_bytes"), F.max("byte_count").alias("largest"), *([F.count_distinct("frame").alias("n_frames")] if meta is not None else []))
    if meta is None:
        return out
    decoded = padded_dimensions(meta).join(decoded_depth(meta), "clip").select("clip", (F.col("padded_w") * F.col("padded_h") * F.col("decoded_bits") / 8).alias("frame_bytes"))
    return out.join(decoded, "clip", "left").select("clip", "n_segments", "packed_bytes", "largest", (F.col("packed_bytes") / (F.col("n_frames") * F.col("frame_bytes"))).alias("ratio"))


def cfa_pattern(codes: Column) -> Column:
    """Name of a 2 x 2 colour filter array; None without one, Unknown for another."""
    known = {"RGGB": (0, 1, 1, 2), "BGGR": (2, 1, 1, 0), "GRBG": (1, 0, 2, 1), "GBRG": (1, 2, 0, 1)}
    out = F.when(F.size(codes) == 0, "None")
    for name, values in known.items():
        out = out.when(codes == F.array(*[F.lit(v) for v in values]), name)
    return out.otherwise("Unknown")


def metadata_report(meta: DataFrame, table: str | None = None) -> DataFrame:
    """clip, property, value: one row per present property, names split at capitals; table is the column of a curve."""
    shown = {c: F.col(c).cast("string") for c in meta.columns if c not in ("clip", table)}
    if table:
        shown[table] = F.when(F.coalesce(F.size(table), F.lit(0)) <= 0, "None").otherwise(F.concat(F.size(table).cast("string"), F.lit(" entries")))
    long = meta.select("clip", *[c.alias(n) for n, c in shown.items()]).unpivot("clip", list(shown), "property", "value")
    return long.where("value is not null").withColumn("property", F.regexp_replace("property", r"(\B[A-Z])", " $1"))

"""3-D look-up tables: reading, checks, interpolation."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"
# The look that goes with a log curve.
DEFAULT_LUTS = {"LogC3": "ARRI LogC3 to Rec. 709", "Log3G10": "RED Log3G10 to Rec. 709", "FilmGen5": "Blackmagic Film Gen. 5 to Rec. 709"}


def cube_lines(spark, paths: str | list[str]) -> DataFrame:
    """lut, line_no, line of `.cube` files, each read whole so that lines keep their order."""
    text = spark.read.option("wholetext", True).text(paths).select(F.col("_metadata.file_path").alias("lut"), "value")
    return text.select("lut", F.posexplode(F.split("value", "\n")).alias("line_no", "line"))


def read_cube(lines: DataFrame) -> DataFrame:
    """lut, title, size, status, ri, gi, bi, r, g, b for each row of three numbers, red fastest.

    Blank lines, comments and range keywords are passed over. The status is
    InvalidLutFile where the rows are not size cubed.
    """
    line = F.trim(F.regexp_replace("line", r"[\r\t]", " "))
    part = lambda pattern: F.nullif(F.regexp_extract("text", pattern, 1), F.lit(""))
    read = lines.withColumn("text", line).where("text <> '' and not startswith(text, '#')").withColumns(
        {
            "_size": part(r"^(?:LUT_3D_SIZE|3DLUTSIZE)\s+([0-9]+)$").cast("long"),
            "_title": part(r'^(?:TITLE|BMD_TITLE)\s+"?([^"]*)"?$'),
            "_row": F.col("text").rlike(f"^{NUMBER}\\s+{NUMBER}\\s+{NUMBER}$"),
        }
    )
    whole = Window.partitionBy("lut")
    read = read.withColumns({"size": F.max("_size").over(whole), "title": F.max("_title").over(whole), "_n": F.count_if("_row").over(whole)})
    rows = read.where("_row").withColumn("_i", F.row_number().over(whole.orderBy("line_no")).cast("long") - 1).withColumn("_v", F.split("text", r"\s+"))
    status = F.when(F.col("_n") == F.col("size") * F.col("size") * F.col("size"), "None").otherwise("InvalidLutFile")
    at = lambda step: F.expr(f"if(size > 0, _i div ({step}) % size, null)")
    return rows.select("lut", "title", "size", status.alias("status"), at("1").alias("ri"), at("size").alias("gi"), at("size * size").alias("bi"), *[F.col("_v")[i].cast("double").alias(c) for i, c in enumerate("rgb")])


def lut_audit(rows: DataFrame) -> DataFrame:
    """Per table: its rows, whether they are complete, and whether the neutral axis never falls."""
    axis = Window.partitionBy("lut").orderBy("ri")
    falls = F.lit(False)
    for c in "rgb":
        falls = falls | F.coalesce(F.col(c) < F.lag(c).over(axis), F.lit(False))
    neutral = rows.where("ri = gi and gi = bi").select("lut", falls.alias("_falls")).groupBy("lut").agg(F.max("_falls").alias("_falls"))
    counts = rows.groupBy("lut").agg(F.first("size").alias("size"), F.count("*").alias("n_rows"), F.first("status").alias("status"))
    return counts.join(neutral, "lut", "left").select("lut", "size", "n_rows", "status", (~F.coalesce("_falls", F.lit(False))).alias("monotone"))


def quantise_lut(rows: DataFrame, bits: int) -> DataFrame:
    """Truncated to the codes of 8 or 16 bits."""
    top = {8: 255.0, 16: 65535.0}[bits]
    return rows.withColumns({c: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(top), F.col(c) * top))).cast("long") for c in "rgb"})


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


#: Tables of at most so many points in all travel to the samples (24 bytes a point).
GATHER_POINTS = 1 << 20


def packed_tables(rows: DataFrame) -> dict:
    """lut -> (size, points by r, g, b as a float array); points that the rows lack are NaN. For tables of checked size."""
    found = rows.select("lut", *[F.col(c).cast("long").alias(c) for c in ("size", "ri", "gi", "bi")], *[F.col(c).cast("double").alias(c) for c in "rgb"]).where("lut is not null and size > 0").toArrow()
    out = {}
    lut = found.column("lut").to_pylist()
    number = {name: i for i, name in enumerate(dict.fromkeys(lut))}
    which = np.array([number[name] for name in lut], np.int64)
    size, *place = (found.column(c).to_numpy() for c in ("size", "ri", "gi", "bi"))
    colour = np.column_stack([found.column(c).to_numpy() for c in "rgb"])
    for name, i in number.items():
        of = which == i
        n = int(size[of][0])
        points = np.full((n, n, n, 3), np.nan)
        points[tuple(p[of] for p in place)] = colour[of]
        out[name] = n, points
    return out


def gather(points: np.ndarray, n: int, rgb: np.ndarray) -> np.ndarray:
    """Rows of r, g, b through one table: trilinear between texel centres, clamped to the edge. NaN stays NaN."""
    at = rgb * n - 0.5
    low = np.floor(np.nan_to_num(at, posinf=n, neginf=-1.0).clip(-1.0, n))
    part = (at - low)[:, :, None]
    place = [np.clip(low + k, 0, n - 1).astype(np.intp) for k in (0, 1)]
    out = np.zeros_like(rgb)
    for x in (0, 1):
        for y in (0, 1):
            for z in (0, 1):
                weight = (part[:, 0] if x else 1 - part[:, 0]) * (part[:, 1] if y else 1 - part[:, 1]) * (part[:, 2] if z else 1 - part[:, 2])
                out += weight * points[place[x][:, 0], place[y][:, 1], place[z][:, 2]]
    return out


def apply_lut(rgb: DataFrame, rows: DataFrame, most: int = GATHER_POINTS) -> DataFrame:
    """r, g, b through the table named by the column lut, trilinear between texel centres, clamped to the edge.

    rows: lut, size, ri, gi, bi, r, g, b, tables of any size and number. The points are
    counted first: up to `most` in all they travel to the samples, which do not move and
    are looked up by a gather in Arrow batches; beyond that samples are joined with the points
    (apply_large_lut). Both give the same: null where a channel or the name is null, the table
    is unknown, or a point that the sample needs is absent.
    """
    if rows.count() > most:
        return apply_large_lut(rgb, rows)
    shared = rgb.sparkSession.sparkContext.broadcast(packed_tables(rows))
    others = [f for f in rgb.schema.fields if f.name not in "rgb"]
    names = [f"own{i}" for i in range(len(others))]
    lut = names[[f.name for f in others].index("lut")]

    def looked_up(batches):
        for batch in batches:
            colour = np.column_stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in "rgb"]).astype(float)
            null = np.zeros(len(colour), bool)
            for c in "rgb":
                null |= batch.column(batch.schema.get_field_index(c)).is_null().to_numpy(zero_copy_only=False)
            out = np.full_like(colour, np.nan)
            coded = batch.column(batch.schema.get_field_index(lut)).dictionary_encode()
            which = coded.indices.fill_null(-1).to_numpy()
            absent = np.ones(len(colour), bool)
            for i, name in enumerate(coded.dictionary.to_pylist()):
                if name in shared.value:
                    of = np.flatnonzero((which == i) & ~null)
                    size, points = shared.value[name]
                    for k in range(0, len(of), 1 << 16):
                        part = of[k : k + (1 << 16)]
                        out[part] = gather(points, size, colour[part])
                    absent[of] = np.isnan(out[of]).any(1) & ~np.isnan(colour[of]).any(1)
            new = [pa.array(out[:, k], mask=absent) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in names] + new, names=[*names, *"rgb"])

    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, others)] + [T.StructField(c, T.DoubleType()) for c in "rgb"])
    moved = rgb.select(*[quoted(f.name).alias(n) for n, f in zip(names, others)], *[F.col(c).cast("double").alias(c) for c in "rgb"]).mapInArrow(looked_up, schema)
    return moved.select(*[F.col(n).alias(f.name) for n, f in zip(names, others)], *"rgb")


def apply_large_lut(rgb: DataFrame, rows: DataFrame) -> DataFrame:
    """The same for tables of any size, from their rows (lut, size, ri, gi, bi, r, g, b): an equi-join on lattice corners.

    Equal samples are looked up once; the table is never brought together in one place.
    A sample that needs an absent point has null channels.
    """
    colours = rgb.select("lut", "r", "g", "b").distinct().join(rows.select("lut", "size").distinct(), "lut")
    at = colours
    for c in "rgb":
        at = at.withColumn(f"_i{c}", F.floor(F.col(c) * F.col("size") - 0.5)).withColumn(f"_f{c}", F.col(c) * F.col("size") - 0.5 - F.col(f"_i{c}"))
        # the two neighbours on this axis; at the edge both are the same point
        sides = F.array(*[F.struct(F.greatest(F.lit(0), F.least(F.col("size") - 1, F.col(f"_i{c}") + step)).cast("long").alias("i"), weight.alias("w")) for step, weight in ((0, 1 - F.col(f"_f{c}")), (1, F.col(f"_f{c}")))])
        at = at.withColumn(f"_{c}", F.explode(sides))
    corners = at.select("lut", *[F.col(c).alias(f"_{c}") for c in "rgb"], *[F.col(f"_{c}.i").alias(f"{c}i") for c in "rgb"], (F.col("_r.w") * F.col("_g.w") * F.col("_b.w")).alias("_w"))
    points = rows.select("lut", *[F.col(f"{c}i").cast("long").alias(f"{c}i") for c in "rgb"], "r", "g", "b")
    mixed = corners.join(points, ["lut", "ri", "gi", "bi"]).groupBy("lut", "_r", "_g", "_b").agg(F.count("*").alias("_corners"), *[F.sum(F.col("_w") * F.col(c)).alias(f"_new{c}") for c in "rgb"]).where("_corners = 8")
    keys = rgb.withColumns({f"_{c}": F.col(c) for c in "rgb"}).drop("r", "g", "b")
    return keys.join(mixed, ["lut", "_r", "_g", "_b"], "left").select(*[quoted(c) for c in rgb.columns if c not in "rgb"], *[F.col(f"_new{c}").alias(c) for c in "rgb"])


def apply_lut_mono(values: DataFrame, rows: DataFrame, most: int = GATHER_POINTS) -> DataFrame:
    """The value v in all three channels, as apply_lut."""
    return apply_lut(values.withColumns({c: F.col("v") for c in "rgb"}), rows, most)


def default_lut(gamma: Column) -> Column:
    """Null for curves that are no log curves."""
    return F.create_map(*[F.lit(v) for pair in DEFAULT_LUTS.items() for v in pair])[gamma]

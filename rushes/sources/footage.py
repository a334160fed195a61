"""Footage tables derived from the given tables: frames, clips, files, headers, samples, events."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame_rows(spark, sf_dir):
    """clip, frame with duplicates."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("clip"), F.col("l_linenumber").cast("long").alias("frame"))


def frames(spark, sf_dir):
    return frame_rows(spark, sf_dir).distinct()


def clips(spark, sf_dir):
    number = F.lpad(F.col("clip").cast("string"), 6, "0")
    folder = F.concat(F.lit("/media/reel"), F.lpad((F.col("clip") % 20).cast("string"), 2, "0"), F.lit("/C"), number)
    return frame_rows(spark, sf_dir).groupBy("clip").agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame")).select("clip", folder.alias("folder"), F.concat(F.lit("C"), number).alias("name"), "first_frame", "last_frame")


def files(spark, sf_dir, mixed: bool = False):
    c = clips(spark, sf_dir)
    each = frames(spark, sf_dir).join(c, "clip").select(F.concat("folder", F.lit("/"), "name", F.lit("_"), F.lpad(F.col("frame").cast("string"), 6, "0"), F.lit(".dng")).alias("path"))
    out = (
        each.union(c.where("clip % 7 = 0").select(F.concat("folder", F.lit("/._"), "name", F.lit("_000001.dng"))))
        .union(c.where("clip % 3 = 0").select(F.concat("folder", F.lit("/"), "name", F.lit(".wav"))))
        .union(c.where("clip % 4 = 0").select(F.concat("folder", F.lit("/mic1.wav"))))
        .union(c.where("clip % 4 = 0").select(F.concat("folder", F.lit("/mic2.wav"))))
    )
    if mixed:
        out = out.union(c.where("clip % 50 = 0").select(F.concat("folder", F.lit("/"), "name", F.lit("_"), (F.col("last_frame") + 1).cast("string"), F.lit(".dng"))))
    return out


def _bcd(e: str) -> str:
    return f"(cast(floor(({e})/10) as bigint)*16+({e})%10)"


CLIP_META = f"""select o_orderkey as clip,
  case o_orderkey%5 when 0 then 24000 when 1 then 25 when 2 then 30000 when 3 then 60000 end as rate_num,
  case o_orderkey%5 when 0 then 1001 when 1 then 1 when 2 then 1001 when 3 then 1001 end as rate_den,
  {_bcd("4+o_orderkey%20")}+case when o_orderkey%5 in (2,3) then 64 else 0 end as tc0,
  {_bcd("(o_orderkey*13)%60")} as tc1, {_bcd("(o_orderkey*7)%60")} as tc2, {_bcd("o_orderkey%24")} as tc3,
  o_orderkey%8 as orientation, 1920+o_orderkey%64 as width, 1080+o_orderkey%32 as height,
  case when o_orderkey%2=0 then 256 end as tile_w, case when o_orderkey%2=0 then 256 end as tile_h,
  case o_orderkey%6 when 0 then 8 when 1 then 10 when 2 then 12 when 3 then 14 when 4 then 16 else 11 end as bits,
  case o_orderkey%4 when 1 then 7 when 3 then 8 else 1 end as compression,
  case when o_orderkey%3=0 then 64+o_orderkey%10 end as black_level, case when o_orderkey%3=1 then 1023 end as white_level,
  case when o_orderkey%4<>0 then (o_orderkey%9-4)/cast(2 as double) end as baseline_exposure,
  o_orderkey%4 as cfa_id,
  case when o_orderkey%3=2 then 8 end as crop_x, case when o_orderkey%3=2 then 1801 end as crop_w, case when o_orderkey%3=2 then 1001 end as crop_h
from orders"""


def clip_meta(spark, sf_dir):
    return spark.sql(CLIP_META.replace("from orders", "from {orders}"), orders=table(spark, sf_dir, "orders"))


#: Further tags of a clip's first frame: pixel aspect, active area, camera, pattern, segments; some of them faulty.
TAG_META = f"""select *, case when clip%7=0 then 2 when clip%7=1 then 3 end as scale_num,
  case when clip%5=1 then 4 end as area_top, case when clip%3=0 then 'Cam '||cast(clip%4 as {{text}}) end as model,
  case when clip%23=0 then -1 when clip%19=0 then 4 else cfa_id end as pattern,
  case when clip%13=0 then 0 when tile_w is not null then cast(ceil(width/256.0)*ceil(height/256.0) as int) else 1+cast(clip%3 as int) end as n_segments,
  case when tile_w is not null then 8192*bits else cast(floor(width*height*bits/8.0/(1+clip%3)) as bigint) end as segment_bytes,
  case when clip%11=0 then 1 else 0 end as n_lost, case when clip%17=0 then 9 else 0 end as cut_bytes
from ({CLIP_META})"""
# The pattern arrays by number; none is known of number 4, number -1 is no pattern.
PATTERNS = {-1: [], 0: [0, 1, 1, 2], 1: [2, 1, 1, 0], 2: [1, 0, 2, 1], 3: [1, 2, 0, 1], 4: [0, 1, 2, 1]}


def tag_meta(spark, sf_dir):
    return spark.sql(TAG_META.format(text="string").replace("from orders", "from {orders}"), orders=table(spark, sf_dir, "orders"))


def header_files(spark, sf_dir):
    """clip, path, content: a header file of each clip's tags. Types, byte order, previews and the directory's place vary with the clip."""

    def written(batches):
        import pyarrow as pa

        from rushes.sources import tiff as t

        for batch in batches:
            contents = []
            for r in batch.to_pylist():
                k = r["clip"]
                order = ">" if k % 2 else "<"
                whole = [t.SHORT, t.LONG][k % 3 == 0]
                image = {254: (t.LONG, [0]), 256: (whole, [r["width"]]), 257: (whole, [r["height"]]), 258: (t.SHORT, [r["bits"]]), 259: (t.SHORT, [r["compression"]]), 262: (t.SHORT, [34892 if r["pattern"] < 0 else 32803])}
                if r["pattern"] >= 0:
                    image |= {33421: (t.SHORT, [2, 2]), 33422: (t.BYTE if k % 2 else t.SHORT, PATTERNS[r["pattern"]])}
                if r["tile_w"]:
                    image |= {322: (t.SHORT, [r["tile_w"]]), 323: (t.LONG, [r["tile_h"]])}
                if r["n_segments"]:
                    sizes = [r["segment_bytes"]] * (r["n_segments"] - r["n_lost"])
                    if sizes:
                        sizes[-1] -= r["cut_bytes"]
                    places = [8 + i * r["segment_bytes"] for i in range(r["n_segments"])]
                    tags = (324, 325) if r["tile_w"] else (273, 279)
                    image |= {tags[0]: (t.LONG, places)} | ({tags[1]: (t.LONG, sizes)} if sizes else {})
                if r["black_level"] is not None:
                    image[50714] = (t.RATIONAL, [(2 * r["black_level"] + 1, 2)]) if k % 2 else (t.SHORT, [r["black_level"]])
                if r["white_level"] is not None:
                    image[50717] = (whole, [r["white_level"]])
                first = {274: (t.SHORT, [r["orientation"]]), 51043: (t.BYTE, [r["tc0"], r["tc1"], r["tc2"], r["tc3"], 0, 0, 0, 0])}
                if r["rate_num"] is not None:
                    first[51044] = (t.RATIONAL if k % 2 else t.SIGNED_RATIONAL, [(r["rate_num"], r["rate_den"])])
                if r["baseline_exposure"] is not None:
                    first[50730] = (t.SIGNED_RATIONAL, [(int(r["baseline_exposure"] * 2), 2)])
                if r["scale_num"] is not None:
                    first[50718] = (t.RATIONAL, [(r["scale_num"], 2), (1, 1)])
                if r["area_top"] is not None:
                    first[50829] = (whole, [r["area_top"], 8, r["height"] - 4, r["width"] - 8])
                if r["model"] is not None:
                    first[50708] = (t.TEXT, r["model"])
                if r["crop_w"] is not None:
                    kind = [t.RATIONAL, t.SHORT, t.LONG][k % 7 % 3]
                    pair = lambda a, b: [(2 * a + 1, 2), (2 * b + 1, 2)] if kind == t.RATIONAL else [a, b]
                    first |= {50719: (kind, pair(r["crop_x"], 0)), 50720: (kind, pair(r["crop_w"], r["crop_h"]))}
                first |= {50721: (t.SIGNED_RATIONAL, [(k % 10 + 70, 100), (-1, 5), (0, 7), (-2, 5), (6, 5), (1, 5), (-1, 10), (1, 5), (3, 0)]), 50778: (t.SHORT, [17 + k % 2 * 4])}
                first[50728] = (t.SHORT, [1, 1, 2]) if k % 4 == 0 else (t.RATIONAL, [(1, 2), (1, 1), (5, 8)])
                if k % 2 == 0:
                    first[50712] = (t.SHORT, [i * i for i in range(k % 16)] or [0])
                if k % 4 == 1:  # a preview stands first
                    contents.append(t.file_bytes(image, order, {**first, 254: (t.LONG, [1]), 256: (t.SHORT, [160]), 257: (t.SHORT, [120])}))
                else:
                    contents.append(t.file_bytes(image | first, order, image=bytes(k % 3 * 5000)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f"/media/C{k:06d}.dng" for k in batch.column(0).to_pylist()]), pa.array(contents, pa.binary())], names=["clip", "path", "content"])

    meta = tag_meta(spark, sf_dir)
    # a small table lies in one task, and a header is some Python work
    return meta.select("clip", *[c for c in meta.columns if c != "clip"]).repartition("clip").mapInArrow(written, "clip long, path string, content binary")


def frame_meta(spark, sf_dir):
    f, m = frames(spark, sf_dir), clip_meta(spark, sf_dir)
    return f.join(m, "clip").select("clip", "frame", "width", "height", "compression", F.expr("case when (clip*7+frame)%97=0 then 12 else bits end").alias("bits"), F.expr("frame+case when (clip+frame)%53=0 then 5 else 0 end").alias("tc_frame"))


def rgb(spark, sf_dir):
    c = lambda name, f: f.alias(name)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("clip"), F.col("l_linenumber").cast("long").alias("frame"), F.col("l_partkey").alias("px"), c("r", F.col("l_quantity") / 50), c("g", F.abs("l_discount") * 10), c("b", F.abs("l_tax") * 12.5))


def pixels(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.posexplode("embedding").alias("i", "e"))
    return e.select("frame", F.expr("cast(floor(i/8) as bigint)").alias("y"), F.expr("cast(i%8 as bigint)").alias("x"), F.expr("cast(floor(least(greatest(cast(e as double)+cast(0.6 as double),cast(0 as double)),cast(1 as double))*65535) as bigint)").alias("v"))


def history(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    path = F.concat(F.lit("/media/C"), F.lpad((F.col("event_id") % 37).cast("string"), 6, "0"))
    return e.select("user_id", path.alias("path"), F.when(F.col("event_id") % 50 == 0, "").otherwise("sequence").alias("type"), F.col("ts").alias("opened"), "event_id")


def segments(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("clip"), F.col("l_linenumber").cast("long").alias("frame"), F.col("l_suppkey").alias("seg"), F.floor("l_extendedprice").cast("long").alias("byte_count"))


def profiles(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("clip"), (F.lit(0.25) + (k % 100) * 0.002).alias("wx"), (F.lit(0.28) + (k % 90) * 0.0015).alias("wy"))

"""Recently opened clips."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _latest(history: DataFrame, *keys: str) -> DataFrame:
    last = F.max(F.struct("opened", "event_id", "type")).alias("last")
    return history.where("path <> '' and type <> ''").groupBy(*keys, "path").agg(last).select(*keys, "path", "last.type", "last.opened", "last.event_id")


def recent_clips(history: DataFrame, k: int = 10) -> DataFrame:
    """The k paths opened last, once each."""
    return _latest(history).orderBy(F.desc("opened"), F.desc("event_id")).limit(k)


def recent_clips_by_user(history: DataFrame, k: int = 10) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy(F.desc("opened"), F.desc("event_id"))
    return _latest(history, "user_id").withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def favourite_flags(paths: DataFrame, favourites: DataFrame) -> DataFrame:
    return paths.distinct().join(favourites.select("path").distinct().withColumn("is_favourite", F.lit(True)), "path", "left").fillna(False, ["is_favourite"])


ENTRIES = "array<struct<Path:string,Type:string,LastOpened:timestamp_ntz>>"


def write_history(history: DataFrame, k: int = 10) -> DataFrame:
    """user_id, json: each user's k latest entries, newest first."""
    recent = recent_clips_by_user(history, k)
    entry = F.struct("rank", F.struct(F.col("path").alias("Path"), F.col("type").alias("Type"), F.col("opened").alias("LastOpened")).alias("entry"))
    # at most k entries a user
    return recent.groupBy("user_id").agg(F.sort_array(F.collect_list(entry)).alias("all")).select("user_id", F.to_json("all.entry", {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}).alias("json"))


def read_history(files: DataFrame) -> DataFrame:
    """user_id, path, type, opened; entries without path or type, and text that is no JSON, go."""
    entries = F.from_json("json", ENTRIES, {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"})
    rows = files.select("user_id", F.explode(entries).alias("e")).select("user_id", F.col("e.Path").alias("path"), F.col("e.Type").alias("type"), F.col("e.LastOpened").alias("opened"))
    return rows.where("path <> '' and type <> ''")

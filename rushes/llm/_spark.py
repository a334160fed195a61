"""What the operators share on the driver: sizes, buckets, tables in the shared folder."""

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import tidy


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or on a local master one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp")))
    return spark.sparkContext.getCheckpointDir()


def stored(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it again: what follows no longer depends on how it was made."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}.parquet"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def column(name: str):
    """The column of that name, whatever signs the name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def own_fields(docs: DataFrame, replaced) -> list[T.StructField]:
    """The fields of docs that are not replaced."""
    return [f for f in docs.schema.fields if f.name not in set(replaced)]


def map_texts(docs: DataFrame, text_column: str, run, outputs: str, keep_text: bool = False) -> DataFrame:
    """docs with new columns in place of the text, or beside it. run is a task function over the text, named _whole, and other columns, which it passes on.

    Own columns travel under names of their own, so none can clash; one named as a new column gives way to it.
    """
    made = T.StructType.fromDDL(outputs)
    own = own_fields(docs, [*made.names, *([] if keep_text else [text_column])])
    schema = T.StructType([T.StructField(f"own{i}", f.dataType) for i, f in enumerate(own)] + made.fields)
    out = docs.select(*[column(f.name).alias(f"own{i}") for i, f in enumerate(own)], column(text_column).alias("_whole")).mapInArrow(tidy(run), schema)
    return out.select(*[F.col(f"own{i}").alias(f.name) for i, f in enumerate(own)], *made.names)


def text_bytes(docs: DataFrame, name: str) -> int:
    """Bytes of all texts; one native pass over the column."""
    return docs.agg(F.sum(F.octet_length(column(name)))).first()[0] or 0


def buckets(spark: SparkSession, size: int, each: int) -> int:
    """How many buckets keep each near the given size, and every shuffle task busy."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each), 1)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")

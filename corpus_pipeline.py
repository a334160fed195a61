"""From raw documents to packed training sequences, stage by stage."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rushes.llm._spark import column, stored
from rushes.llm.jaccard_join import BROADCAST_ROWS, link_components
from rushes.llm.line_dedup import dedup_lines
from rushes.llm.packing import pack_documents
from rushes.llm.quality_classifier import fit_quality, score_quality
from rushes.llm.queries import tokenizer_file
from rushes.llm.substring_dedup import dedup_substrings


#: Rows of an Arrow batch between Spark and Python: a batch of texts lies in the JVM, its buffers and the worker at once.
BATCH_ROWS = 1000


def _small_batches(spark: SparkSession):
    """From now on the session sends Python no larger batches; results don't depend on them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(spark.conf.get(name))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def _numbered(docs: DataFrame, *used: str) -> DataFrame:
    """docs with every column but those used under a name of its own, so that no operator's new column can clash."""
    return docs.select(*[column(c).alias(c if c in used else f"own{i}") for i, c in enumerate(docs.columns)])


def _named(out: DataFrame, docs: DataFrame, *used: str, text: str | None = None) -> DataFrame:
    """The columns of docs under their own names again; with another text, if named, and its length."""
    new = {c: F.col(c) if c in used else F.col(f"own{i}") for i, c in enumerate(docs.columns)}
    if text:
        new["text"] = F.col(text)
        if "n_chars" in new:
            new["n_chars"] = F.when(F.col(text).isNotNull(), F.length(text)).cast(docs.schema["n_chars"].dataType)
    return out.select(*[c.alias(n) for n, c in new.items()])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null and empty texts are scored as the empty text, each row by itself; without labels all get one half and stay."""
    _small_batches(spark)
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_quality(_numbered(docs, "text"), model, keep_text=True)
    return _named(scored.where("_score >= 0.3"), docs, "text")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten documents or more go; documents stay. Null texts stay null, empty ones empty; each row counts as a document."""
    _small_batches(spark)
    out = dedup_lines(_numbered(docs, "doc_id", "text"), min_docs=10, digests=False)
    return _named(out, docs, "doc_id", text="_kept")


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates (five-word shingles, similarity 0.8) one row stays.

    Rows are told apart by 64 bits of a hash of doc_id and text, not by doc_id alone. Of
    linked rows the one with the smallest doc_id stays, a null one last, then the
    one with the smallest hash; of rows that agree in both, any one. Rows without words stay.
    """
    _small_batches(spark)
    keyed = _numbered(docs, "doc_id", "text").withColumn("_row_key", F.xxhash64("doc_id", "text"))
    linked = stored(link_components(keyed, id_column="_row_key", gram=5, percent=80).where("n_shingles > 0").select(F.col("id").alias("_row_key"), "component_id"))
    many = linked.groupBy("component_id").agg(F.count("*").alias("_n")).where("_n > 1").select("component_id")
    rows = linked.join(many, "component_id").groupBy("_row_key", "component_id").agg(F.count("*").alias("_copies"))
    named = keyed.select("_row_key", "doc_id").join(rows, "_row_key").select("component_id", "_row_key", "_copies", F.struct(F.col("doc_id").isNull(), "doc_id", "_row_key").alias("_order"))
    first = named.groupBy("component_id").agg(F.min("_order")["_row_key"].alias("_first"))
    judged = stored(rows.join(first, "component_id").select("_row_key", (F.col("_row_key") == F.col("_first")).alias("_stays"), "_copies"))
    gone, again = judged.where("not _stays").select("_row_key"), judged.where("_stays and _copies > 1").select("_row_key")
    gone, again = (F.broadcast(x) if x.count() <= BROADCAST_ROWS else x for x in (gone, again))
    left = keyed.join(gone, "_row_key", "left_anti")
    once = left.join(again, "_row_key", "left_semi").dropDuplicates(["_row_key"])
    return _named(left.join(again, "_row_key", "left_anti").unionByName(once), docs, "doc_id", "text")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in repeated windows of 20 words go; a text that loses none keeps its white space.

    Null texts stay null, empty ones empty. Rows equal in id and text count as one document.
    """
    _small_batches(spark)
    out = dedup_substrings(_numbered(docs, "doc_id", "text"), window=20, joined=False)
    return _named(out, docs, "doc_id", text="_kept")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens: the pieces and their places. Null and empty texts are one end token; each row is packed."""
    _small_batches(spark)
    return pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("quality classifier", quality_classifier), ("line dedup", line_dedup), ("n-gram Jaccard join", jaccard_join), ("substring dedup", substring_dedup), ("packing", packing)]

#: Neither a trained classifier nor tokenization can be said in SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

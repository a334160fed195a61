"""Connected components of a table of links, by contraction to minimum labels."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import stored


def components(links: DataFrame) -> DataFrame:
    """(node, label) for each node of links (a, b): label is the least node of its component.

    Each round a node points to the least of its neighbours and itself, then to where
    that node points; the links between what nodes point to are the next round's, so
    they become fewer. Links of a node to its pointer keep the pointers connected.
    Every round is written to the shared folder; it ends when no links are left.
    """
    edges = stored(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rounds = []
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("next"))
        far = least.select(F.col("node").alias("next"), F.col("next").alias("label"))
        step = stored(least.join(far, "next").select("node", "label"))
        rounds.append(step)
        ends = [step.select(F.col("node").alias(c), F.col("label").alias(f"_{c}")) for c in "ab"]
        moved = edges.join(ends[0], "a").join(ends[1], "b").where("_a <> _b")
        edges = stored(moved.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct())
        if edges.limit(1).count() == 0:
            break
    labels = rounds[0]
    for step in rounds[1:]:
        labels = labels.join(step.select(F.col("node").alias("label"), F.col("label").alias("_next")), "label", "left").select("node", F.coalesce("_next", "label").alias("label"))
    return stored(labels)

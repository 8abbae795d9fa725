"""Connected components of an edge table by hooking to the least node within two hops.

Every join reads stored tables, so both sides are dealt by the join itself and a skewed side can be
split at run time; every aggregation combines before its shuffle. Nothing reaches the driver but counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import discard, save


def relabelled(df: DataFrame, column: str, parent: DataFrame) -> DataFrame:
    """``column`` replaced by its parent, where it has one."""
    p = parent.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
    return df.join(p.hint("merge"), F.col(column) == F.col("_n"), "left").withColumn(column, F.coalesce("_l", column)).drop("_n", "_l")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node in ``edges(a, b)``: label is the least node of its component."""
    spark = edges.sparkSession
    left = save(spark, edges.select("a", "b").where("a <> b").distinct(), "edges")
    labels = None
    # What a round has stored goes when the next one is whole.
    while not left.isEmpty():
        both = left.select(F.col("a").alias("node"), F.col("b").alias("to")).unionAll(left.select(F.col("b").alias("node"), F.col("a").alias("to")))
        near = save(spark, both.groupBy("node").agg(F.least(F.min("to"), F.col("node")).alias("label")), "nearest")
        # Two hops at once: the least of what the neighbours have seen, so a star is done in one round.
        far = relabelled(both, "to", near).groupBy("node").agg(F.least(F.min("to"), F.col("node")).alias("label"))
        parent = save(spark, far, "parent")
        before, old = labels, left
        labels = parent if before is None else save(spark, relabelled(before, "label", parent), "labels")
        left = save(spark, relabelled(relabelled(old, "a", parent), "b", parent).where("a <> b").distinct(), "edges")
        discard(spark, old, near, *([] if before is None else [before, parent]))
    if labels is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels

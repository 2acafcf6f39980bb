"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate.llm.common import materialize, remove


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One large-star or small-star step: neighbours move to the least one.

    The least neighbour of a node is a pre-aggregated minimum and comes back by
    a join, so a node with very many edges is never gathered in one task.
    """
    if large:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    moved = near.join(least, near["a"] == least["u"])
    if large:
        moved = moved.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of an edge table (a long, b long); the label
    is the least node of the component. Alternating large-star and small-star
    steps; every round is a written table."""

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = mark(now)
    while True:
        following = materialize(_star(_star(now, True), False), "edges")
        after = mark(following)
        remove(now)
        now = following
        if after == before:
            break
        before = after
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())

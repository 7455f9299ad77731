"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.llm.common import written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step on links (a > b): each node hangs its larger (large) or all smaller neighbours on its least one."""
    if large:
        near = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(
            links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    else:
        near = links.select(F.col("a").alias("node"), F.col("b").alias("other"))
    least = near.groupBy("node").agg(F.min("other").alias("m")).withColumn("m", F.least("node", "m"))
    joined = near.join(least, "node")
    if large:
        out = joined.where(F.col("other") > F.col("node")).select(F.col("other").alias("a"), F.col("m").alias("b"))
    else:
        # a node's own link to its least neighbour is the row other = m
        out = joined.select(
            F.when(F.col("other") == F.col("m"), F.col("node")).otherwise(F.col("other")).alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, root) for every linked node, root being the least node of its component.

    Links may repeat and come in either direction; both ends are integers. The links are written to
    the shared folder after each round, of which there are about log2 of the longest chain. Each
    step is a grouped minimum (combined before the shuffle) and an equi-join that Spark may split
    where a node has very many links. Null ends and self-links are no links.
    """
    state = links.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b")).where(
        F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right))).distinct()
    state, before = written(state, "links"), None
    while True:
        # equal sets of links have equal counts and sums: the steps only ever lower b
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        state = written(_star(_star(state, True), False), "links")
    return state.select(F.col("a").alias("node"), F.col("b").alias("root"))

"""Connected components of a link table, in alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinmatch.llm.common import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = cut(edges.groupBy("u").agg(F.min("v").alias("m")))
    hooked = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hooked.unionByName(least.withColumnRenamed("m", "v")).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node it reaches) for every node that isn't itself its component.

    Each step is partial aggregations, checkpointed, and joins on node ids of plain exchanges, so Spark splits a node with very many links. The number of steps grows
    with the logarithm of the size; each step's table is checkpointed, so a lost executor costs one step at most.
    """
    edges = cut(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = None
    while True:
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == before or now[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now
        edges = cut(_small_star(cut(_large_star(edges))))


def by_id(rows: DataFrame, key: str, *more: str) -> DataFrame:
    """For tables whose ids repeat: rows (key, component, more) of nodes that aren't ids.

    Rows of one id are linked, and a component is named by its smallest id; a row without an id has none. Returns key, more, component_id.
    """
    rows = cut(rows.select(key, *more, F.col("component").alias("_node")))
    named = rows.where(F.col(key).isNotNull())
    first = named.groupBy(key).agg(F.min("_node").alias("a"))
    joined = components(named.join(first, key).select("a", F.col("_node").alias("b")))
    topped = rows.join(joined.select(F.col("node").alias("_node"), "component"), "_node", "left").withColumn("_top", F.coalesce("component", "_node"))
    least = topped.where(F.col(key).isNotNull()).groupBy("_top").agg(F.min(key).alias("component_id"))
    return topped.join(least, "_top", "left").select(key, *more, F.when(F.col(key).isNotNull(), F.col("component_id")).alias("component_id"))

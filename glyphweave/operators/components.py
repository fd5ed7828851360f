"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphweave.workdir import Work


def _apart(low: DataFrame) -> DataFrame:
    """The same rows behind a shuffle of their own: only then is the join with a hub's many edges split where it is skewed."""
    return low.repartition(F.xxhash64("u"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked with the smallest of u and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _apart(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked with the smallest of them; edges come as u > v."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(_apart(low), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(spark: SparkSession, edges: DataFrame, work: Work | None = None, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node with an edge; a component is named by its smallest node.

    ``edges`` has two columns of ids of one orderable type; order, repeats, loops and rows with a null
    do not matter. Aggregations combine before they shuffle, and joins have nothing else in their stage, so
    a hub of many edges is split between tasks; each round is written to the shared folder, and nothing is collected.
    Isolated nodes are not returned. An empty table gives an empty result.
    """
    work = work or Work(spark, "components")
    a, b = edges.columns[:2]
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v")))
    now, before = work.write(pairs.distinct(), "edges"), None
    for _ in range(max_rounds):
        sums = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if sums.n == 0 or (sums.n, sums.s) == before:
            break
        before = (sums.n, sums.s)
        now = work.write(_small_star(_large_star(now)), "edges")
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    ).distinct()

"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to its smallest one (itself included)."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours and itself to the smallest of them (u > v in every edge)."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    lower = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return lower.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, label: str = "stars", most: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected edges (u, v); the root is a component's smallest node.

    Self-loops and edges with a null end add nothing. Every round is written into the shared folder, so a
    lost executor costs one round. Hot nodes meet in joins only (AQE splits them), after partial minima.
    """
    spark = edges.sparkSession
    first = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, path = materialise(first, label)
    seen = None
    for _ in range(most):
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == seen or not mark.n:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = mark
        new, to = materialise(_small_star(_large_star(now)), label)
        drop_path(spark, path)
        now, path = new, to
    raise RuntimeError(f"no fixed point after {most} rounds")

"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from grainmill.llm.common import gathered
from grainmill.session import stage, stage_counted

MAX_ROUNDS = 60  # enough for paths of any length that fits a table; more is an error


def _stars(edges: DataFrame, both: bool, n: int) -> DataFrame:
    """Link the neighbours of each node to the smallest among them and itself; larger neighbours if ``both`` sides count."""
    near = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if both:
        near = near.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = gathered(near.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), n)
    met = near.join(least, "u")
    if both:
        out = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    return gathered(out.where("a <> b").distinct(), n)


def components(links: DataFrame, n: int, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node in ``links``, some ``n`` rows; the component is the smallest node that can be reached."""
    edges = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct()
    edges, n = stage_counted(gathered(edges, n), "edges")
    seen = None
    for _ in range(MAX_ROUNDS):
        written = Observation()
        edges = stage(_stars(_stars(edges, True, n), False, n).observe(
            written, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")), "stars")
        mark = written.get
        if mark == seen:
            roots = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
        seen = mark
    raise RuntimeError("components did not settle")

"""Exact deduplication by sorting on content.

Splitters drawn from a bounded sample cut the order of (first characters, salt) into ranges of about equal row
counts. One shuffle brings each range together, an external sort puts equal texts side by side, and every row is
compared with its neighbour in full. The salt comes from the identifier, so a text that fills many ranges is spread
over them; its pieces are runs at the edge of ranges, one small row each, and are merged by digest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from grainmill.llm.common import hidden, shuffle_partitions
from grainmill.session import stage

PREFIX = 64  # characters of a text that splitters look at
SAMPLE_PER_RANGE = 32  # rows sampled for each range
MAX_RANGES = 4096  # bounds the sample that the driver sees to 131,072 prefixes


def splitters(rows: DataFrame, prefix: str, salt: str, ranges: int) -> list[tuple[str, int]]:
    """At most ``ranges - 1`` cut points from the rows with the smallest salts, a sample of fixed size."""
    sample = rows.select(prefix, salt).orderBy(F.xxhash64(salt, F.lit(17))).limit(SAMPLE_PER_RANGE * ranges).collect()
    keys = sorted((r[0], r[1]) for r in sample)
    cuts = {keys[i * len(keys) // ranges] for i in range(1, ranges)} if keys else set()
    return sorted(cuts)


def range_of(prefix: Column, salt: Column, cuts: list[tuple[str, int]]) -> tuple[Column, Column]:
    """Number of cut points at or below the key, found in two steps, and whether a cut of this range has its prefix."""
    if not cuts:
        return F.lit(0), F.lit(False)
    step = max(1, int(len(cuts) ** 0.5))
    names, salts = F.lit([c[0] for c in cuts]), F.lit([c[1] for c in cuts])
    coarse = cuts[step - 1 :: step]

    def below(p: Column, s: Column) -> Column:
        return (p < prefix) | ((p == prefix) & (s <= salt))

    base = F.lit(0)
    if coarse:
        cs = F.lit([c[1] for c in coarse])
        base = F.size(F.filter(F.lit([c[0] for c in coarse]), lambda p, i: below(p, F.get(cs, i)))) * step
    fine = F.filter(F.slice(names, base + 1, F.lit(step)), lambda p, i: below(p, F.get(salts, base + i)))
    at = base + F.size(fine)
    shared = F.coalesce(F.get(names, at - 1) == prefix, F.lit(False)) | F.coalesce(F.get(names, at) == prefix, F.lit(False))
    return at, shared


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    normalise: Callable[[Column], Column] = lambda c: c,
    ranges: int | None = None,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    ``keep`` is 'smallest' or 'largest' identifier. A NULL text counts as empty. A NULL identifier loses against any
    other; a group without identifiers has keep_id NULL. Of repeated rows (same identifier, same text) one is kept.
    An empty table gives no rows. Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    ranges = min(ranges or shuffle_partitions(spark), MAX_RANGES)
    rows = docs.select(
        F.col(id_col).alias("id"), normalise(F.coalesce(F.col(text_col), F.lit(""))).alias("text")
    ).select("id", "text", F.substring("text", 1, PREFIX).alias("prefix"), F.xxhash64("id", F.lit(3)).alias("salt"))
    at, shared = range_of(F.col("prefix"), F.col("salt"), splitters(rows, "prefix", "salt", ranges))
    rows = rows.select("id", "text", at.alias("range"), shared.alias("open"))

    best = F.col("id").asc_nulls_last() if keep == "smallest" else F.col("id").desc_nulls_last()
    by_content = Window.partitionBy("range").orderBy("text")
    first = ~F.col("text").eqNullSafe(F.lag("text").over(by_content))
    runs = (
        rows.select("*", F.when(first, 1).otherwise(0).alias("first"))
        .select("id", "range", "open", F.sha2("text", 256).alias("sha"),
                F.sum("first").over(by_content.rowsBetween(Window.unboundedPreceding, 0)).alias("run"))
    )
    within = Window.partitionBy("range", "run")
    ranked = runs.select(
        "*", F.row_number().over(within.orderBy(best)).alias("rank"),
        F.first("id").over(within.orderBy(best).rowsBetween(Window.unboundedPreceding, 0)).alias("keep"),
        F.count(F.lit(1)).over(within).alias("n"),
    )
    ranked = stage(ranked, "content-runs")

    pieces = ranked.where("open and rank = 1").select("range", "run", "sha", "keep", "n")
    same = Window.partitionBy("sha")
    order = F.col("keep").asc_nulls_last() if keep == "smallest" else F.col("keep").desc_nulls_last()
    merged = pieces.select(
        "range", "run",
        F.row_number().over(same.orderBy(order, "range", "run")).alias("piece"),
        F.first("keep").over(same.orderBy(order, "range", "run")).alias("keep_all"),
        F.sum("n").over(same).alias("n_all"),
    )
    return ranked.join(merged, ["range", "run"], "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("piece").isNull(), F.col("keep")).otherwise(F.col("keep_all")).alias("keep_id"),
        F.coalesce("n_all", "n").cast("bigint").alias("group_size"),
        ((F.col("rank") == 1) & F.coalesce(F.col("piece") == 1, F.lit(True))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, all columns; see :func:`exact_groups`. Rows equal in every column count once."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    normalise = options.get("normalise", lambda c: c)
    key, sha = hidden(docs, "id", "sha")
    stay = exact_groups(docs, **options).where("kept").select(F.col(id_col).alias(key), F.col("text_sha256").alias(sha))
    keyed = docs.withColumn(sha, F.sha2(normalise(F.coalesce(F.col(text_col), F.lit(""))), 256))
    met = keyed.join(
        stay.withColumnRenamed(sha, f"{sha}2"),
        keyed[id_col].eqNullSafe(F.col(key)) & (F.col(sha) == F.col(f"{sha}2")), "left_semi",
    )
    return met.dropDuplicates([id_col, sha]).drop(sha)

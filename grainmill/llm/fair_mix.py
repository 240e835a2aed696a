"""Mixing sources to target weights by weighted fair queueing.

Each source is put in a seeded random order and served round by round. A document's virtual finish time is the number
of words its source has been served once it is through, divided by the source's target. All documents are sorted by
that time over all sources, and the mix ends where its words reach the total budget.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from grainmill.llm.common import hidden, words
from grainmill.session import stage

ROUNDS = 3  # a source is served at most so many times
ORDER_DIGITS = 3  # hex digits of the order hash that make a bucket: 4,096 buckets a source
TIME_BINS = 1 << 16  # bins of virtual time for each round


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), share: float = 1.0) -> DataFrame:
    """``sizes`` (source, source_size) plus weight and target.

    Sources by code point, NULL last, take the weights in turn and share ``share`` of all words. A target stops at
    ROUNDS times its source; the excess goes to the others by weight until none is above. That fixed point is found
    in one pass: with sources ordered by size per weight, the first ones are full and the rest split what is left.
    The table has a row per source, so its windows are small.
    """
    w = F.element_at(F.lit(list(weights)), F.col("place") % len(weights) + 1).cast("double")
    named = Window.orderBy(F.col("source").asc_nulls_last())
    placed = sizes.select("source", "source_size", (F.row_number().over(named) - 1).alias("place"))
    cap = F.col("source_size") * F.lit(float(ROUNDS))
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), "place")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    levels = placed.withColumn("weight", w).withColumn(
        "level", (total - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    )
    full = cap <= F.col("level") * F.col("weight")
    first_open = F.min(F.when(~full, F.struct(F.col("source_size") / F.col("weight"), F.col("place"), F.col("level"))))
    level = first_open.over(Window.partitionBy())["level"]
    return levels.withColumn("open_level", level).select(
        "source", "source_size", "weight",
        F.when(F.col("open_level").isNull(), cap)
        .otherwise(F.least(cap, F.col("open_level") * F.col("weight"))).alias("target"),
    )


def _sized(docs: DataFrame, source_col: str, id_col: str, text_col: str, seed: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"),
        F.size(words(F.col(text_col))).cast("bigint").alias("size"),
        F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("key"),
        F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("digest"),
        F.struct(*docs.columns).alias("doc"),
    )


def _served(sized: DataFrame, offsets: DataFrame) -> DataFrame:
    """Words of the source served in the first round once a row is through."""
    by_order = Window.partitionBy("source", "bucket").orderBy("key", F.col("id").asc_nulls_last(), "digest")
    return (
        sized.withColumn("bucket", F.substring("key", 1, ORDER_DIGITS))
        .join(offsets, F.col("source").eqNullSafe(F.col("s1")) & (F.col("bucket") == F.col("b1")))
        .withColumn(
            "served", F.col("offset") + F.sum("size").over(by_order.rowsBetween(Window.unboundedPreceding, 0))
        )
        .drop("bucket", "s1", "b1", "offset", "key", "digest")
    )


def _finish(round_no: Column) -> Column:
    return (round_no * F.col("source_size") + F.col("served")).cast("double") / F.col("target")


def _cut(rows: DataFrame, budget: int) -> float:
    """Latest finish time up to which the copies of all sources hold at most ``budget`` words, or -1.

    Word totals by ever finer bins of time lead to the bin where the budget runs out; only its copies are sorted.
    Bins keep 10, then 22 leading bits of the time in units of 2**-32, so there are at most some 50,000 of them.
    """
    queue = rows.where("size > 0 and target > 0").select(
        "size", F.explode(F.transform(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), _finish)).alias("finish")
    ).withColumn("tick", F.floor(F.col("finish") * F.lit(float(1 << 32))).cast("bigint"))
    before, running = 0, Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    for bits in (10, 22):
        drop = F.greatest(F.length(F.bin("tick")) - bits, F.lit(0))
        bins = queue.select("size", F.call_function("shiftright", "tick", drop).alias("b"), drop.alias("d"))
        bins = bins.select("size", F.call_function("shiftleft", "b", "d").alias("bin"), "d")
        totals = bins.groupBy("bin", "d").agg(F.sum("size").alias("n"))
        over = totals.select("bin", "d", "n", F.sum("n").over(running).alias("upto")).where(
            F.col("upto") > budget - before
        ).orderBy("bin").limit(1).collect()
        if not over:
            return float("inf")
        low, width = over[0]["bin"], 1 << over[0]["d"]
        before += over[0]["upto"] - over[0]["n"]
        queue = queue.where((F.col("tick") >= low) & (F.col("tick") < low + width))
    by_time = Window.orderBy("finish").rangeBetween(Window.unboundedPreceding, 0)
    fits = queue.select("finish", F.sum("size").over(by_time).alias("upto")).where(F.col("upto") <= budget - before)
    last = fits.agg(F.max("finish")).first()[0]
    return last if last is not None else (low - 0.5) / (1 << 32)


def mix(
    docs: DataFrame,
    source_col: str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
    weights: Sequence[int] = (1, 2, 3),
    share: float = 1.0,
    seed: str = "mix",
    with_docs: bool = False,
) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, served, copies; with ``with_docs`` also ``doc``.

    Size is the number of words, none for NULL. ``copies`` says how often the mix takes the row, 0 to ROUNDS. Order in
    a source follows md5 of seed and identifier, then the identifier, then the text; repeated rows may swap places.
    Rows without words have copies 0. An empty table gives no rows. Columns of ``docs`` travel in the struct ``doc``.
    """
    source = _sized(docs, source_col, id_col, text_col, seed)
    sized = stage(source.drop("doc"), "mix-sizes")
    bucket = F.substring("key", 1, ORDER_DIGITS).alias("bucket")
    totals = stage(sized.groupBy("source", bucket).agg(F.sum("size").alias("words")), "mix-totals")
    targets = stage(
        source_targets(totals.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share), "mix-targets"
    )
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        F.col("source").alias("s1"), F.col("bucket").alias("b1"),
        F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"),
    )
    offsets = starts.join(targets.select("source", "source_size", "target"), F.col("s1").eqNullSafe(F.col("source")))
    offsets = offsets.drop("source")
    rows = stage(_served(sized, offsets), "mix-served")
    budget = targets.agg(F.round(F.sum("target"))).first()[0]
    cut = _cut(rows, int(budget or 0))
    if with_docs:
        rows = _served(source, offsets)
    due = F.filter(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), lambda r: _finish(r) <= F.lit(cut))
    copies = F.when((F.col("size") > 0) & (F.col("target") > 0), F.size(due)).otherwise(0)
    return rows.withColumn("copies", copies.cast("bigint"))


def served_stream(mixed: DataFrame) -> DataFrame:
    """The documents the mix takes, all their columns, range-sorted by virtual finish time over all sources."""
    each = mixed.where("copies > 0").withColumn("round", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)))
    return each.withColumn("finish", _finish(F.col("round"))).orderBy("finish", "source", "id").select("doc.*")

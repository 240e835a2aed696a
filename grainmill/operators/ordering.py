"""Ordered prefix sums and row numbers that never put one part into one task.

Keys and values, a narrow table, are range-partitioned by (part, order key) and written to the shared scratch folder
with the number of their range, so keys may be dense or sparse, hashed, negative or text, and there are as many ranges
as shuffle partitions. Sums of ranges are added up, and sums of sums where there are many ranges. Each row then adds
its range's offset to a sum over its own range. Wide columns (text, binaries, arrays) stay out of all this: they are
joined to the finished sums by key, after rows that are not kept have been dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from grainmill.session import stage, stage_counted

MIN_RANGES = 16  # otherwise as many as shuffle partitions
FAN = 1024  # ranges whose sums one window adds up
BROADCAST_RANGES = 100_000  # rows that may be broadcast, a few MB: offsets of ranges, last keys of parts


def _ranged(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """``rows`` in the shared folder with their range, and the number of ranges; ranges ascend with the keys."""
    n = max(MIN_RANGES, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return stage(rows.repartitionByRange(n, *keys).withColumn("__range", F.spark_partition_id()), "ranges"), n


def _sums_before(totals: DataFrame, part: list[str], at: str, values: dict[str, str]) -> list[Column]:
    before = Window.partitionBy(*part).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    return [F.coalesce(F.sum(v).over(before), F.lit(0)).alias(s) for s, v in values.items()]


def _offsets(totals: DataFrame, part: list[str], carry: list[str], values: dict[str, str], ranges: int) -> DataFrame:
    """(part, carry, __range) and for each sum what lies before the range. Totals have a row for each part and range."""
    if ranges <= FAN:
        return totals.select(*part, *carry, "__range", *_sums_before(totals, part, "__range", values))
    grouped = totals.withColumn("__group", F.expr(f"__range div {FAN}"))
    groups = grouped.groupBy(*part, "__group").agg(*[F.sum(v).alias(v) for v in values.values()])
    upper = _offsets(groups.withColumnRenamed("__group", "__range"), part, [], values, -(-ranges // FAN)).select(
        *part, F.col("__range").alias("__group"), *[F.col(s).alias(f"__u_{s}") for s in values])
    inner = grouped.select(*part, *carry, "__range", "__group", *_sums_before(grouped, [*part, "__group"], "__range", values))
    return inner.join(upper, [*part, "__group"]).select(
        *part, *carry, "__range", *[(F.col(s) + F.col(f"__u_{s}")).alias(s) for s in values])


def _is_wide(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType))


def prefix_sums(
    df: DataFrame,
    part: list[str],
    order: list[str],
    sums: dict[str, Column],
    keep: Column | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Add one column per entry of ``sums``: the sum over the rows before this one in its part.

    ``part`` and ``order`` are integers or text, without NULL, and tell all rows apart. The input is read twice, and
    once more if it has wide columns; stage it first if it is costly.

    ``keep`` is a condition on the new columns (and ``carry`` columns, constant within a part) that once false stays
    false for the rest of the part. It is tested on the offsets of ranges first, so rows past the last range that can
    still hold a kept row are dropped, and wide columns of rows past a part's last kept key are never shuffled.
    """
    carry, keys, value = list(carry), [*part, *order], {s: f"__v_{s}" for s in sums}
    fixed = {*keys, *carry}
    wide = [f.name for f in df.schema if f.name not in fixed and _is_wide(f.dataType)]
    slim = df.select("*", *[v.alias(value[s]) for s, v in sums.items()]).drop(*wide)
    if wide:
        slim = slim.select(*keys, *carry, *value.values())
    rows, ranges = _ranged(slim, keys)
    totals, n = stage_counted(
        rows.groupBy(*part, *carry, "__range").agg(*[F.sum(v).alias(v) for v in value.values()]), "range-totals")
    offsets = _offsets(totals, part, carry, value, ranges)
    if keep is not None:
        offsets = offsets.where(keep)
    offsets = offsets.select(*part, "__range", *[F.col(s).alias(f"__o_{s}") for s in sums])
    before = Window.partitionBy(*part, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(F.broadcast(offsets) if n <= BROADCAST_RANGES else offsets, [*part, "__range"])
    own = [c for c in slim.columns if c not in value.values()]
    out = placed.select(
        *own, *[(F.coalesce(F.sum(v).over(before), F.lit(0)) + F.col(f"__o_{s}")).alias(s) for s, v in value.items()])
    if keep is not None:
        out = out.where(keep)
    if not wide:
        return out.select(*df.columns, *sums)
    return _joined_back(df, out.select(*keys, *sums), part, order, n if keep is not None else None)


def _joined_back(df: DataFrame, found: DataFrame, part: list[str], order: list[str], parts: int | None) -> DataFrame:
    """All columns of the rows of ``df`` that ``found`` names, and its sums. ``parts`` bounds the parts; None: all rows stay."""
    if parts is not None:
        found = stage(found, "kept-keys")
        last = found.groupBy(*part).agg(F.max(F.struct(*order)).alias("__last"))
        reach = df.join(F.broadcast(last) if parts <= BROADCAST_RANGES else last, part)
        df = reach.where(F.struct(*order) <= F.col("__last")).select(*df.columns)
    sums = [c for c in found.columns if c not in (*part, *order)]
    return df.join(found, [*part, *order]).select(*[df[c] for c in df.columns], *sums)


def row_numbers(df: DataFrame, part: list[str], key: str, name: str = "rn", **kw) -> DataFrame:
    """0-based position of each row in its part, ordered by a unique key."""
    return prefix_sums(df, part, [key], {name: F.lit(1).cast("bigint")}, **kw)


def first_n_per_part(df: DataFrame, part: list[str], key: str, caps: Column) -> DataFrame:
    """The first ``caps`` rows of each part by key. ``caps`` may depend on part columns; NULL = all."""
    capped = df.withColumn("__cap", caps)
    out = row_numbers(
        capped, part, key, "__rn",
        keep=F.col("__cap").isNull() | (F.col("__rn") < F.col("__cap")),
        carry=["__cap"],
    )
    return out.select(*df.columns)

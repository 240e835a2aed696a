"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

WORD = r"[^\x20\x09-\x0D]+"
ROWS_A_TASK = 20_000  # narrow rows that are worth a task


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """``df``, narrow and of some ``rows`` rows, in as many tasks as these rows need; never more than it has."""
    return df.coalesce(max(1, -(-int(rows) // ROWS_A_TASK)))


def hidden(df: DataFrame, *names: str) -> list[str]:
    """Column names for own use that no column of ``df`` has, whatever it is called."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        new = f"__{n}"
        while new.lower() in taken:
            new += "_"
        taken.add(new.lower())
        out.append(new)
    return out


def words(text: Column) -> Column:
    """Words of a text; none for NULL."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def offsets(lengths: Column, block: int = 256) -> Column:
    """For each element of an int array the sum of those before it, in blocks so that long arrays stay cheap."""

    def running(part: Column) -> Column:
        start = F.struct(F.array().cast("array<int>").alias("a"), F.lit(0).alias("s"))
        add = lambda acc, x: F.struct(
            F.array_append(acc["a"], acc["s"]).alias("a"), (acc["s"] + x).cast("int").alias("s")
        )
        return F.aggregate(part, start, add)

    blocks = F.when(
        F.size(lengths) > 0,
        F.transform(
            F.sequence(F.lit(1), F.size(lengths), F.lit(block)), lambda i: running(F.slice(lengths, i, F.lit(block)))
        ),
    ).otherwise(F.array().cast("array<struct<a:array<int>,s:int>>"))
    before = running(F.transform(blocks, lambda b: b["s"]))["a"]
    shifted = F.transform(blocks, lambda b, k: F.transform(b["a"], lambda x: (x + before[k]).cast("int")))
    return F.flatten(shifted)


def row_slots(df: DataFrame, part: str, order: list[Column], bits: Column, name: str, buckets: int = 4096) -> DataFrame:
    """0-based place of each row within its part, ordered by ``bits`` and then ``order``.

    ``bits`` is a hash in [0, buckets). Counts per (part, bucket) give offsets; only rows of one bucket meet
    in a window, so a part of any size is spread over many tasks.
    """
    bucket, n, off = hidden(df, "bucket", "n", "off")
    rows = df.withColumn(bucket, bits)
    counts = rows.groupBy(part, bucket).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(part).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(part, bucket, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(off))
    inner = Window.partitionBy(part, bucket).orderBy(*order)
    return (
        rows.join(offs, [part, bucket])
        .select(*df.columns, (F.col(off) + F.row_number().over(inner) - 1).alias(name))
    )

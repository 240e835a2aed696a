"""Fixed windows over the global token stream.

Windows start every ``window`` tokens and hold ``window + 1``, so neighbours share one token. Documents
and sources run across window edges, nothing is padded and an incomplete tail is dropped. Each document
is cut into its slices in place; only slices travel, and a window gathers at most ``window + 1`` of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from grainmill.constants import WINDOW
from grainmill.functions.arrays import shift_pair
from grainmill.session import scratch_path


def window_count(total: Column, window: int = WINDOW) -> Column:
    """Complete windows in a stream of ``total`` tokens."""
    return F.greatest(F.floor((total - 1) / window), F.lit(0)).cast("bigint")


def pieces(docs: DataFrame, window: int = WINDOW, overlap: int = 1, doc: str = "doc_no") -> DataFrame:
    """``(window_id, s, doc, piece)``: the slices of each document, ``s`` the stream position of the slice.

    ``docs`` has ``(start, ids, doc_no)``, ``start`` being the stream position of the first id.
    """
    n = F.size("ids").cast("bigint")
    L = F.lit(window).cast("bigint")
    first = F.expr(f"greatest(0L, (start + {window - overlap}) div {window} - 1)")
    cut = F.transform(
        F.sequence(first, F.expr(f"(start + size(ids) - 1) div {window}")),
        lambda k: F.struct(
            k.alias("window_id"),
            F.greatest("start", k * L).alias("s"),
            F.slice(
                "ids",
                (F.greatest("start", k * L) - F.col("start") + 1).cast("int"),
                (
                    F.least(F.col("start") + n - 1, k * L + L - 1 + overlap)
                    - F.greatest("start", k * L) + 1
                ).cast("int"),
            ).alias("piece"),
        ),
    )
    return (
        docs.where(F.size("ids") > 0)
        .select(F.col(doc).alias("doc"), F.explode(cut).alias("c"))
        .select("c.window_id", "c.s", "doc", "c.piece")
    )


def pack(docs: DataFrame, window: int = WINDOW, doc: str = "doc_no") -> DataFrame:
    """Complete windows ``(window_id, ids, n_docs, first_doc, last_doc)``."""
    gathered = (
        pieces(docs, window, doc=doc)
        .groupBy("window_id")
        .agg(
            F.array_sort(F.collect_list(F.struct("s", "piece"))).alias("parts"),
            F.count("*").alias("n_docs"),
            F.min("doc").alias("first_doc"),
            F.max("doc").alias("last_doc"),
        )
    )
    return gathered.select(
        "window_id",
        F.flatten(F.transform("parts", lambda p: p["piece"])).alias("ids"),
        "n_docs", "first_doc", "last_doc",
    ).where(F.size("ids") == window + 1)


def bucketed(windows: DataFrame) -> DataFrame:
    """The windows as a table in the shared folder, bucketed by id, so that joins on it leave them where they are."""
    spark = windows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "windows")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    (
        windows.repartition(n, "window_id").write.bucketBy(n, "window_id").sortBy("window_id")
        .option("path", path).saveAsTable(name, format="parquet")
    )
    return spark.table(name)


def training_pairs(windows: DataFrame, window: int = WINDOW) -> DataFrame:
    """Adds inputs ``x`` and next-token targets ``y``."""
    x, y = shift_pair(F.col("ids"), window)
    return windows.withColumn("x", x).withColumn("y", y)

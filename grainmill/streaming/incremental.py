"""The batch operators over arriving files."""

from __future__ import annotations

from threading import Event

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from grainmill.functions.arrays import append_token
from grainmill.operators.mixture import budget_prefix
from grainmill.operators.recipes import RECIPES, prepare

POLL_SECONDS = 0.2


def prepared_ids(raw: DataFrame, recipe: str, codec) -> DataFrame:
    """Formatted, filtered and encoded documents ``(source, ord, ids)``; works on streams and tables."""
    ids = codec.encode(F.col("text"))
    return prepare(raw, recipe).select(
        "source", "ord", (append_token(ids) if RECIPES[recipe].append_end else ids).alias("ids")
    )


def write_prepared(raw_stream: DataFrame, recipe: str, codec, out: str, checkpoint: str) -> StreamingQuery:
    """Append the prepared documents of all files that have arrived, then stop."""
    return (
        prepared_ids(raw_stream, recipe, codec)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(out)
    )


def _read_state(spark: SparkSession, path: str, batch_id: int, schema: str) -> DataFrame:
    """State left by the batch before ``batch_id``; empty before the first."""
    if batch_id == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/batch_id={batch_id - 1}")


def fill_budgets(docs: DataFrame, budgets: DataFrame, out: str, state: str, checkpoint: str) -> bool:
    """:func:`write_within_budget` until every budget is full or all files that have arrived are read.

    True if every budget is full; the query then ends, and files that have not been read by then are never opened.
    """
    full = Event()
    query = write_within_budget(docs, budgets, out, state, checkpoint, full)
    while not query.awaitTermination(POLL_SECONDS):
        if full.is_set():
            query.stop()
    return full.is_set()


def write_within_budget(
    docs: DataFrame, budgets: DataFrame, out: str, state: str, checkpoint: str, full: Event | None = None
) -> StreamingQuery:
    """Keep documents ``(source, ord, n_tokens, ...)`` in arrival order until their source's budget is full.

    State is two numbers per source, tokens and documents kept so far. A micro-batch is cut with the
    same prefix sum as the batch operator, against what is left of each budget, so a source that fills
    a batch is still spread over tasks. Output and state go to a folder per batch id and are
    overwritten if the batch is retried, which makes each batch count once. Once all budgets are full, ``full`` is set
    and what a batch holds is no longer read.
    """
    schema = "source string, tokens bigint, docs bigint"
    names = budgets.select(F.col("name").alias("source"), "budget")

    def cut(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = _read_state(spark, state, batch_id, schema)
        left = (
            names.join(before, "source", "left")
            .withColumn("tokens", F.coalesce("tokens", F.lit(0)))
            .withColumn("docs", F.coalesce("docs", F.lit(0)))
            .select("source", "tokens", "docs", (F.col("budget") - F.col("tokens")).alias("budget"))
        )
        if left.where("docs = 0 or budget > 0").isEmpty():
            left.select("source", "tokens", "docs").write.mode("overwrite").parquet(f"{state}/batch_id={batch_id}")
            if full is not None:
                full.set()
            return
        open_now = batch.join(F.broadcast(left), "source").where("docs = 0 or budget > 0")
        kept = budget_prefix(open_now.select(*batch.columns, "budget"), F.col("n_tokens"))
        kept.select(*batch.columns).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        added = (
            spark.read.schema(batch.schema).parquet(f"{out}/batch_id={batch_id}")
            .groupBy("source")
            .agg(F.sum("n_tokens").alias("t"), F.count("*").alias("d"))
        )
        after = left.join(added, "source", "left").select(
            "source",
            (F.col("tokens") + F.coalesce("t", F.lit(0))).alias("tokens"),
            (F.col("docs") + F.coalesce("d", F.lit(0))).alias("docs"),
        )
        after.write.mode("overwrite").parquet(f"{state}/batch_id={batch_id}")
        if full is not None and after.join(names, "source").where("docs = 0 or tokens < budget").isEmpty():
            full.set()

    return (
        docs.writeStream.foreachBatch(cut)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_batches(spark: SparkSession, path: str, schema) -> DataFrame:
    """What :func:`write_within_budget` kept, over all batches."""
    return spark.read.schema(schema).option("basePath", path).parquet(f"{path}/batch_id=*")


def write_loss_summary(log: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Running loss per run and epoch; each batch writes the groups it changed."""
    totals = log.groupBy("run", "epoch").agg(
        F.count("*").alias("seen"),
        F.count_if(~F.col("skipped")).alias("counted"),
        F.sum(F.when(F.col("skipped"), 0.0).otherwise(F.col("loss"))).alias("total"),
    )

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return (
        totals.writeStream.outputMode("update")
        .foreachBatch(put)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_loss_summary(spark: SparkSession, path: str) -> DataFrame:
    """The newest state of every run and epoch."""
    schema = "run bigint, epoch bigint, seen bigint, counted bigint, total double, batch_id bigint"
    newest = F.max_by(F.struct("seen", "counted", "total"), "batch_id").alias("s")
    return (
        spark.read.schema(schema).parquet(path)
        .groupBy("run", "epoch")
        .agg(newest)
        .select(
            "run", "epoch", "s.seen", "s.counted",
            (F.col("s.total") / F.col("s.seen")).alias("mean_seen"),
            (F.col("s.total") / F.greatest("s.counted", F.lit(1))).alias("mean_counted"),
        )
    )

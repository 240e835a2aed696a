"""The same operators over arriving files."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainmill.operators.codec import ByteCodec
from grainmill.operators import recipes
from grainmill.plans.catalog import BASE, RAW, kept_sql, query, rounded
from grainmill.plans.corpus_queries import SHARE, recipe_budgets
from grainmill.plans.token_queries import ENCODED, digest
from grainmill.session import scratch_path
from grainmill.sources import tables
from grainmill.streaming import incremental


FILES = 6  # that a table arrives in
PER_BATCH = 2


def _raw_stream(spark, d):
    """All sources as arriving files in the common raw shape, each source in its order."""
    raw = tables.raw_corpus(spark, d)
    path = scratch_path(spark, "arriving")
    tables.write_in_order(raw, ["ord", "source"], path, FILES)
    return tables.scan_stream(spark, path, raw.schema, files_per_batch=PER_BATCH)


@query(
    "stream_prepare",
    f"""with {RAW}, {BASE}, {ENCODED}
        select source, ord, cast(count(*) + 1 as int) as n_tokens,
          md5(string_agg(cast(id as varchar), ',' order by i) || ',4') as digest
        from encoded group by source, ord""",
)
def stream_prepare(spark, d):
    out = scratch_path(spark, "prepared")
    incremental.write_prepared(
        _raw_stream(spark, d), "base", ByteCodec(), out, scratch_path(spark, "prepared-log")
    ).awaitTermination()
    ids = spark.read.schema("source string, ord bigint, ids array<int>").parquet(out)
    return ids.select("source", "ord", F.size("ids").alias("n_tokens"), digest(F.col("ids")).alias("digest"))


@query(
    "stream_budget",
    f"""with {kept_sql('base', SHARE)} select source, ord, n_tokens from kept""",
)
def stream_budget(spark, d):
    budgets = recipe_budgets(spark, d, "base")
    docs = recipes.prepare(_raw_stream(spark, d), "base").select(
        "source", "ord", (F.octet_length("text") + 1).cast("bigint").alias("n_tokens")
    )
    out = scratch_path(spark, "budgeted")
    incremental.fill_budgets(docs, budgets, out, scratch_path(spark, "budget-state"), scratch_path(spark, "budget-log"))
    return incremental.read_batches(spark, out, docs.schema).select("source", "ord", "n_tokens")


@query(
    "stream_loss",
    """with log as (
         select user_id % 2 as run, event_id // 1024 as epoch, value as loss, event_type = 'error' as skipped
         from events)
       select run, epoch, count(*) as seen, count(*) filter (where not skipped) as counted,
         round(sum(case when skipped then 0 else loss end) / count(*) + 1e-9, 6) as mean_seen,
         round(sum(case when skipped then 0 else loss end) / greatest(count(*) filter (where not skipped), 1) + 1e-9, 6) as mean_counted
       from log group by run, epoch""",
)
def stream_loss(spark, d):
    events, path = tables.table(spark, d, "events"), scratch_path(spark, "arriving")
    tables.write_in_order(events, ["event_id"], path, FILES)
    log = tables.scan_stream(spark, path, events.schema, files_per_batch=PER_BATCH).select(
        (F.col("user_id") % 2).alias("run"), F.expr("event_id div 1024").alias("epoch"),
        F.col("value").alias("loss"), (F.col("event_type") == "error").alias("skipped"),
    )
    out = scratch_path(spark, "loss")
    incremental.write_loss_summary(log, out, scratch_path(spark, "loss-log")).awaitTermination()
    return incremental.read_loss_summary(spark, out).select(
        "run", "epoch", "seen", "counted",
        rounded("mean_seen"), rounded("mean_counted"),
    )

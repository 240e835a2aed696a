"""Scans, and adapters from differently shaped tables to the common raw relation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from grainmill.operators.recipes import CONFIG_SHIFT
from grainmill.session import stage

CHOICE_SCHEMA = T.StructType([
    T.StructField("ord", T.LongType()), T.StructField("question", T.StringType()),
    T.StructField("choices", T.StructType([T.StructField("text", T.ArrayType(T.StringType()))])),
])


def scan(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    config: str | None = None,
    split: str | None = None,
    fmt: str = "parquet",
) -> DataFrame:
    """One dataset; ``config`` and ``split`` are partition columns, so other folders are not read."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.format(fmt).load(path)
    for column, wanted in (("config", config), ("split", split)):
        if wanted is not None:
            df = df.where(F.col(column) == wanted)
    return df


def scan_stream(
    spark: SparkSession, path: str, schema: T.StructType | str, glob: str | None = None, files_per_batch: int | None = None
) -> DataFrame:
    """The same files as an incremental scan."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def write_in_order(df: DataFrame, keys: list[str], path: str, files: int) -> None:
    """``df`` as files that arrive one after the other, in the order of the keys: an incremental scan reads them so."""
    ranged = stage(df.repartitionByRange(files, *keys).withColumn("__file", F.spark_partition_id()), "in-order")
    for i in range(files):
        ranged.where(F.col("__file") == i).drop("__file").coalesce(1).write.mode("append").parquet(path)


def all_splits(splits: dict[str, DataFrame]) -> DataFrame:
    """Every split, in the given order, with ``split`` and ``split_pos``."""
    tagged = [
        df.withColumn("split", F.lit(name)).withColumn("split_pos", F.lit(i))
        for i, (name, df) in enumerate(splits.items())
    ]
    return reduce(DataFrame.unionByName, tagged)


def raw_rows(df: DataFrame, source: str | Column, head: str, tail: str | Column | None = None, config_pos: int = 0) -> DataFrame:
    """Bring a table to ``(source, ord, head, tail)``."""
    source = F.lit(source) if isinstance(source, str) else source
    tail = F.lit(None).cast("string") if tail is None else F.col(tail) if isinstance(tail, str) else tail
    return df.select(
        source.alias("source"),
        (F.col("ord") + (config_pos << CONFIG_SHIFT)).alias("ord"),
        F.col(head).alias("head"),
        tail.alias("tail"),
    )


def choices_text() -> Column:
    """All answer choices joined by one space."""
    return F.array_join("choices.text", " ")


def union_raw(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# Derivation of the inputs from the supplied tables.

PLAIN_SOURCES = ["tinystories", "wikipedia", "bookcorpus", "openwebmath"]


TABLE_SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "benchmark": "item_id bigint, text string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLE_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def plain_source() -> Column:
    slot = F.substring("source", 4, 10).cast("int") % 4
    return F.element_at(F.array(*[F.lit(s) for s in PLAIN_SOURCES]), slot + 1)


def plain_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(name, ord, text)`` of the four plain-text sources."""
    return table(spark, sf_dir, "documents").select(
        plain_source().alias("name"), F.col("doc_id").alias("ord"), "text"
    )


def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(name, ord, question, answer)``: a user turn and the assistant turn right after it."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    told = turns.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    return asked.join(told, ["conv_id", "turn"]).select(
        F.when(F.col("conv_id") % 2 == 0, "metamathqa").otherwise("gsm8k").alias("name"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"),
        "question",
        "answer",
    )


def multiple_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(config, ord, question, choices)`` cut out of the benchmark texts."""
    parts = F.split("text", r"\. ")
    return table(spark, sf_dir, "benchmark").select(
        F.when(F.col("item_id") % 2 == 0, "ARC-Challenge").otherwise("ARC-Easy").alias("config"),
        F.col("item_id").alias("ord"),
        parts[0].alias("question"),
        F.struct(F.slice(parts, F.lit(2), F.size(parts) - 1).alias("text")).alias("choices"),
    )


def raw_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources as ``(source, ord, head, tail)``: one scan per underlying table."""
    choice = multiple_choice(spark, sf_dir)
    config_pos = F.when(F.col("config") == "ARC-Challenge", 0).otherwise(1).cast("bigint")
    return union_raw(
        raw_rows(plain_texts(spark, sf_dir), F.col("name"), "text"),
        raw_rows(qa_pairs(spark, sf_dir), F.col("name"), "question", "answer"),
        raw_rows(
            choice.withColumn("ord", F.shiftleft(config_pos, CONFIG_SHIFT) + F.col("ord")),
            "arc", "question", choices_text(),
        ),
    )


def batch_log(spark: SparkSession, sf_dir: str, runs: int = 2, epoch_len: int = 1024) -> DataFrame:
    """``(run, epoch, batch, loss, skipped, ts)``: events of a run numbered in order."""
    from grainmill.operators.ordering import row_numbers

    ev = table(spark, sf_dir, "events").select(
        (F.col("user_id") % runs).alias("run"), "event_id", "value", "event_type", "ts"
    )
    return row_numbers(ev, ["run"], "event_id").select(
        "run",
        F.expr(f"rn div {epoch_len}").alias("epoch"),
        (F.col("rn") % epoch_len).alias("batch"),
        F.col("value").alias("loss"),
        (F.col("event_type") == "error").alias("skipped"),
        "ts",
    )


EVENT_TYPES = ["view", "click", "signup", "purchase", "error"]
DOMAINS = ["history", "geometry", "music", "weather", "chess"]
SLOTS = 9  # one greedy generation and eight samples per problem


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(problem_id, sample_idx, mode, domain, output)``: nine events in a row make one problem."""
    slot = F.col("event_id") % SLOTS
    problem = F.expr(f"event_id div {SLOTS}")
    return table(spark, sf_dir, "events").select(
        problem.alias("problem_id"),
        slot.cast("int").alias("sample_idx"),
        F.when(slot == 0, "greedy").otherwise("sample").alias("mode"),
        F.element_at(F.array(*[F.lit(d) for d in DOMAINS]), (problem % 5 + 1).cast("int")).alias("domain"),
        F.concat(
            F.lit("<|problem|>q<|step|>s"),
            F.when(F.col("event_id") % 5 == 0, "").otherwise(
                F.concat(F.lit("<|answer|> "), "event_type", F.lit(" <|end|>"))
            ),
        ).alias("output"),
    )


def eval_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(problem_id, problem, expected)``, one per problem."""
    problem = F.expr(f"event_id div {SLOTS}")
    return (
        table(spark, sf_dir, "events")
        .where(F.col("event_id") % SLOTS == 0)
        .select(
            problem.alias("problem_id"),
            F.concat(F.lit("Which event closes case "), problem.cast("string"), F.lit("?")).alias("problem"),
            F.element_at(F.array(*[F.lit(e) for e in EVENT_TYPES]), (problem % 5 + 1).cast("int")).alias("expected"),
        )
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(grp, item, score)`` with floored scores, so that ties occur."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("grp"), F.col("event_id").alias("item"), F.floor("value").cast("double").alias("score")
    )


def scored_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(run, pos, target, logprob)``; target 0 is padding."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"), F.col("event_id").alias("pos"),
        (F.col("event_id") % 8).cast("int").alias("target"), (-F.col("value") / 100).alias("logprob"),
    )

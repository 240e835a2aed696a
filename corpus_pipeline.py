"""From raw documents to token ids: quality rules, line dedup, near-dedup, mixing, encoding.

Each stage takes the documents its predecessor kept, written as Parquet and read again, and applies one operator with
its production parameters. All but the last return the columns of documents; n_chars follows the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from grainmill.llm import bpe_codec, chosen_path, fair_mix, line_dedup, quality_rules
from grainmill.llm.queries import ranks_path
from grainmill.session import scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.apply_rules(docs, keep_text=True).where("kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are equal or nearly equal to earlier ones."""
    out = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest identifier."""
    return chosen_path.drop_near(docs).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix takes, up to three times each, in the order of the mix."""
    return fair_mix.served_stream(fair_mix.mix(docs, with_docs=True)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids and whether decoding the ids gives the text back, for each document of the mix."""
    encoded = bpe_codec.encode_documents(docs.select("doc_id", "source", "text"), ranks_path(), keep_text=True)
    back = bpe_codec.decode_documents(encoded, ranks_path(), keep_ids=True)
    return back.select(
        "doc_id", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids",
        F.encode(F.coalesce("text", F.lit("")), "UTF-8").eqNullSafe(F.col("bytes")).alias("round_trip"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality), ("line_dedup", lines), ("near_dedup", near), ("fair_mix", mix), ("bpe_codec", encode),
]
# Near-dedup finds its candidates by random trees and the last stage encodes by ranks: neither is SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = scratch_path(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs

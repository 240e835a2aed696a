"""Saving and loading vocabularies: ``vocab.json`` and ``merges.txt`` plus Parquet tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from grainmill.operators.vocabulary import Vocabulary
from grainmill.session import scratch_root
from grainmill.sources.files import write_text

MERGES_HEADER = "#version: 0.2"


def save_vocabulary(spark: SparkSession, vocab: Vocabulary, path: str) -> None:
    write_text(f"{path}/vocab.json", json.dumps(vocab.ids, ensure_ascii=False))
    lines = [MERGES_HEADER, *(f"{a} {b}" for a, b in vocab.merges)]
    write_text(f"{path}/merges.txt", "\n".join(lines) + "\n")
    vocab.vocab_table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/vocab.parquet")
    vocab.merge_table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/merges.parquet")


def vocab_table(spark: SparkSession, path: str) -> DataFrame:
    """``(piece, id)`` from ``vocab.json``."""
    text = spark.read.text(f"{path}/vocab.json", wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,int>")).alias("piece", "id"))


def merge_table(spark: SparkSession, path: str) -> DataFrame:
    """``(rank, left, right)`` from ``merges.txt``, ranks in file order."""
    text = spark.read.text(f"{path}/merges.txt", wholetext=True)
    lines = F.filter(F.split("value", "\n"), lambda x: (x != "") & ~x.startswith("#version"))
    pair = F.split("line", " ")
    return text.select(F.posexplode(lines).alias("rank", "line")).select(
        "rank", pair[0].alias("left"), pair[1].alias("right")
    )


def load_vocabulary(spark: SparkSession, path: str) -> Vocabulary:
    return Vocabulary.from_tables(vocab_table(spark, path), merge_table(spark, path))


def table_version(df: DataFrame) -> str:
    """A number for the files a table consists of now: their paths, sizes and times of change."""
    m = F.col("_metadata")
    files = df.select(m["file_path"].alias("p"), m["file_size"].alias("s"), m["file_modification_time"].alias("t")).distinct()
    row = files.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("p", "s", "t").cast("decimal(38,0)")).alias("h")).first()
    return f"{row['n']}-{int(row['h'] or 0) % (1 << 64):x}"


def learn_once(table: DataFrame, label: str, learn: Callable[[], Vocabulary]) -> Vocabulary:
    """The vocabulary kept in the shared folder for this version of ``table``, or a new one, which is then kept.

    What is kept counts only if it is whole. A table whose files have changed has another version.
    """
    spark = table.sparkSession
    path = f"{scratch_root(spark)}/vocabulary-{label}-{table_version(table)}"
    try:
        rows = spark.read.schema("rank int, left string, right string, n int").parquet(path).orderBy("rank").collect()
    except AnalysisException:
        rows = []
    if rows and len(rows) == rows[0]["n"]:
        return Vocabulary([(r["left"], r["right"]) for r in rows])
    vocab = learn()
    n = F.lit(len(vocab.merges))
    vocab.merge_table(spark).withColumn("n", n).coalesce(1).write.mode("overwrite").parquet(path)
    return vocab

import random
import time

import pytest
from pyspark.sql import functions as F

from grainmill.operators import recipes, trainlog
from grainmill.operators.codec import ByteCodec
from grainmill.operators.mixture import budget_prefix
from grainmill.streaming import incremental

RAW = "source string, ord bigint, head string, tail string"


def arriving_files(df, path, n):
    """Files whose arrival order is the order key's."""
    for i in range(n):
        df.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(str(path))


def text_files(spark, path, n=4):
    r = random.Random(1)
    rows = [
        (s, i, " ".join("w" * r.randrange(1, 9) for _ in range(r.randrange(60))), "t", i * n // 80)
        for s in ("tinystories", "gsm8k", "openwebmath") for i in range(80)
    ]
    df = spark.createDataFrame(rows, RAW + ", part int")
    arriving_files(df, path, n)
    return df.drop("part")


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(path))


def test_prepared_stream_equals_batch_and_takes_new_files_once(spark, tmp_path):
    batch = text_files(spark, tmp_path / "in")
    out, log = str(tmp_path / "out"), str(tmp_path / "log")

    def run():
        source = stream(spark, tmp_path / "in", RAW)
        incremental.write_prepared(source, "base", ByteCodec(), out, log).awaitTermination()
        return sorted(map(str, spark.read.parquet(out).collect()))

    want = sorted(map(str, incremental.prepared_ids(batch, "base", ByteCodec()).collect()))
    assert run() == want
    assert run() == want
    spark.createDataFrame([("gsm8k", 999, "q", "a")], RAW).write.mode("append").parquet(str(tmp_path / "in"))
    assert len(run()) == len(want) + 1


@pytest.mark.parametrize("budget", [0, 1500, 10**7])
def test_budgeted_stream_equals_batch(spark, tmp_path, budget):
    batch = recipes.prepare(text_files(spark, tmp_path / "in"), "base")
    names = [("tinystories", budget), ("gsm8k", budget // 2), ("openwebmath", budget)]
    budgets = spark.createDataFrame(names, "name string, budget bigint")
    docs = recipes.prepare(stream(spark, tmp_path / "in", RAW), "base").select(
        "source", "ord", F.octet_length("text").cast("bigint").alias("n_tokens")
    )
    out = str(tmp_path / "out")
    incremental.write_within_budget(docs, budgets, out, str(tmp_path / "state"), str(tmp_path / "log")).awaitTermination()
    got = incremental.read_batches(spark, out, docs.schema)
    with_budget = batch.join(budgets.withColumnRenamed("name", "source"), "source")
    want = budget_prefix(with_budget, F.octet_length("text")).select("source", "ord", "n_tokens")
    assert sorted(map(tuple, got.select("source", "ord", "n_tokens").collect())) == sorted(map(tuple, want.collect()))


def test_files_after_the_last_budget_is_full_are_not_opened(spark, tmp_path):
    batch = recipes.prepare(text_files(spark, tmp_path / "in"), "base")
    for i in range(3):  # reading any of these fails
        time.sleep(0.05)
        (tmp_path / "in" / f"part-99999-{i}.snappy.parquet").write_bytes(b"no parquet file")
    budgets = spark.createDataFrame([("tinystories", 900), ("gsm8k", 400), ("openwebmath", 1)], "name string, budget bigint")
    docs = recipes.prepare(stream(spark, tmp_path / "in", RAW), "base").select(
        "source", "ord", F.octet_length("text").cast("bigint").alias("n_tokens"))
    out = str(tmp_path / "out")
    assert incremental.fill_budgets(docs, budgets, out, str(tmp_path / "state"), str(tmp_path / "log"))
    want = budget_prefix(batch.join(budgets.withColumnRenamed("name", "source"), "source"), F.octet_length("text"))
    got = incremental.read_batches(spark, out, docs.schema).select("source", "ord", "n_tokens").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.select("source", "ord", "n_tokens").collect()))


def test_a_budget_that_stays_open_reads_all_files(spark, tmp_path):
    text_files(spark, tmp_path / "in")
    budgets = spark.createDataFrame([("tinystories", 1), ("gsm8k", 10**9)], "name string, budget bigint")
    docs = recipes.prepare(stream(spark, tmp_path / "in", RAW), "base").select(
        "source", "ord", F.octet_length("text").cast("bigint").alias("n_tokens"))
    out = str(tmp_path / "out")
    assert not incremental.fill_budgets(docs, budgets, out, str(tmp_path / "state"), str(tmp_path / "log"))
    assert incremental.read_batches(spark, out, docs.schema).where("source = 'gsm8k'").count() == 80


def test_loss_stream_ends_at_the_epoch_summary(spark, tmp_path):
    r = random.Random(4)
    rows = [(i % 2, i // 40, i // 2 % 20, r.random(), r.random() < 0.2, i // 30) for i in range(120)]
    df = spark.createDataFrame(rows, "run bigint, epoch bigint, batch bigint, loss double, skipped boolean, part int")
    arriving_files(df, tmp_path / "in", 4)
    log = stream(spark, tmp_path / "in", df.drop("part").schema)
    incremental.write_loss_summary(log, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    got = {(x["run"], x["epoch"]): x for x in incremental.read_loss_summary(spark, str(tmp_path / "out")).collect()}
    want = trainlog.epoch_summary(df.withColumn("ts", F.current_timestamp())).collect()
    assert len(got) == len(want) == 6
    for w in want:
        g = got[w["run"], w["epoch"]]
        assert (g["seen"], g["counted"]) == (w["seen"], w["counted"])
        assert g["mean_seen"] == pytest.approx(w["mean_seen"]) and g["mean_counted"] == pytest.approx(w["mean_counted"])

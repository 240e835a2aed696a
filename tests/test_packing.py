import random

import pytest
from pyspark.sql import functions as F

from grainmill.operators import epochs, packing
from grainmill.plans.build import epoch_plan, write_epoch_plan


def as_docs(spark, docs):
    rows, at = [], 0
    for i, ids in enumerate(docs):
        rows.append((i, at, ids))
        at += len(ids)
    return spark.createDataFrame(rows, "doc_no bigint, start bigint, ids array<int>")


def packed(spark, docs, L):
    got = packing.pack(as_docs(spark, docs).repartition(5), L).orderBy("window_id").collect()
    return [(r["window_id"], r["ids"]) for r in got]


def cut(stream, L):
    return [(k, stream[k * L : k * L + L + 1]) for k in range(max(len(stream) - 1, 0) // L)]


@pytest.mark.parametrize("n, windows", [(0, 0), (1, 0), (4, 0), (5, 1), (8, 1), (9, 2)])
def test_window_counts(spark, n, windows):
    docs = [[i] for i in range(n)] or [[]]
    assert len(packed(spark, docs, 4)) == windows
    count = spark.createDataFrame([(n,)], "n bigint").select(packing.window_count(F.col("n"), 4)).first()[0]
    assert count == windows


@pytest.mark.parametrize("seed", range(6))
def test_windows_equal_slices_of_the_stream(spark, seed):
    r = random.Random(seed)
    docs = [[r.randrange(1000) for _ in range(r.choice([0, 1, 2, 3, 7, 8, 30]))] for _ in range(40)]
    docs[7] = [r.randrange(1000) for _ in range(100)]  # longer than many windows
    stream = [t for d in docs for t in d]
    assert packed(spark, docs, 7) == cut(stream, 7)


def test_training_pairs(spark):
    row = packing.training_pairs(packing.pack(as_docs(spark, [[1, 2, 3, 4, 5]]), 4), 4).first()
    assert (row["x"], row["y"]) == ([1, 2, 3, 4], [2, 3, 4, 5])
    assert dict(packing.training_pairs(packing.pack(as_docs(spark, [[1]]), 4), 4).dtypes)["x"] == "array<bigint>"


def test_pieces_without_overlap_partition_the_stream(spark):
    docs = [list(range(10)), [], list(range(100, 117)), [7]]
    got = packing.pieces(as_docs(spark, docs), 5, overlap=0).orderBy("window_id", "s").collect()
    assert [t for r in got for t in r["piece"]] == [t for d in docs for t in d]
    assert all(r["s"] // 5 == r["window_id"] == (r["s"] + len(r["piece"]) - 1) // 5 for r in got)


def shards_by_loop(order, world):
    padded = list(order)
    while len(padded) % world or len(padded) < world:
        padded.append(padded[len(padded) - len(order)])
    return {r: padded[r::world] for r in range(world)}


@pytest.mark.parametrize("n, world", [(5, 2), (6, 3), (2, 5), (1, 4), (7, 1)])
def test_rank_shards_wrap(spark, many_buckets, n, world):
    ids = spark.range(n).withColumnRenamed("id", "window_id")
    indexed = epochs.shuffle_epochs(ids, 2, seed=3)
    for e in (0, 1):
        order = [r["window_id"] for r in indexed.where(F.col("epoch") == e).orderBy("idx").collect()]
        assert sorted(order) == list(range(n))
        got = epochs.shard_ranks(indexed, world, n).where(F.col("epoch") == e).orderBy("rank", "slot").collect()
        by_rank = {r: [x["window_id"] for x in got if x["rank"] == r] for r in range(world)}
        assert by_rank == shards_by_loop(order, world)


def test_shuffle_depends_on_seed_and_epoch_only(spark):
    ids = spark.range(200).withColumnRenamed("id", "window_id")

    def order(df, seed, epoch):
        got = epochs.shuffle_epochs(df, 2, seed).where(F.col("epoch") == epoch).orderBy("idx")
        return [r["window_id"] for r in got.collect()]

    assert order(ids, 1, 0) == order(ids.repartition(13), 1, 0)
    assert order(ids, 1, 0) != order(ids, 1, 1)
    assert order(ids, 1, 0) != order(ids, 2, 0)


def test_batches_and_accumulation(spark):
    ids = spark.range(41).withColumnRenamed("id", "window_id")
    plan = epoch_plan(ids, world=2, n_epochs=1, batch_size=4)
    got = plan.where("rank = 0").groupBy("batch").agg(F.count("*").alias("n"), F.max("is_boundary").alias("b")).orderBy("batch").collect()
    assert [r["n"] for r in got] == [4, 4, 4, 4, 4, 1]
    assert not any(r["b"] for r in got)
    numbers = epochs.plan_numbers(ids, 2, 4, 4, 3, resume_step=3).first()
    assert (numbers["per_rank"], numbers["n_batches"], numbers["total_steps"], numbers["steps_per_epoch"], numbers["start_epoch"]) == (21, 6, 4, 1, 3)
    tiny = epochs.plan_numbers(spark.range(1).withColumnRenamed("id", "window_id"))
    assert tiny.first()["start_epoch"] is None
    tiny = epochs.plan_numbers(spark.range(1).withColumnRenamed("id", "window_id"), recipe="cpt")
    assert tiny.first()["steps_per_epoch"] == 1


def test_written_plan_holds_every_window_in_slot_order(spark, tmp_path):
    windows = packing.pack(as_docs(spark, [list(range(50))]), 1024 // 256)
    plan = epoch_plan(windows.select("window_id"), world=2, n_epochs=1)
    write_epoch_plan(plan, windows, str(tmp_path / "plan"))
    back = spark.read.parquet(str(tmp_path / "plan"))
    assert back.count() == plan.count() == 12
    assert {r["rank"] for r in back.select("rank").collect()} == {0, 1}


@pytest.mark.parametrize("n", [1, 2, 3, 50, 1000])
def test_arithmetic_places_are_permutations(spark, n):
    ids = spark.range(n).withColumnRenamed("id", "window_id")
    got = epochs.permuted_epochs(ids, n, epochs=3, seed=5).collect()
    per = {e: [r["idx"] for r in sorted(got, key=lambda r: r["window_id"]) if r["epoch"] == e] for e in range(3)}
    assert all(sorted(p) == list(range(n)) for p in per.values())
    if n == 1000:
        other = [r["idx"] for r in epochs.permuted_epochs(ids, n, epochs=1, seed=6).orderBy("window_id").collect()]
        assert len({tuple(p) for p in [*per.values(), other]}) == 4
        moved = sum(abs(a - i) > 100 for i, a in enumerate(per[0]))
        assert moved > 600  # 810 expected of a random order


def test_bucketed_windows_are_not_shuffled_again(spark):
    windows = spark.range(500).select(F.col("id").alias("window_id"), F.array(F.col("id").cast("int")).alias("ids"))
    table = packing.bucketed(windows)
    plan = epochs.shuffle_epochs(table.select("window_id"), 3, seed=1)
    found = epochs.lookup_windows(plan.hint("merge"), table)
    above = found._jdf.queryExecution().executedPlan().toString().split("Scan parquet")
    shuffles = [x for x in found._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in x and "ids#" in x]
    assert len(above) > 1 and not shuffles
    rows = found.collect()
    assert len(rows) == 1500 and all(r["ids"] == [r["window_id"]] for r in rows)


def test_byte_ids_leave_python_in_chunks(monkeypatch):
    import pyarrow as pa
    from grainmill.operators import codec

    monkeypatch.setattr(codec, "CHUNK", 5)
    texts = ["abc", None, "", "dé", "a" * 12, "b"]
    parts = list(codec._byte_ids.func(iter([pa.array(["z", *texts]).slice(1), pa.array([], pa.string())])))
    want = [None if t is None else [codec.BYTE_IDS[b] for b in t.encode()] for t in texts]
    assert [x for p in parts for x in p.to_pylist()] == want
    assert len(parts) > 2

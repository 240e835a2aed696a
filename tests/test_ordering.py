import random

import pytest
from pyspark.sql import functions as F

from grainmill.operators import ordering
from grainmill.operators.mixture import budget_prefix
from grainmill.operators.ordering import first_n_per_part, prefix_sums, row_numbers


def rows_with_a_hot_part(n=3000, seed=1):
    r = random.Random(seed)
    keys = r.sample(range(1 << 34), n)
    return [("hot" if r.random() < 0.6 else r.choice("abc"), k, r.randrange(5)) for k in keys]


def plain_prefix(rows):
    out, sums = {}, {}
    for p, k, v in sorted(rows):
        s, n = sums.get(p, (0, 0))
        out[p, k] = (s, n)
        sums[p] = (s + v, n + 1)
    return out


@pytest.mark.parametrize("spread", ["dense", "sparse", "negative", "text"])
@pytest.mark.parametrize("tasks", [1, 16])
def test_prefix_sums_match_a_loop(spark, many_buckets, spread, tasks):
    rows = rows_with_a_hot_part()
    change = {
        "dense": lambda i, k: i, "sparse": lambda i, k: hash((k, 7)), "negative": lambda i, k: -k,
        "text": lambda i, k: f"{k:x}",
    }[spread]
    rows = [(p, change(i, k), v) for i, (p, k, v) in enumerate(rows)]
    kind = "string" if spread == "text" else "bigint"
    df = spark.createDataFrame(rows, f"p string, k {kind}, v bigint").repartition(tasks)
    got = prefix_sums(df, ["p"], ["k"], {"s": F.col("v"), "n": F.lit(1).cast("bigint")}).collect()
    assert {(r["p"], r["k"]): (r["s"], r["n"]) for r in got} == plain_prefix(rows)
    assert len(got) == len(rows)


def test_no_join_or_window_on_the_part_alone(spark, many_buckets):
    df = spark.createDataFrame(rows_with_a_hot_part(500), "p string, k bigint, v bigint")
    out = prefix_sums(df, ["p"], ["k"], {"s": F.col("v")}, keep=F.col("s") < 400)
    plan = out._jdf.queryExecution().executedPlan().toString().split("\n")
    rows = [x for x in plan if "hashpartitioning(p#" in x and "__range" not in x]
    assert len(rows) <= 1  # the totals of ranges, one row for each range


@pytest.mark.parametrize("keep", [None, 300])
def test_sums_of_sums_and_text_joined_back(spark, monkeypatch, keep):
    monkeypatch.setattr(ordering, "MIN_RANGES", 40)
    monkeypatch.setattr(ordering, "FAN", 3)
    rows = rows_with_a_hot_part(800)
    df = spark.createDataFrame([(*r, f"text {r[1]}", [r[2]]) for r in rows], "p string, k bigint, v bigint, text string, a array<bigint>")
    bound = None if keep is None else F.col("s") < keep
    out = prefix_sums(df, ["p"], ["k"], {"s": F.col("v"), "n": F.lit(1).cast("bigint")}, keep=bound)
    assert out.columns == [*df.columns, "s", "n"]
    windows = [x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window" in x]
    assert not any("text#" in x or "a#" in x for x in windows)  # text is in no window shuffle
    want = {k: v for k, v in plain_prefix(rows).items() if keep is None or v[0] < keep}
    got = out.collect()
    assert {(r["p"], r["k"]): (r["s"], r["n"]) for r in got} == want and len(got) == len(want)
    assert all(r["text"] == f"text {r['k']}" and r["a"] == [r["v"]] for r in got)


def test_empty_input(spark):
    df = spark.createDataFrame([], "p string, k bigint")
    assert row_numbers(df, ["p"], "k").collect() == []


def test_row_numbers_take_negative_keys(spark, many_buckets):
    keys = [-5000, -1, 0, 3, 4096, 1 << 40]
    df = spark.createDataFrame([(0, k) for k in reversed(keys)], "p int, k bigint")
    got = row_numbers(df, ["p"], "k").orderBy("rn").collect()
    assert [r["k"] for r in got] == keys
    assert [r["rn"] for r in got] == list(range(6))


def test_first_n_per_part(spark, many_buckets):
    rows = rows_with_a_hot_part()
    df = spark.createDataFrame(rows, "p string, k bigint, v bigint")
    caps = F.when(F.col("p") == "hot", 700).when(F.col("p") == "a", 0).when(F.col("p") == "b", 10**6).cast("bigint")
    got = first_n_per_part(df, ["p"], "k", caps).collect()
    want = []
    for p, n in (("hot", 700), ("a", 0), ("b", 10**6), ("c", 10**6)):
        want += sorted(r for r in rows if r[0] == p)[:n]
    assert sorted(map(tuple, got)) == sorted(want)


def kept_by_loop(lengths, budget):
    total, kept = 0, 0
    for n in lengths:
        total, kept = total + n, kept + 1
        if total >= budget:
            break
    return kept


@pytest.mark.parametrize("budget, kept", [(0, 1), (3, 1), (4, 2), (7, 2), (8, 3), (100, 3)])
def test_budget_keeps_the_crossing_document(spark, many_buckets, budget, kept):
    assert kept_by_loop([3, 4, 5], budget) == kept
    df = spark.createDataFrame([("s", i * 5000, n, budget) for i, n in enumerate([3, 4, 5])], "source string, ord bigint, n int, budget bigint")
    got = budget_prefix(df, F.col("n")).orderBy("ord").collect()
    assert [r["ord"] for r in got] == [i * 5000 for i in range(kept)]


def test_budget_prefix_of_several_sources_matches_a_loop(spark, many_buckets):
    r = random.Random(5)
    budgets = {"a": 0, "b": 1000, "c": 10**6}
    rows = [(s, k, r.randrange(0, 40), budgets[s]) for s in budgets for k in r.sample(range(100_000), 300)]
    df = spark.createDataFrame(rows, "source string, ord bigint, n int, budget bigint").repartition(7)
    got = budget_prefix(df, F.col("n")).groupBy("source").count().collect()
    want = {s: kept_by_loop([n for q, _, n, _ in sorted(rows) if q == s], b) for s, b in budgets.items()}
    assert {g["source"]: g["count"] for g in got} == want

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from grainmill.operators import candidates, scoring, trainlog


def votes(spark, answers):
    rows = [(1, i, a) for i, a in enumerate(answers)]
    return scoring.vote(spark.createDataFrame(rows, "problem_id bigint, sample_idx int, answer string").repartition(3))


@pytest.mark.parametrize("answers", [["b", "a", "a", "b"], ["x"], [None, "q", None], ["a", "b", "b", "c", "c"]])
def test_vote_ties_go_to_the_first_met(spark, answers):
    want = Counter(a for a in answers if a).most_common(1)[0]
    got = votes(spark, answers).first()
    assert (got["voted"], got["votes"]) == want


def test_no_answers_no_vote_and_wrong(spark):
    assert votes(spark, [None, None]).count() == 0
    cases = spark.createDataFrame([(1, "p", "4"), (2, "p", "x")], "problem_id bigint, problem string, expected string")
    gens = spark.createDataFrame(
        [(1, 0, "greedy", "<|answer|>14<|end|>"), (1, 1, "sample", "<|answer|>5<|end|>"), (1, 2, "sample", "none")],
        "problem_id bigint, sample_idx int, mode string, output string",
    )
    got = {r["problem_id"]: r for r in scoring.consistency(cases, gens).collect()}
    assert (got[1]["greedy"], got[1]["voted"], got[1]["greedy_ok"], got[1]["voted_ok"]) == ("14", "5", True, False)
    assert (got[2]["greedy"], got[2]["voted_ok"], got[2]["prompt"]) == (None, False, "<|problem|>p")
    acc = scoring.accuracy(scoring.consistency(cases, gens)).first()
    assert (acc["greedy_accuracy"], acc["voted_accuracy"], acc["gain"]) == (50.0, 0.0, -50.0)


def test_empty_sets_give_null(spark):
    empty = spark.createDataFrame([], "output string")
    assert scoring.pass_ratio(scoring.structure(empty)).first()["ratio"] is None
    scored = spark.createDataFrame([], "greedy_ok boolean, voted_ok boolean")
    assert scoring.accuracy(scored).first()["gain"] is None


def test_structure_needs_step_and_answer(spark):
    df = spark.createDataFrame([("<|step|><|answer|>",), ("<|step|><|end|>",), ("<|answer|>",)], "output string")
    assert [r["ok"] for r in scoring.structure(df).collect()] == [True, False, False]


def scores(spark, rows):
    return spark.createDataFrame(rows, "grp bigint, item bigint, score double")


def test_top_k_keeps_ties(spark):
    df = scores(spark, [(1, i, s) for i, s in enumerate([5.0, 4.0, 4.0, 3.0])] + [(2, 9, 1.0)])
    assert sorted(r["item"] for r in candidates.top_k(df, 2).collect()) == [0, 1, 2, 9]
    many = scores(spark, [(1, i, 7.0) for i in range(500)] + [(1, 1000, 1.0)])
    assert candidates.top_k(many, 2).count() == 500


def test_softmax_with_temperature(spark):
    df = scores(spark, [(1, 0, 1000.0), (1, 1, 999.0), (1, 2, 999.0)])
    p = {r["item"]: r["p"] for r in candidates.softmax(df, 0.5).collect()}
    z = 1 + 2 * math.exp(-2)
    assert p[0] == pytest.approx(1 / z) and p[1] == pytest.approx(math.exp(-2) / z)


@pytest.mark.parametrize("hash_name", ["xxhash64", "md5"])
def test_draws_follow_the_softmax(spark, hash_name):
    weights = [3.0, 2.0, 1.0, -50.0]
    groups = spark.range(4000).withColumnRenamed("id", "grp")
    items = F.explode(F.array(*[F.struct(F.lit(i).cast("bigint").alias("item"), F.lit(w).alias("score")) for i, w in enumerate(weights)]))
    df = groups.select("grp", items.alias("c")).select("grp", "c.*")
    got = {r["item"]: r["count"] / 4000 for r in candidates.draw(df, 1.0, 2, 1, hash_name).groupBy("item").count().collect()}
    want = math.exp(1) / (math.exp(1) + 1)
    assert set(got) == {0, 1} and abs(got[0] - want) < 0.03


def test_greedy_ties_to_the_smallest(spark):
    df = scores(spark, [(1, 5, 2.0), (1, 3, 2.0), (1, 1, 1.0)])
    assert candidates.greedy(df).first()["item"] == 3


def test_masked_loss_ignores_padding(spark):
    df = spark.createDataFrame([(1, 0, -9.0), (1, 3, -1.0), (1, 4, -3.0)], "run bigint, target int, logprob double")
    assert scoring.masked_loss(df, ["run"]).first()["loss"] == 2.0


def make_log(spark, batches, epoch_len, skipped):
    rows = [(1, i // epoch_len, i % epoch_len, float(i + 1), i in skipped, i) for i in range(batches)]
    df = spark.createDataFrame(rows, "run bigint, epoch bigint, batch bigint, loss double, skipped boolean, s int")
    return df.withColumn("ts", F.timestamp_seconds("s")).drop("s").repartition(5)


def steps_by_loop(batches, epoch_len, skipped, accum):
    out, step = [], 0
    for i in range(batches):
        step += (i % epoch_len + 1) % accum == 0 and i not in skipped
        out.append(step)
    return out


def test_steps_carry_over_epochs_and_skip_oom_boundaries(spark, many_buckets):
    skipped = {7, 8, 30}
    log = make_log(spark, 50, 18, skipped)
    got = trainlog.global_steps(log, accum=4).orderBy("epoch", "batch").collect()
    assert [r["step"] for r in got] == steps_by_loop(50, 18, skipped, 4)
    assert not got[7]["stepped"]


def test_running_means_under_both_denominators(spark, many_buckets):
    log = make_log(spark, 6, 6, {0, 3})
    got = trainlog.running_mean(log).orderBy("batch").collect()
    assert got[0]["mean_counted"] is None and got[0]["mean_seen"] == 0
    assert got[4]["mean_seen"] == (2 + 3 + 5) / 5 and got[4]["mean_counted"] == (2 + 3 + 5) / 3


def test_checkpoints_and_latest(spark):
    log = make_log(spark, 20, 10, {19})
    base = {(r["kind"], r["step"]): r for r in trainlog.checkpoints(log, "base", every=2, accum=4).collect()}
    assert set(base) == {("periodic", 2), ("epoch_end", 2), ("periodic", 4), ("epoch_end", 4)}
    assert base["periodic", 2]["loss"] == 8 / 4
    assert base["epoch_end", 4]["loss"] == sum(range(11, 20)) / 10
    cpt = trainlog.checkpoints(log, "cpt", every=2, accum=4)
    rows = {(r["kind"], r["step"]): r["loss"] for r in cpt.collect()}
    assert rows["periodic", 2] == sum(range(1, 9)) / 8 and rows["epoch_end", 4] == sum(range(11, 20)) / 9
    last = trainlog.latest_checkpoint(cpt).first()
    assert (last["kind"], last["epoch"], last["step"]) == ("epoch_end", 1, 4)


def test_epoch_summary_seconds_and_series(spark):
    log = make_log(spark, 20, 10, set())
    assert [r["secs"] for r in trainlog.epoch_summary(log).orderBy("epoch").collect()] == [9.0, 9.0]
    assert [r["delta"] for r in trainlog.epoch_series(log).orderBy("epoch").collect()] == [None, 10.0]
    assert trainlog.progress_rows(log, every=2, accum=4).count() == 2


LOG_SCHEMA = "run bigint, epoch int, batch bigint, loss double, skipped boolean, ts timestamp"


def log_of(spark, rows):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    return spark.createDataFrame([(1, e, b, x, False, start + timedelta(seconds=s)) for e, b, x, s in rows], LOG_SCHEMA)


def test_masked_loss_keeps_groups_of_padding_only(spark):
    df = spark.createDataFrame([(1, 0, -1.0), (1, 0, -2.0), (2, 5, -3.0)], "run bigint, target int, logprob double")
    got = {r["run"]: (r["loss"], r["n_targets"]) for r in scoring.masked_loss(df, ["run"]).collect()}
    assert got == {1: (None, 0), 2: (3.0, 1)}


def test_epoch_end_names_its_last_batch(spark):
    log = log_of(spark, [(0, b, 1.0, b) for b in (0, 1, 3)])
    ends = trainlog.checkpoints(log).where("kind = 'epoch_end'").collect()
    assert [r["batch"] for r in ends] == [3]


def test_series_over_an_epoch_gap(spark):
    log = log_of(spark, [(0, 0, 1.0, 0), (2, 0, 4.0, 9)])
    assert [r["delta"] for r in trainlog.epoch_series(log).orderBy("epoch").collect()] == [None, 3.0]


def test_progress_seconds_and_resumed_epochs(spark):
    rows = [(0, b, 1.0, b) for b in range(4)] + [(1, b, 2.0, 10 + b) for b in range(2)] + [(1, b, 3.0, 50 + 2 * b) for b in range(4)]
    log = trainlog.last_attempts(log_of(spark, rows))
    assert log.count() == 8 and log.columns == ["run", "epoch", "batch", "loss", "skipped", "ts"]
    got = trainlog.progress_rows(log, every=1, accum=2).orderBy("step").collect()
    assert [(r["epoch"], r["batch"], r["step"], r["secs"]) for r in got] == [(0, 1, 1, 1.0), (0, 3, 2, 3.0), (1, 1, 3, 2.0), (1, 3, 4, 6.0)]
    assert got[-1]["mean_seen"] == 3.0


def test_hot_groups_do_not_meet_by_group_alone(spark, monkeypatch):
    monkeypatch.setattr(candidates, "BROADCAST_GROUPS", 0)
    rows = [(1 if i % 3 else 2, i, (i * 7919 % 10007) / 7.0) for i in range(3000)]
    df = spark.createDataFrame(rows, "grp bigint, item bigint, score double")
    kept = candidates.top_k(df, 25)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [grp#" not in plan or "__salt" in plan.split("SortMergeJoin", 1)[1].split("\n")[0]
    for g in (1, 2):
        want = sorted((s for q, _, s in rows if q == g), reverse=True)[24]
        got = {r["item"] for r in kept.where(F.col("grp") == g).collect()}
        assert got == {i for q, i, s in rows if q == g and s >= want}
    p = candidates.softmax(df, 20.0).groupBy("grp").agg(F.sum("p").alias("p")).collect()
    assert all(abs(r["p"] - 1) < 1e-9 for r in p)


def test_softmax_of_values_far_apart(spark):
    rows = [("a", 1, 1e4), ("a", 2, 1e4 - 1), ("a", 3, -1e4), ("b", 1, -5e3), ("c", 1, 0.0), ("c", 2, 0.0), ("c", 3, -63.9)]
    df = spark.createDataFrame(rows, "grp string, item bigint, score double")
    got = {(r["grp"], r["item"]): r["p"] for r in candidates.softmax(df).collect()}
    assert got["a", 1] == pytest.approx(1 / (1 + math.exp(-1))) and got["a", 3] == 0.0
    assert got["b", 1] == pytest.approx(1.0) and got["c", 1] == pytest.approx(0.5)


def test_resumed_runs_go_on_from_the_last_checkpoint(spark):
    r = random.Random(3)
    length, accum, every = 20, 4, 3
    rows, want = [], []
    for run in range(3):
        line, saved, epoch = 0, 0, 0
        for attempt in range(5):
            step = saved  # as a training loop resumes
            for i in range(r.choice([1, 7, 30, 45, 64])):
                e, b = epoch + i // length, i % length
                skipped = r.random() < 0.1
                stepped = (b + 1) % accum == 0 and not skipped
                step += stepped
                if stepped and step % every == 0 or b == length - 1:
                    saved = step
                rows.append((run, line, e, b, r.random(), skipped))
                want.append((run, line, attempt, step, stepped))
                line += 1
            epoch = e if r.random() < 0.7 else max(0, e - 1)
    log = spark.createDataFrame(rows, "run bigint, line bigint, epoch bigint, batch bigint, loss double, skipped boolean").repartition(3)
    got = trainlog.resumed_steps(log.withColumn("ts", F.current_timestamp()), length, every, accum)
    assert sorted((g["run"], g["line"], g["attempt"], g["step"], g["stepped"]) for g in got.collect()) == want
    assert trainlog.resumed_steps(log.withColumn("ts", F.current_timestamp()).limit(0), length).count() == 0

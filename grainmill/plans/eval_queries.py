"""Scoring of generations, candidate draws and training-log analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from grainmill.operators import candidates, scoring, trainlog
from grainmill.plans.catalog import CANDIDATES, GENERATIONS, LOG, query, rounded
from grainmill.session import stage
from grainmill.sources import tables

GEN = f"with {GENERATIONS}"


@query("structure_flags", f"{GEN} select problem_id, sample_idx, has_step, has_answer, has_end, ok from marked")
def structure_flags(spark, d):
    return scoring.structure(tables.generations(spark, d)).select(
        "problem_id", "sample_idx", "has_step", "has_answer", "has_end", "ok"
    )


@query(
    "structure_ratio",
    f"{GEN} select count(*) as n, cast(sum(ok::int) as bigint) as passed, round(avg(ok::int) + 1e-9, 6) as ratio from marked",
)
def structure_ratio(spark, d):
    flagged = scoring.structure(tables.generations(spark, d))
    return scoring.pass_ratio(flagged).withColumn("ratio", rounded("ratio"))


@query(
    "structure_by_domain",
    f"""{GEN} select domain, count(*) as n, cast(sum(ok::int) as bigint) as passed, round(avg(ok::int) + 1e-9, 6) as ratio
        from marked group by domain""",
)
def structure_by_domain(spark, d):
    flagged = scoring.structure(tables.generations(spark, d))
    return scoring.pass_ratio(flagged, ["domain"]).withColumn("ratio", rounded("ratio"))


@query("extracted_answers", f"{GEN} select problem_id, sample_idx, answer from answered")
def extracted_answers(spark, d):
    return scoring.answers(tables.generations(spark, d)).select("problem_id", "sample_idx", "answer")


@query(
    "answer_correctness",
    f"""{GEN} select problem_id, sample_idx, expected,
          coalesce(contains(lower(answer), lower(expected)), false) as ok
        from answered join cases using (problem_id)""",
)
def answer_correctness(spark, d):
    answered = scoring.answers(tables.generations(spark, d))
    return answered.join(tables.eval_cases(spark, d), "problem_id").select(
        "problem_id", "sample_idx", "expected",
        scoring.answer_matches(F.col("answer"), F.col("expected")).alias("ok"),
    )


@query("majority_vote", f"{GEN} select problem_id, voted, votes from voted")
def majority_vote(spark, d):
    samples = scoring.answers(tables.generations(spark, d)).where("mode = 'sample'")
    return scoring.vote(samples)


@query(
    "consistency",
    f"""{GEN} select problem_id, '<|problem|>' || problem as prompt, expected, greedy, voted, greedy_ok, voted_ok
        from scored""",
)
def consistency(spark, d):
    return scoring.consistency(tables.eval_cases(spark, d), tables.generations(spark, d))


@query(
    "accuracy",
    f"""{GEN} select count(*) as n, round(avg(greedy_ok::int) * 100 + 1e-9, 6) as greedy_accuracy,
          round(avg(voted_ok::int) * 100 + 1e-9, 6) as voted_accuracy,
          round((sum(voted_ok::int) - sum(greedy_ok::int)) / count(*)::double * 100 + 1e-9, 6) as gain from scored""",
)
def accuracy(spark, d):
    scored = scoring.consistency(tables.eval_cases(spark, d), tables.generations(spark, d))
    return scoring.accuracy(scored).select(
        "n", *[rounded(c) for c in ("greedy_accuracy", "voted_accuracy", "gain")]
    )


@query(
    "output_previews",
    f"{GEN} select problem_id, sample_idx, substr(output, 1, 200) as head200, substr(output, 1, 300) as head300 from generations",
)
def output_previews(spark, d):
    return tables.generations(spark, d).select(
        "problem_id", "sample_idx",
        F.substring("output", 1, 200).alias("head200"), F.substring("output", 1, 300).alias("head300"),
    )


@query(
    "masked_loss",
    """select user_id as run, round(avg(case when event_id % 8 <> 0 then value / 100 end) + 1e-9, 6) as loss,
       count(*) filter (where event_id % 8 <> 0) as n_targets from events group by user_id""",
)
def masked_loss(spark, d):
    return scoring.masked_loss(tables.scored_tokens(spark, d), ["run"]).withColumn("loss", rounded("loss"))


# Candidate scores

K = 10


@query(
    "top_k_with_ties",
    f"""with {CANDIDATES} select grp, item, score from candidates
        qualify rank() over (partition by grp order by score desc) <= {K}""",
)
def top_k_with_ties(spark, d):
    return candidates.top_k(tables.candidates(spark, d), K).select("grp", "item", "score")


@query(
    "softmax",
    f"""with {CANDIDATES}, w as (
          select *, exp((score - max(score) over (partition by grp)) / 20.0) as e from candidates)
        select grp, item, round(e / sum(e) over (partition by grp) + 1e-9, 6) as p from w""",
)
def softmax(spark, d):
    p = candidates.softmax(tables.candidates(spark, d), 20.0)
    return p.select("grp", "item", rounded("p"))


@query(
    "candidate_draw",
    f"""with {CANDIDATES}, best as (
          select * from candidates qualify rank() over (partition by grp order by score desc) <= 50),
        keyed as (
          select *, score / 20.0
            - ln(-ln((cast('0x' || substr(md5('3-' || grp || '-' || item), 1, 13) as bigint) + 0.5::double) / 4503599627370496.0::double)) as k
          from best)
        select grp, item from keyed qualify row_number() over (partition by grp order by k desc, item) = 1""",
)
def candidate_draw(spark, d):
    return candidates.draw(tables.candidates(spark, d), 20.0, 50, seed=3, hash_name="md5")


@query("candidate_draw_xxhash")
def candidate_draw_xxhash(spark, d):
    return candidates.draw(tables.candidates(spark, d), 20.0, 50, seed=3)


@query(
    "greedy_item",
    f"""with {CANDIDATES} select grp, item from candidates
        qualify row_number() over (partition by grp order by score desc, item) = 1""",
)
def greedy_item(spark, d):
    return candidates.greedy(tables.candidates(spark, d))


# Training logs

LOGS = f"with {LOG}"


def staged_log(spark, d) -> DataFrame:
    """The numbered log as a table, for operators that read it several times."""
    return stage(tables.batch_log(spark, d), "batch-log")


@query(
    "running_loss",
    f"""{LOGS} select run, epoch, batch, seen, counted, round(total / seen + 1e-9, 6) as mean_seen,
          round(total / nullif(counted, 0) + 1e-9, 6) as mean_counted from running""",
)
def running_loss(spark, d):
    return trainlog.running_mean(staged_log(spark, d)).select(
        "run", "epoch", "batch", "seen", "counted",
        rounded("mean_seen"), rounded("mean_counted"),
    )


SUMMARY = """summary as (
  select run, epoch, count(*) as seen, count(*) filter (where not skipped) as counted,
    sum(case when skipped then 0 else loss end) / count(*) as mean_seen,
    sum(case when skipped then 0 else loss end) / greatest(count(*) filter (where not skipped), 1) as mean_counted,
    (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 as secs
  from log group by run, epoch
)"""


@query(
    "epoch_summary",
    f"""{LOGS}, {SUMMARY} select run, epoch, seen, counted, round(mean_seen + 1e-9, 6) as mean_seen,
          round(mean_counted + 1e-9, 6) as mean_counted, round(secs + 1e-9, 6) as secs from summary""",
)
def epoch_summary(spark, d):
    return trainlog.epoch_summary(tables.batch_log(spark, d)).select(
        "run", "epoch", "seen", "counted",
        *[rounded(c) for c in ("mean_seen", "mean_counted", "secs")],
    )


@query(
    "global_steps",
    f"{LOGS} select run, epoch, batch, cast(step as bigint) as step, stepped from stepping",
)
def global_steps(spark, d):
    return trainlog.global_steps(staged_log(spark, d)).select("run", "epoch", "batch", "step", "stepped")


@query(
    "every_nth_step",
    f"{LOGS} select run, epoch, batch, cast(step as bigint) as step from stepping where stepped and step % 50 = 0",
)
def every_nth_step(spark, d):
    steps = trainlog.global_steps(staged_log(spark, d))
    return steps.where(F.col("stepped") & trainlog.every_nth(F.col("step"), 50)).select("run", "epoch", "batch", "step")


@query(
    "progress_rows",
    f"""{LOGS} select run, epoch, batch, cast(step as bigint) as step, round(total / seen + 1e-9, 6) as mean_seen,
          round(total / counted + 1e-9, 6) as mean_counted, round(epoch_us(ts) / 1e6
            - min(epoch_us(ts)) over (partition by run, epoch) / 1e6 + 1e-9, 6) as secs
          from stepping qualify stepped and step % 100 = 0""",
)
def progress_rows(spark, d):
    return trainlog.progress_rows(staged_log(spark, d)).select(
        "run", "epoch", "batch", "step",
        rounded("mean_seen"), rounded("mean_counted"), rounded("secs"),
    )


def _checkpoints_sql(periodic: str, end: str) -> str:
    return f"""{LOGS}, manifest as (
          select run, epoch, batch, cast(step as bigint) as step, 'periodic' as kind, {periodic} as loss
          from stepping where stepped and step % 50 = 0
          union all
          select run, epoch, max(batch), cast(max(step) as bigint), 'epoch_end',
            sum(case when skipped then 0 else loss end) / {end}
          from stepping group by run, epoch)"""


MANIFEST_BASE = _checkpoints_sql("loss / 16", "count(*)")
MANIFEST_CPT = _checkpoints_sql("total / counted", "greatest(count(*) filter (where not skipped), 1)")
MANIFEST_COLUMNS = "run, epoch, batch, step, kind, round(loss + 1e-9, 6) as loss"


def _manifest(spark, d, recipe: str) -> DataFrame:
    return trainlog.checkpoints(staged_log(spark, d), recipe, every=50)


@query("checkpoints", f"{MANIFEST_BASE} select {MANIFEST_COLUMNS} from manifest")
def checkpoints(spark, d):
    return _manifest(spark, d, "base").withColumn("loss", rounded("loss"))


@query("checkpoints_cpt", f"{MANIFEST_CPT} select {MANIFEST_COLUMNS} from manifest")
def checkpoints_cpt(spark, d):
    return _manifest(spark, d, "cpt").withColumn("loss", rounded("loss"))


@query(
    "latest_checkpoint",
    f"""{MANIFEST_BASE} select {MANIFEST_COLUMNS} from manifest
        qualify row_number() over (partition by run order by epoch desc, (kind = 'epoch_end') desc, batch desc) = 1""",
)
def latest_checkpoint(spark, d):
    return trainlog.latest_checkpoint(_manifest(spark, d, "base")).withColumn("loss", rounded("loss"))


# Each run is stopped after every 700 lines, in its third epoch of 256 batches, and resumed with that epoch.
RESUMED = """numbered as (
  select user_id % 2 as run, value as loss, event_type = 'error' as skipped, ts,
    row_number() over (partition by user_id % 2 order by event_id) - 1 as line
  from events
),
resumed as (
  select run, line, line // 700 as attempt, 2 * (line // 700) + line % 700 // 256 as epoch, line % 700 % 256 as batch, loss, skipped, ts
  from numbered
)"""


def resumed_log(spark, d) -> DataFrame:
    log = tables.batch_log(spark, d)
    line = F.col("epoch") * 1024 + F.col("batch")
    within = F.expr("line % 700")
    return stage(log.select("run", line.alias("line"), "loss", "skipped", "ts"), "resumed-log").select(
        "run", "line", F.expr("2 * (line div 700) + line % 700 div 256").alias("epoch"), (within % 256).alias("batch"),
        "loss", "skipped", "ts")


@query(
    "resumed_steps",
    f"""with recursive {RESUMED},
        flagged as (
          select *, coalesce(row(epoch, batch) <= lag(row(epoch, batch)) over (partition by run order by line), false) as began,
            (batch + 1) % 16 = 0 and not skipped as stepped from resumed),
        tried as (select *, sum(began::int) over (partition by run order by line) as try from flagged),
        counted as (select *, sum(stepped::int) over (partition by run, try order by line) as local from tried),
        per as (
          select run, try, max(local) as steps, coalesce(max(local) filter (where batch = 255), 0) as ended
          from counted group by run, try),
        starts as (
          select run, 0::hugeint as try, 0::hugeint as start from per where try = 0
          union all
          select s.run, s.try + 1, greatest(s.start + p.ended, s.start,
            case when (s.start + p.steps) // 50 * 50 > s.start then (s.start + p.steps) // 50 * 50 else s.start end)
          from starts s join per p on p.run = s.run and p.try = s.try)
        select run, line, cast(try as bigint) as attempt, epoch, batch, stepped, cast(start + local as bigint) as step
        from counted join starts using (run, try)""",
)
def resumed_steps(spark, d):
    steps = trainlog.resumed_steps(resumed_log(spark, d), epoch_len=256, every=50)
    return steps.select("run", "line", "attempt", "epoch", "batch", "stepped", "step")


@query(
    "resumed_summary",
    f"""with {RESUMED}, log as (
          select * from resumed qualify row_number() over (partition by run, epoch, batch order by line desc) = 1),
        {SUMMARY} select run, epoch, seen, counted, round(mean_seen + 1e-9, 6) as mean_seen,
          round(mean_counted + 1e-9, 6) as mean_counted from summary""",
)
def resumed_summary(spark, d):
    """Epoch means over the last attempt at each batch."""
    return trainlog.epoch_summary(trainlog.last_attempts(resumed_log(spark, d), "line")).select(
        "run", "epoch", "seen", "counted", rounded("mean_seen"), rounded("mean_counted"))


@query(
    "epoch_series",
    f"""{LOGS}, {SUMMARY} select run, epoch, round(mean_seen + 1e-9, 6) as loss,
          round(mean_seen - lag(mean_seen) over (partition by run order by epoch) + 1e-9, 6) as delta from summary""",
)
def epoch_series(spark, d):
    return trainlog.epoch_series(staged_log(spark, d)).select(
        "run", "epoch", rounded("loss"), rounded("delta")
    )

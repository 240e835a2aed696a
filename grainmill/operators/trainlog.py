"""Analytics of batch logs ``(run, epoch, batch, loss, skipped, ts)``; skipped batches ran out of memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from grainmill.constants import CHECKPOINT_EVERY, GRAD_ACCUM, LOG_EVERY
from grainmill.operators.epochs import boundary
from grainmill.operators.ordering import prefix_sums
from grainmill.session import stage


def every_nth(step: Column, n: int) -> Column:
    return step % n == 0


def _counted_loss() -> Column:
    return F.when(F.col("skipped"), 0.0).otherwise(F.col("loss"))


def _takes_step(accum: int) -> Column:
    return boundary(F.col("batch"), accum) & ~F.col("skipped")


def running(log: DataFrame, accum: int = GRAD_ACCUM) -> DataFrame:
    """Adds, up to and including each batch of its epoch: batches ``seen``, batches ``counted`` (not
    skipped), ``total`` loss and optimizer steps ``epoch_steps``.

    An epoch is cut into ranges of batches, so one long epoch is spread over tasks.
    """
    one = F.lit(1).cast("bigint")
    own = {
        "seen": one,
        "counted": F.when(F.col("skipped"), 0).otherwise(1).cast("bigint"),
        "total": _counted_loss(),
        "epoch_steps": F.when(_takes_step(accum), 1).otherwise(0).cast("bigint"),
    }
    before = prefix_sums(log, ["run", "epoch"], ["batch"], own)
    return before.select(*log.columns, *[(F.col(c) + v).alias(c) for c, v in own.items()])


def mean_loss(denominator: str) -> Column:
    """Running or epoch mean: over batches ``seen`` (base) or ``counted`` (cpt)."""
    return F.col("total") / F.nullif(F.col(denominator), F.lit(0))


def running_mean(log: DataFrame) -> DataFrame:
    return (
        running(log)
        .withColumn("mean_seen", mean_loss("seen"))
        .withColumn("mean_counted", mean_loss("counted"))
    )


def _seconds(interval: Column) -> Column:
    units = (("DAY", 86400), ("HOUR", 3600), ("MINUTE", 60), ("SECOND", 1))
    return sum((F.date_part(F.lit(u), interval).cast("double") * n for u, n in units), F.lit(0.0))


def epoch_totals(log: DataFrame, accum: int = GRAD_ACCUM) -> DataFrame:
    return log.groupBy("run", "epoch").agg(
        F.count("*").alias("seen"),
        F.count_if(~F.col("skipped")).alias("counted"),
        F.sum(_counted_loss()).alias("total"),
        F.count_if(_takes_step(accum)).alias("epoch_steps"),
        F.max("batch").alias("last_batch"),
        F.min("ts").alias("began"),
        _seconds(F.max("ts") - F.min("ts")).alias("secs"),
    )


def epoch_summary(log: DataFrame) -> DataFrame:
    """Mean loss per epoch under both denominators, and its seconds."""
    return epoch_totals(log).select(
        "run", "epoch", "seen", "counted",
        (F.col("total") / F.col("seen")).alias("mean_seen"),
        (F.col("total") / F.greatest("counted", F.lit(1))).alias("mean_counted"),
        "secs",
    )


def _numbered_epochs(log: DataFrame, accum: int) -> DataFrame:
    """:func:`epoch_totals` plus ``steps_before``, the run's optimizer steps before each epoch. One row per epoch meets in a window."""
    before = Window.partitionBy("run").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    return stage(epoch_totals(log, accum), "epoch-totals").withColumn(
        "steps_before", F.coalesce(F.sum("epoch_steps").over(before), F.lit(0)))


def global_steps(log: DataFrame, accum: int = GRAD_ACCUM, epochs: DataFrame | None = None) -> DataFrame:
    """:func:`running` plus ``step``, the run's optimizer step after each batch, carried across epochs, and ``began``.

    A skipped batch on an accumulation boundary takes no step. The log holds each batch of a run once: where a resumed
    run has written an epoch again, pass it through :func:`last_attempts` first.
    """
    epochs = _numbered_epochs(log, accum) if epochs is None else epochs
    return (
        running(log, accum)
        .join(epochs.select("run", "epoch", "steps_before", "began"), ["run", "epoch"])
        .withColumn("step", F.col("steps_before") + F.col("epoch_steps"))
        .withColumn("stepped", _takes_step(accum))
        .drop("steps_before")
    )


def progress_rows(log: DataFrame, every: int = LOG_EVERY, accum: int = GRAD_ACCUM) -> DataFrame:
    """The rows a training loop prints: one per ``every`` optimizer steps, with the seconds since the epoch began."""
    return (
        global_steps(log, accum)
        .where(F.col("stepped") & every_nth(F.col("step"), every))
        .select(
            "run", "epoch", "batch", "step",
            mean_loss("seen").alias("mean_seen"), mean_loss("counted").alias("mean_counted"),
            _seconds(F.col("ts") - F.col("began")).alias("secs"),
        )
    )


def last_attempts(log: DataFrame, written: str = "ts") -> DataFrame:
    """The log with each batch once: of batches written again after a resume, the one written last."""
    columns = [c for c in log.columns if c not in ("run", "epoch", "batch")]
    latest = F.max_by(F.struct(*columns), F.col(written)).alias("last")
    return log.groupBy("run", "epoch", "batch").agg(latest).select("run", "epoch", "batch", "last.*").select(*log.columns)


def attempts(log: DataFrame) -> DataFrame:
    """The log with ``attempt``, from 0 in each run, and ``resumed``, whether a line begins one.

    ``log`` has ``line``, the place of each line in its run's log, without gaps. A run that resumes writes an epoch and
    batch again that it has written before, so an attempt begins where these do not ascend from the line before.
    """
    before = log.select(
        "run", (F.col("line") + 1).alias("line"), F.struct("epoch", "batch").alias("__before"))
    flagged = log.join(before, ["run", "line"], "left").withColumn(
        "resumed", F.coalesce(F.struct("epoch", "batch") <= F.col("__before"), F.lit(False))).drop("__before")
    began = F.col("resumed").cast("bigint")
    return prefix_sums(stage(flagged, "attempts"), ["run"], ["line"], {"attempt": began}).withColumn(
        "attempt", F.col("attempt") + began)


def resumed_steps(
    log: DataFrame, epoch_len: int, every: int = CHECKPOINT_EVERY, accum: int = GRAD_ACCUM
) -> DataFrame:
    """:func:`attempts` plus ``stepped`` and ``step``, the optimizer step after each line.

    An attempt goes on from the last checkpoint written before it began: a periodic one after every ``every`` steps of
    the run's count, or one at the end of an epoch, its ``epoch_len``-th batch; from 0 if there is none. Steps are
    counted within attempts; where each starts then follows from the attempts before it, one row for each attempt.
    """
    tried = attempts(log)
    took = _takes_step(accum)
    counted = stage(
        prefix_sums(tried, ["run", "attempt"], ["line"], {"local": took.cast("bigint")})
        .withColumn("stepped", took).withColumn("local", F.col("local") + took.cast("bigint")), "attempt-steps")
    per = counted.groupBy("run", "attempt").agg(
        F.max("local").alias("steps"), F.max(F.when(F.col("batch") == epoch_len - 1, F.col("local"))).alias("ended"))
    # A few rows for each run: how often it was resumed.
    tries = per.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("attempt", "steps", "ended"))).alias("tries"))

    def follow(state: Column, a: Column) -> Column:
        start = state["next"]
        periodic = F.expr(f"{every}L") * F.floor((start + a["steps"]) / F.lit(every))
        reached = F.greatest(F.when(periodic > start, periodic), start + a["ended"], start)
        return F.struct(
            F.array_append(state["starts"], F.struct(a["attempt"].alias("attempt"), start.alias("start"))).alias("starts"),
            reached.cast("bigint").alias("next"))

    zero = F.struct(
        F.array().cast("array<struct<attempt:bigint,start:bigint>>").alias("starts"), F.lit(0).cast("bigint").alias("next"))
    starts = tries.select("run", F.explode(F.aggregate("tries", zero, follow, lambda s: s["starts"])).alias("s")).select("run", "s.*")
    return counted.join(starts, ["run", "attempt"]).select(
        *tried.columns, "stepped", (F.col("start") + F.col("local")).alias("step"))


def checkpoints(
    log: DataFrame, recipe: str = "base", every: int = CHECKPOINT_EVERY, accum: int = GRAD_ACCUM
) -> DataFrame:
    """``(run, epoch, batch, step, kind, loss)``: periodic checkpoints and one at each epoch end.

    The base recipe stores the micro-batch loss divided by the accumulation factor in periodic ones;
    the cpt recipe stores the running mean. Epoch ends store the epoch mean.
    """
    ends = _numbered_epochs(log, accum)
    steps = global_steps(log, accum, ends)
    periodic_loss = F.col("loss") / accum if recipe == "base" else mean_loss("counted")
    periodic = steps.where(F.col("stepped") & every_nth(F.col("step"), every)).select(
        "run", "epoch", "batch", "step", F.lit("periodic").alias("kind"), periodic_loss.alias("loss")
    )
    mean = F.col("total") / (F.col("seen") if recipe == "base" else F.greatest("counted", F.lit(1)))
    end_rows = ends.select(
        "run", "epoch", F.col("last_batch").alias("batch"),
        (F.col("steps_before") + F.col("epoch_steps")).alias("step"),
        F.lit("epoch_end").alias("kind"), mean.alias("loss"),
    )
    return periodic.unionByName(end_rows)


def latest_checkpoint(manifest: DataFrame) -> DataFrame:
    """The checkpoint written last in each run."""
    order = F.struct("epoch", (F.col("kind") == "epoch_end"), "batch")
    row = F.struct("epoch", "batch", "step", "kind", "loss")
    return manifest.groupBy("run").agg(F.max_by(row, order).alias("r")).select("run", "r.*")


def epoch_series(log: DataFrame) -> DataFrame:
    """Mean loss per epoch and its change from the run's epoch before, whatever that one's number. A row per epoch."""
    series = epoch_summary(log).select("run", "epoch", F.col("mean_seen").alias("loss"))
    before = F.lag("loss").over(Window.partitionBy("run").orderBy("epoch"))
    return series.select("run", "epoch", "loss", (F.col("loss") - before).alias("delta"))

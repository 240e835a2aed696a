"""Scoring of generated text: structure, extracted answers, votes and accuracies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from grainmill.constants import ANSWER, END, PAD_ID, STEP
from grainmill.functions.text import answer_matches, extract_answer, prompt


def structure(generations: DataFrame, output: str = "output") -> DataFrame:
    """Adds which markers an output has; ``ok`` needs a step and an answer."""
    def has(m: str) -> Column:
        return F.contains(F.col(output), F.lit(m))

    return (
        generations.withColumn("has_step", has(STEP))
        .withColumn("has_answer", has(ANSWER))
        .withColumn("has_end", has(END))
        .withColumn("ok", F.col("has_step") & F.col("has_answer"))
    )


def pass_ratio(flagged: DataFrame, by: list[str] | None = None, ok: str = "ok") -> DataFrame:
    """Share of rows that pass, NULL when there are none."""
    return flagged.groupBy(*(by or [])).agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(F.col(ok).cast("bigint")), F.lit(0)).alias("passed"),
        F.avg(F.col(ok).cast("double")).alias("ratio"),
    )


def answers(generations: DataFrame) -> DataFrame:
    return generations.withColumn("answer", extract_answer(F.col("output")))


def vote(answered: DataFrame) -> DataFrame:
    """Most frequent answer per problem, ties to the one met first; problems without answers are absent.

    ``answered`` has ``(problem_id, sample_idx, answer)``. Equal answers are counted before the problem
    is brought together, so a problem with very many samples is spread over tasks.
    """
    counted = (
        answered.where(F.col("answer").isNotNull())
        .groupBy("problem_id", "answer")
        .agg(F.count("*").alias("c"), F.min("sample_idx").alias("f"))
    )
    return counted.groupBy("problem_id").agg(
        F.max_by("answer", F.struct("c", -F.col("f"))).alias("voted"),
        F.max("c").alias("votes"),
    )


def consistency(cases: DataFrame, generations: DataFrame) -> DataFrame:
    """Per case: the prompt, greedy and voted answer and whether each is right.

    Greedy and sampled outputs share one pass: answers are counted once, with the two modes apart.
    """
    sampled = F.col("mode") == "sample"
    counted = (
        answers(generations)
        .where(F.col("answer").isNotNull())
        .groupBy("problem_id", "answer")
        .agg(
            F.count_if(sampled).alias("c"),
            F.min(F.when(sampled, F.col("sample_idx"))).alias("f"),
            F.max(F.when(~sampled, F.lit(1)).otherwise(0)).alias("g"),
        )
    )
    per_problem = counted.groupBy("problem_id").agg(
        F.max(F.when(F.col("g") == 1, F.col("answer"))).alias("greedy"),
        F.expr("max_by(answer, struct(c, -f)) filter (where c > 0)").alias("voted"),
    )
    return cases.join(per_problem, "problem_id", "left").select(
        "problem_id",
        prompt(F.col("problem")).alias("prompt"),
        "expected",
        "greedy",
        "voted",
        answer_matches(F.col("greedy"), F.col("expected")).alias("greedy_ok"),
        answer_matches(F.col("voted"), F.col("expected")).alias("voted_ok"),
    )


def accuracy(scored: DataFrame) -> DataFrame:
    """Greedy and voted accuracy in percent and the signed gain of voting."""
    g, v = F.col("greedy_ok").cast("double"), F.col("voted_ok").cast("double")
    return scored.agg(
        F.count("*").alias("n"),
        (F.avg(g) * 100).alias("greedy_accuracy"),
        (F.avg(v) * 100).alias("voted_accuracy"),
        ((F.sum(v) - F.sum(g)) / F.nullif(F.count("*"), F.lit(0)) * 100).alias("gain"),
    )


def masked_loss(tokens: DataFrame, by: list[str]) -> DataFrame:
    """Mean negative log-probability over targets that are not padding; NULL and 0 for a group of padding only."""
    real = F.col("target") != PAD_ID
    return tokens.groupBy(*by).agg(
        F.avg(F.when(real, -F.col("logprob"))).alias("loss"), F.count_if(real).alias("n_targets")
    )

"""Token-budget mixtures: budgets, kept prefixes, positions and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F

from grainmill.operators.ordering import prefix_sums


def budgets(weights: DataFrame, total: int | Column) -> DataFrame:
    """``(pos, name, weight, budget)`` with ``budget = floor(total * weight)`` in DOUBLE arithmetic."""
    total = total if isinstance(total, Column) else F.lit(total)
    return weights.withColumn(
        "budget", F.floor(total.cast("double") * F.col("weight")).cast("bigint")
    )


def known(weights: DataFrame, registry: DataFrame) -> DataFrame:
    return weights.join(F.broadcast(registry), "name", "left_semi")


def skipped(weights: DataFrame, registry: DataFrame) -> DataFrame:
    """Weighted sources no recipe rule exists for; their budget is not redistributed."""
    return weights.join(F.broadcast(registry), "name", "left_anti")


def attach_budget(docs: DataFrame, budget: DataFrame) -> DataFrame:
    """Documents of weighted sources with their ``pos`` and ``budget``; one small row per source is broadcast."""
    b = budget.select(F.col("name").alias("source"), "pos", "budget")
    return docs.join(F.broadcast(b), "source")


def within_budget() -> Column:
    """Keep while the tokens before a document are under budget; a source's first document always stays."""
    return (F.col("cum_before") < F.col("budget")) | (F.col("docs_before") == 0)


def budget_prefix(docs: DataFrame, n_tokens: Column) -> DataFrame:
    """The kept documents of each source.

    ``docs`` has ``(source, ord, budget, ...)``. Adds ``n_tokens``, ``cum_before`` and ``docs_before``.
    The document that crosses the budget is kept.
    """
    counted = docs.withColumn("n_tokens", n_tokens.cast("bigint"))
    return prefix_sums(
        counted, ["source"], ["ord"],
        {"cum_before": F.col("n_tokens"), "docs_before": F.lit(1).cast("bigint")},
        keep=within_budget(), carry=["budget"],
    )


def source_offsets(kept: DataFrame) -> DataFrame:
    """Global token and document offset of each source, sources in weight order (a handful of rows)."""
    per = kept.groupBy("source", "pos").agg(
        F.sum("n_tokens").alias("src_tokens"), F.count("*").alias("src_docs")
    )
    # One row per source comes together here; a recipe's registry fixes how many there are.
    w = Window.partitionBy(F.lit(0)).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return per.select(
        "source", "src_tokens", "src_docs",
        F.coalesce(F.sum("src_tokens").over(w), F.lit(0)).alias("token_offset"),
        F.coalesce(F.sum("src_docs").over(w), F.lit(0)).alias("doc_offset"),
    )


def with_positions(kept: DataFrame) -> DataFrame:
    """Add each kept document's ``start`` in the global token stream and its document index ``doc_no``."""
    offs = source_offsets(kept).select("source", "token_offset", "doc_offset")
    return (
        kept.join(F.broadcast(offs), "source")
        .withColumn("start", F.col("token_offset") + F.col("cum_before"))
        .withColumn("doc_no", F.col("doc_offset") + F.col("docs_before"))
        .drop("token_offset", "doc_offset")
    )


def source_totals(kept: DataFrame) -> DataFrame:
    return kept.groupBy("source").agg(
        F.count("*").alias("samples"), F.sum("n_tokens").alias("tokens")
    )


def observe_sources(kept: DataFrame, sources: list[str]) -> tuple[DataFrame, Observation]:
    """``kept``, counting samples and tokens of each source whenever it is written."""
    observed, metrics = Observation(), []
    for i, name in enumerate(sources):
        own = F.col("source") == name
        metrics += [F.count_if(own).alias(f"samples_{i}"), F.sum(F.when(own, F.col("n_tokens")).otherwise(0)).alias(f"tokens_{i}")]
    return kept.observe(observed, *metrics), observed


def observed_totals(spark: SparkSession, sources: list[str], observed: Observation) -> DataFrame:
    """What :func:`observe_sources` has counted, in the shape of :func:`source_totals`."""
    seen = observed.get
    rows = [(name, seen[f"samples_{i}"], seen[f"tokens_{i}"] or 0) for i, name in enumerate(sources)]
    return spark.createDataFrame(rows, "source string, samples bigint, tokens bigint").where("samples > 0")


def build_report(budget: DataFrame, registry: DataFrame, kept: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """One row per weighted source: budget, samples, tokens, status and unfilled budget. ``totals`` are those of ``kept``.

    ``status`` is ``skipped`` (no rule), ``reached`` or ``exhausted``.
    """
    marked = budget.join(
        F.broadcast(registry.withColumn("is_known", F.lit(True))), "name", "left"
    )
    totals = (source_totals(kept) if totals is None else totals).withColumnRenamed("source", "name")
    tokens = F.coalesce("tokens", F.lit(0))
    return (
        marked.join(totals, "name", "left")
        .select(
            "pos",
            F.col("name").alias("source"),
            "budget",
            F.coalesce("samples", F.lit(0)).alias("samples"),
            tokens.alias("tokens"),
            F.when(F.col("is_known").isNull(), "skipped")
            .when(tokens >= F.col("budget"), "reached")
            .otherwise("exhausted")
            .alias("status"),
            F.greatest(F.col("budget") - tokens, F.lit(0)).alias("shortfall"),
        )
    )

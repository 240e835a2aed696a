"""Recipes: which sources are known, how a row becomes a document, which rows are dropped.

All sources travel in one relation ``(source, ord, head, tail)``: ``head`` is the text or question,
``tail`` the answer (NULL for plain text). A recipe is a CASE over ``source``, so a whole corpus is
formatted and filtered in one scan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from grainmill.constants import BASE_WEIGHTS, CPT_WEIGHTS, END, PROBLEM, STEP, STORY_PROMPT, WEB_PROMPT
from grainmill.functions.text import strip
from grainmill.operators.ordering import first_n_per_part

CONFIG_SHIFT = 40  # sources made of several configs use ord = config position * 2**40 + row number


@dataclass(frozen=True)
class SourceRule:
    """``text(head, tail)`` formats a row; ``keep(head, tail)`` drops it when false or NULL.

    ``cap_extra`` is 1 for sources whose row cap lets one more row through.
    """

    text: Callable[[Column, Column], Column]
    keep: Callable[[Column, Column], Column] | None = None
    has_tail: bool = False
    cap_extra: int = 0


@dataclass(frozen=True)
class Recipe:
    rules: dict[str, SourceRule]
    weights: list[tuple[str, float]]
    append_end: bool
    clean_weights: list[tuple[str, float]] = field(default_factory=list)


def _prompted(head: Column, tail: Column) -> Column:
    return F.concat(F.lit(PROBLEM), head, F.lit(STEP), tail, F.lit(END))


def _fixed_prompt(prompt: str, body: Column) -> Column:
    return F.concat(F.lit(PROBLEM + prompt + STEP), body, F.lit(END))


def _plain(head: Column, tail: Column) -> Column:
    return F.concat(strip(head), F.lit(END))


def _two_lines(head: Column, tail: Column) -> Column:
    return F.concat(strip(head), F.lit("\n"), strip(tail), F.lit(END))


def at_least(n: int) -> Callable[[Column, Column], Column]:
    return lambda head, tail: F.length(strip(head)) >= n


def longer_than(n: int) -> Callable[[Column, Column], Column]:
    return lambda head, tail: F.length(strip(head)) > n


RECIPES: dict[str, Recipe] = {
    "base": Recipe(
        rules={
            "tinystories": SourceRule(lambda h, t: _fixed_prompt(STORY_PROMPT, h), cap_extra=1),
            "metamathqa": SourceRule(_prompted, has_tail=True, cap_extra=1),
            "gsm8k": SourceRule(_prompted, has_tail=True, cap_extra=1),
            "arc": SourceRule(_prompted, has_tail=True),
            "openwebmath": SourceRule(
                lambda h, t: _fixed_prompt(WEB_PROMPT, strip(h)), longer_than(100)
            ),
        },
        weights=BASE_WEIGHTS,
        append_end=True,
    ),
    "cpt": Recipe(
        rules={
            "tinystories": SourceRule(_plain, at_least(50)),
            "wikipedia": SourceRule(_plain, at_least(200)),
            "bookcorpus": SourceRule(_plain, at_least(100)),
            "metamathqa": SourceRule(_two_lines, has_tail=True),
            "gsm8k": SourceRule(_two_lines, has_tail=True),
        },
        weights=CPT_WEIGHTS,
        append_end=False,
        clean_weights=[("bookcorpus" if n == "bookscorpus" else n, w) for n, w in CPT_WEIGHTS],
    ),
}


def register_source(recipe: str, name: str, rule: SourceRule, weight: float | None = None) -> None:
    """Add a source to a recipe; with a weight it also takes part in the mixture."""
    r = RECIPES[recipe]
    weights = r.weights if weight is None else [*r.weights, (name, weight)]
    RECIPES[recipe] = replace(r, rules={**r.rules, name: rule}, weights=weights)


def _by_source(rules: dict[str, SourceRule], value: Callable[[SourceRule], Column]) -> Column:
    first, *rest = rules.items()
    out = F.when(F.col("source") == first[0], value(first[1]))
    for name, rule in rest:
        out = out.when(F.col("source") == name, value(rule))
    return out


def document_text(recipe: str, source: str | None = None) -> Column:
    """The formatted document, for one source or as a CASE over ``source``."""
    rules = RECIPES[recipe].rules
    head, tail = F.col("head"), F.col("tail")
    if source is not None:
        return rules[source].text(head, tail)
    return _by_source(rules, lambda r: r.text(head, tail))


def survives(recipe: str, source: str | None = None) -> Column:
    """Whether a row of a known source passes its recipe's filter and has no NULL field."""
    rules = RECIPES[recipe].rules
    head, tail = F.col("head"), F.col("tail")

    def one(r: SourceRule) -> Column:
        present = head.isNotNull() & tail.isNotNull() if r.has_tail else head.isNotNull()
        return present if r.keep is None else present & r.keep(head, tail)

    return one(rules[source]) if source is not None else _by_source(rules, one)


def prepare(raw: DataFrame, recipe: str = "base", cap: int | None = None, compat: bool = True) -> DataFrame:
    """Filtered, formatted documents ``(source, ord, text)`` of the recipe's sources.

    ``cap`` keeps the first ``cap`` surviving rows per source in ``ord`` order. Where the reference
    behaviour lets one more row (or, for 0, one row) through, ``compat=False`` makes the cap exact.
    """
    rules = RECIPES[recipe].rules
    kept = raw.where(F.col("source").isin(list(rules))).where(survives(recipe))
    if cap is not None:
        def limit(r: SourceRule) -> Column:
            if not compat:
                return F.lit(cap)
            return F.lit(cap + 1) if r.cap_extra else F.greatest(F.lit(cap), F.lit(1))

        kept = first_n_per_part(kept, ["source"], "ord", _by_source(rules, limit).cast("bigint"))
    return kept.select("source", "ord", document_text(recipe).alias("text"))


def rejects(raw: DataFrame, recipe: str = "base") -> DataFrame:
    """Rows of known sources with a NULL field, counted per source."""
    rules = RECIPES[recipe].rules
    null_field = _by_source(
        rules,
        lambda r: F.col("head").isNull() | F.col("tail").isNull() if r.has_tail else F.col("head").isNull(),
    )
    return (
        raw.where(F.col("source").isin(list(rules)))
        .where(null_field)
        .groupBy("source")
        .agg(F.count("*").alias("n_rejected"))
    )


def weights(spark: SparkSession, recipe: str = "base", compat: bool = True) -> DataFrame:
    """Mixture weights ``(pos, name, weight)`` in declaration order."""
    r = RECIPES[recipe]
    pairs = r.weights if compat or not r.clean_weights else r.clean_weights
    return spark.createDataFrame(
        [(i, n, w) for i, (n, w) in enumerate(pairs)], "pos int, name string, weight double"
    )


def registry(spark: SparkSession, recipe: str = "base") -> DataFrame:
    return spark.createDataFrame([(n,) for n in RECIPES[recipe].rules], "name string")

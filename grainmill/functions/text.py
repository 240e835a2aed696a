"""Scalar text helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from grainmill.constants import ANSWER, END, PRETOKEN, PROBLEM, SPECIAL_TOKENS, STEP, WHITESPACE


def strip(c: Column) -> Column:
    """Trim the full Unicode whitespace set, not only U+0020."""
    return F.trim(c, F.lit(WHITESPACE))


def one_line(c: Column) -> Column:
    return F.replace(c, F.lit("\n"), F.lit(" "))


def null_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def prompt_with_step(c: Column) -> Column:
    return F.concat(F.lit(PROBLEM), c, F.lit(STEP))


def prompt(c: Column) -> Column:
    return F.concat(F.lit(PROBLEM), c)


def extract_answer(c: Column) -> Column:
    """Text after the last answer marker and before the next end marker; NULL if absent or empty."""
    tail = F.substring_index(c, ANSWER, -1)
    return F.when(F.contains(c, F.lit(ANSWER)), null_if_empty(strip(F.substring_index(tail, END, 1))))


def answer_matches(answer: Column, expected: Column) -> Column:
    """Case-insensitive substring test; a missing answer is wrong."""
    return F.coalesce(F.contains(F.lower(answer), F.lower(expected)), F.lit(False))


def pretokens(c: Column) -> Column:
    """Split text into byte-level pre-tokens; the pieces concatenate back to the text."""
    return F.regexp_extract_all(c, F.lit("(?U)" + PRETOKEN), F.lit(0))


def pretokens_atomic(c: Column) -> Column:
    """As :func:`pretokens`, but reserved markers are cut out first and kept whole."""
    any_marker = "|".join(t.replace("|", r"\|") for t in SPECIAL_TOKENS)
    parts = F.split(c, f"(?<={any_marker})|(?={any_marker})")
    return F.flatten(
        F.transform(parts, lambda p: F.when(p.isin(SPECIAL_TOKENS), F.array(p)).otherwise(pretokens(p)))
    )

"""Text corpora: blank-line separated documents, and one document per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from grainmill.constants import TOKENIZER_CORPUS
from grainmill.functions.text import one_line, strip
from grainmill.operators.ordering import first_n_per_part
from grainmill.operators.recipes import CONFIG_SHIFT


def stripped_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows with stripped, non-empty text."""
    return df.withColumn(text, strip(F.col(text))).where(F.col(text) != "")


def write_documents(df: DataFrame, path: str, text: str = "text") -> None:
    """Each document followed by a blank line, in sharded part files."""
    stripped_texts(df, text).select(F.concat(F.col(text), F.lit("\n"))).write.text(path)


def write_lines(df: DataFrame, path: str, line: str = "line") -> None:
    """One document per line; inner newlines become spaces."""
    df.select(one_line(F.col(line))).write.text(path)


def corpus_line() -> Column:
    """Question and answer joined by one space, or the plain text."""
    return F.concat_ws(" ", "head", "tail")


def tokenizer_corpus(
    raw: DataFrame, caps: list[tuple[str, int | None]] | None = None, all_configs: bool = False
) -> DataFrame:
    """``(src_pos, source, ord, line)``: the rows of each source, sources in the given order.

    All rows unless ``caps`` names a number for a source; pass ``TOKENIZER_CORPUS`` for the usual numbers. Of
    multi-config sources only the first config is used unless ``all_configs``.
    """
    caps = [(s, None) for s, _ in TOKENIZER_CORPUS] if caps is None else caps
    positions = F.create_map(*[F.lit(x) for i, (s, _) in enumerate(caps) for x in (s, i)])
    cap = None
    for source, n in caps:
        if n is not None:
            is_source = F.col("source") == source
            cap = F.when(is_source, n) if cap is None else cap.when(is_source, n)
    picked = raw.where(F.col("source").isin([s for s, _ in caps]) & F.col("head").isNotNull())
    if not all_configs:
        picked = picked.where(F.col("ord") < (1 << CONFIG_SHIFT))
    if cap is not None:
        picked = first_n_per_part(picked, ["source"], "ord", cap.cast("bigint"))
    return picked.select(
        positions[F.col("source")].alias("src_pos"), "source", "ord", one_line(corpus_line()).alias("line")
    )

"""Quality rules with adaptive thresholds.

Every document gets a few integer measures. For each (language, source) a mergeable quantile sketch of every measure is
kept: counts of values rounded down to SIGNIFICANT leading bits, so a quantile is off by less than 1/32 of itself.
Counts of any two parts of the corpus add up to the sketch of both, exactly and in any order. Fences come from the
median and lower quartile of a document's own group, which junk in less than half of it does not move, of its language
or of all documents, whichever is the first with enough members. A group's fences stay within those of its language at
twice the spread, so that a bad source does not excuse itself. They are joined back to filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from grainmill.llm.common import hidden, words
from grainmill.session import stage, stage_counted

WINDOW = 8
SIGNIFICANT = 6
MIN_GROUP = 50  # documents a sketch needs before its quartiles are used
SPREAD = 4  # a fence lies so many distances from median to lower quartile away from the median
BROADCAST_GROUPS = 20_000  # fences of so many groups, about 1 MB, may be broadcast
SALTS = 32  # beyond that, each group's fences are copied to so many keys

# Measure -> (lower fence used, upper fence used, least distance counted from median to lower quartile).
MEASURES = {
    "word_length": (True, True, 20),  # hundredths of a character
    "symbol_rate": (False, True, 10),  # symbols per 1,000 characters of words
    "dup_line_rate": (False, True, 80),  # repeated lines per 1,000 lines
    "repeat_rate": (False, True, 50),  # words in repeated windows per 1,000 words
    "stutter_rate": (False, True, 15),  # words equal to the next one per 1,000 words
}


def repeated_words(tokens: Column) -> Column:
    """Words covered by windows of WINDOW words that occur twice or more in the text.

    Windows are compared by 64-bit hash. Texts without an equal pair of hashes, nearly all, stop there; in the others
    sorting (hash, place) puts equal windows side by side and the gaps between their places give the cover.
    """
    n = F.size(tokens)
    hashes = F.transform(
        F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(tokens, i, F.lit(WINDOW)))
    )

    def cover(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twins(p: Column) -> Column:
            twin = lambda t, k: (F.get(p, k - 1)["h"] == t["h"]) | (F.get(p, k + 1)["h"] == t["h"])
            hit = F.filter(p, lambda t, k: F.coalesce(twin(t, k), F.lit(False)))
            return F.sort_array(F.transform(hit, lambda t: t["i"]))

        def span(at: Column) -> Column:
            gap = lambda x, k: F.least(F.coalesce(F.get(at, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))
            return F.aggregate(F.transform(at, gap), F.lit(0), lambda a, x: (a + x).cast("int"))

        return _let(_let(placed, twins), span)

    counted = _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), cover(h)).otherwise(0))
    return F.when(n > WINDOW, counted).otherwise(0).cast("bigint")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def base_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stutters, n_lines and base_failed."""
    tok, lines = hidden(docs, "tok", "lines")
    text = F.coalesce(F.col(text_col), F.lit(""))
    with_word = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    measured = docs.withColumns({tok: words(text), lines: with_word}).withColumns({
        "n_words": F.size(tok).cast("bigint"),
        "word_chars": F.length(F.array_join(tok, "")).cast("bigint"),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("bigint"),
        "n_lines": F.size(lines).cast("bigint"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"),
        "n_repeat_words": repeated_words(F.col(tok)),
        "n_stutters": F.size(F.filter(F.col(tok), lambda x, i: x == F.get(F.col(tok), i + 1))).cast("bigint"),
    }).drop(tok, lines)
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    return measured.withColumn("base_failed", failed)


def _measures() -> dict[str, Column]:
    def rate(top: str, of: str, scale: int) -> Column:
        return F.coalesce(F.call_function("div", F.col(top) * scale, F.nullif(F.col(of), F.lit(0))), F.lit(0))

    return {
        "word_length": rate("word_chars", "n_words", 100),
        "symbol_rate": rate("n_symbols", "word_chars", 1000),
        "dup_line_rate": rate("n_dup_lines", "n_lines", 1000),
        "repeat_rate": rate("n_repeat_words", "n_words", 1000),
        "stutter_rate": rate("n_stutters", "n_words", 1000),
    }


def _rounded(x: Column) -> Column:
    """Leading SIGNIFICANT bits of a count, the others zero."""
    drop = F.greatest(F.length(F.bin(x)) - SIGNIFICANT, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", x, drop), drop)


def sketches(measured: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measure, value, n): the sketches of all groups, counted before anything is shuffled."""
    each = F.array(*[F.struct(F.lit(m).alias("measure"), _rounded(c).alias("value")) for m, c in _measures().items()])
    rows = measured.select(*keys, F.inline(each))
    return rows.groupBy(*keys, "measure", "value").agg(F.count(F.lit(1)).alias("n"))


def quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, members, {measure}_q1, {measure}_q2) from merged sketches."""
    merged = sketch.groupBy(*keys, "measure", "value").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure")
    upto = F.sum("n").over(group.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    placed = merged.select(*keys, "measure", "value", upto.alias("upto"), F.sum("n").over(group).alias("total"))
    found = [F.max("total").alias("members")]
    for m in MEASURES:
        for q in (1, 2):
            at = F.when((F.col("measure") == m) & (F.col("upto") * 4 >= F.col("total") * q), F.col("value"))
            found.append(F.min(at).alias(f"{m}_q{q}"))
    return placed.groupBy(*keys).agg(*found)


def fences(sketch: DataFrame, lang: str, source: str, names_of: dict[str, str], min_group: int = MIN_GROUP) -> DataFrame:
    """(lang, source) and the fences, named by ``names_of``, from the finest sketch that has ``min_group`` members."""
    own = quartiles(sketch, [lang, source])
    names = [c for c in own.columns if c not in (lang, source)]
    by_lang = quartiles(sketch, [lang]).select(F.col(lang).alias("of_lang"), F.struct(*names).alias("wide"))
    everything = quartiles(sketch.withColumn("all", F.lit(1)), ["all"]).select(*names).first()
    joined = own.join(by_lang, F.col(lang).eqNullSafe(F.col("of_lang")), "left")
    out = []
    for m, (low, high, least) in MEASURES.items():
        def wide(q: str) -> Column:
            overall = F.lit(everything[f"{m}_{q}"] if everything else 0)
            return F.when(F.col("wide.members") >= min_group, F.col(f"wide.{m}_{q}")).otherwise(overall)

        def own_or_wide(q: str) -> Column:
            return F.when(F.col("members") >= min_group, F.col(f"{m}_{q}")).otherwise(wide(q))

        reach = lambda of: F.greatest(of("q2") - of("q1"), F.lit(least)) * SPREAD
        if low:
            out.append(F.greatest(own_or_wide("q2") - reach(own_or_wide), wide("q2") - 2 * reach(wide)).alias(names_of[f"{m}_low"]))
        if high:
            out.append(F.least(own_or_wide("q2") + reach(own_or_wide), wide("q2") + 2 * reach(wide)).alias(names_of[f"{m}_high"]))
    return joined.select(lang, source, *out)


def apply_rules(
    docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", keep_text: bool = False,
    min_group: int = MIN_GROUP,
) -> DataFrame:
    """All columns of ``docs`` (the text only with ``keep_text``), the counts of :func:`base_counts`, and kept.

    With ``keep_text`` texts are read and counted twice, for the sketches and for the filter, instead of written to the
    shared folder once more; otherwise the counts are.

    NULL or empty text has no words and fails. NULL languages and sources form groups of their own. An empty table
    gives no rows. Columns of ``docs`` named like a count are replaced.
    """
    docs = docs.drop("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stutters", "base_failed", "kept")
    lang, source = hidden(docs, "lang", "source")
    measured = base_counts(docs, text_col).withColumns({lang: F.col(lang_col), source: F.col(source_col)})
    bar = None
    if keep_text:
        # Not deterministic, so that the filter stays above the counts instead of being written out in terms of the text.
        (bar,) = hidden(measured, "bar")
        measured = measured.withColumn(bar, F.rand(0))
    else:
        measured = stage(measured.drop(text_col), "measured")
    edges = [f"{m}_{side}" for m in MEASURES for side in ("low", "high")]
    names_of = dict(zip(edges, hidden(measured, *edges)))
    counted = stage(sketches(measured, [lang, source]), "sketches")
    table, groups = stage_counted(fences(counted, lang, source, names_of, min_group), "fences")
    key_l, key_s, salt = hidden(measured, "key_l", "key_s", "salt")
    table = table.withColumnsRenamed({lang: key_l, source: key_s})
    met = measured[lang].eqNullSafe(F.col(key_l)) & measured[source].eqNullSafe(F.col(key_s))
    if groups <= BROADCAST_GROUPS:
        joined = measured.join(F.broadcast(table), met)
    else:
        copies = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        spread = measured.withColumn(f"{salt}2", F.pmod(F.xxhash64("n_words", "word_chars", "n_symbols"), F.lit(SALTS)))
        joined = spread.join(copies, met & (F.col(f"{salt}2") == F.col(salt))).drop(salt, f"{salt}2")
    inside = ~F.col("base_failed")
    if bar:
        inside &= F.col(bar) >= 0  # always
    for m, value in _measures().items():
        low, high, _ = MEASURES[m]
        if low:
            inside &= value >= F.col(names_of[f"{m}_low"])
        if high:
            inside &= value <= F.col(names_of[f"{m}_high"])
    own = [c for c in table.columns if c not in (salt,)]
    return joined.withColumn("kept", inside).drop(*own, lang, source, *([bar] if bar else []))

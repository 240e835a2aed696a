"""Secrets in texts, and the linking of the parts of a credential.

Patterns find parts: identifiers of an account, secrets and endpoints. Strong ones stand for themselves. Weak ones,
such as a user name or a short password, are common in harmless text and count only if a part that completes them lies
within REACH characters before or after. Parts are put into bins of REACH characters; for each bin and role the first
and last places are kept, and a weak part looks into the two bins on either side that its reach can touch. So the
interval join needs one small row for each bin and never pairs parts with each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from grainmill.llm.common import offsets
from grainmill.session import stage

REACH = 200

# Kind -> (pattern, role, strong). The first three are the base kinds. Matches are leftmost and do not overlap.
KINDS: dict[str, tuple[str, str, bool]] = {
    "assign": (
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "secret", True),
    "access": (r"AKIA[A-Z0-9]+", "identifier", True),
    "hex": (r"[0-9a-f]{32,}", "secret", True),
    "user": (
        r"""(?i:user_?name|user|login|client_?id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}""",
        "identifier", False),
    "mail": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9]", "identifier", False),
    "pass": (
        r"""(?i:pwd|pass|passphrase|auth|pin|private_?key|access_?key)["']?\x20*[:=]\x20*["']?[^\x00-\x20"']{4,}""",
        "secret", False),
    "blob": (r"[A-Za-z0-9+/]{24,}={0,2}", "secret", False),
    "url": (r"""[A-Za-z][A-Za-z0-9+.-]*://[^\x00-\x20"'<>]+""", "endpoint", False),
    "host": (r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?::[0-9]{1,5})?", "endpoint", False),
}
BASE = ("assign", "access", "hex")
# What completes a weak part: a secret needs an identifier or an endpoint, the others need a secret.
COMPLETES = {"identifier": ("secret",), "secret": ("identifier", "endpoint"), "endpoint": ("secret",)}
SPAN = "array<struct<start:int,kind:int,stop:int>>"


def find(text: Column, kind: str) -> Column:
    """Spans (start, kind number, stop) of one kind in code points.

    Cutting the text at the pattern gives what lies between the matches; running lengths of both give the places.
    """
    pattern, number = F.lit(KINDS[kind][0]), F.lit(list(KINDS).index(kind))
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.transform(F.split(text, KINDS[kind][0], -1), lambda g: F.length(g))
    sizes = F.zip_with(found, F.slice(gaps, 1, F.greatest(F.size(found), F.lit(0))), lambda m, g: F.length(m) + g)

    def span(m: Column, i: Column, at: Column) -> Column:
        start = F.get(at, i) + F.get(gaps, i)
        return F.struct(start.alias("start"), number.alias("kind"), (start + F.length(m)).alias("stop"))

    def placed(box: Column) -> Column:
        return F.transform(found, lambda m, i: span(m, i, box))

    spans = F.get(F.transform(F.array(offsets(sizes)), placed), F.lit(0))
    if kind == "assign":
        value = F.regexp_extract_all(text, pattern, F.lit(2))
        spans = F.filter(spans, lambda s, i: F.length(F.get(value, i)) >= 8)
    if kind == "access":
        spans = F.filter(spans, lambda s: s["stop"] - s["start"] >= 16)
    if kind == "blob":  # mixed letters and digits
        mixed = lambda m: m.rlike("[0-9]") & m.rlike("[a-z]") & m.rlike("[A-Z]")
        spans = F.filter(spans, lambda s, i: mixed(F.get(found, i)))
    return F.when(F.size(found) > 0, spans).otherwise(F.array().cast(SPAN)).cast(SPAN)


def written(spans: Column) -> Column:
    """Spans as kind:start:stop by start, then kind, joined by commas."""
    name = F.lit(list(KINDS))
    one = lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["stop"])
    return F.array_join(F.transform(F.sort_array(spans), one), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_key, id, base, weak) for each row; ``row_key`` tells rows apart by identifier and text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), F.length(text).alias("n"))
    found = {k: find(text, k) for k in KINDS}
    return docs.select(
        key.alias("row_key"), F.col(id_col).alias("id"),
        F.concat(*[found[k] for k in BASE]).alias("base"),
        F.concat(*[found[k] for k in KINDS if k not in BASE]).alias("weak"),
    )


def linked(scanned: DataFrame) -> DataFrame:
    """(row_key, links): the weak spans that a complementary part within REACH completes."""
    roles = F.lit([r for _, r, _ in KINDS.values()])
    weak_from = len(BASE)
    parts = (
        scanned.where("size(weak) > 0").select("row_key", F.inline(F.concat("base", "weak"))).distinct()
        .withColumn("role", F.get(roles, F.col("kind")))
    )
    bin_of = lambda c: F.floor(c / F.lit(REACH)).cast("int")
    edges = F.inline(F.array(
        F.struct(F.lit("start").alias("edge"), F.col("start").alias("at")),
        F.struct(F.lit("stop").alias("edge"), F.col("stop").alias("at")),
    ))
    places = parts.select("row_key", "role", edges).withColumn("bin", bin_of(F.col("at")))
    bounds = []
    for role in COMPLETES:
        for edge in ("start", "stop"):
            here = F.when((F.col("role") == role) & (F.col("edge") == edge), F.col("at"))
            bounds += [F.min(here).alias(f"{role}_{edge}_min"), F.max(here).alias(f"{role}_{edge}_max")]
    bins = places.groupBy("row_key", "bin").agg(*bounds)

    # Looks at its own bin and the next from its stop, its own and the one before from its start.
    looks = F.inline(F.array(*[
        F.struct(F.lit(side).alias("side"), (bin_of(F.col(edge)) + step).alias("bin"))
        for side, edge, step in (("after", "stop", 0), ("beyond", "stop", 1), ("before", "start", 0), ("behind", "start", -1))
    ]))
    asks = parts.where(F.col("kind") >= weak_from).select("row_key", "start", "kind", "stop", "role", looks)

    def near(role: str) -> Column:
        return (
            F.when(F.col("side") == "after", F.col(f"{role}_start_max") >= F.col("stop"))
            .when(F.col("side") == "beyond", F.col(f"{role}_start_min") <= F.col("stop") + REACH)
            .when(F.col("side") == "before", F.col(f"{role}_stop_min") <= F.col("start"))
            .otherwise(F.col(f"{role}_stop_max") >= F.col("start") - REACH)
        )

    complete = F.lit(False)
    for role, others in COMPLETES.items():
        for other in others:
            complete |= (F.col("role") == role) & F.coalesce(near(other), F.lit(False))
    return (
        asks.join(bins, ["row_key", "bin"]).where(complete).select("row_key", "start", "kind", "stop").distinct()
        .groupBy("row_key").agg(F.collect_list(F.struct("start", "kind", "stop")).alias("links"))
    )


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, base (spans), spans (base and linked weak ones), both in code points.

    NULL counts as empty and gives no spans. NULL identifiers are allowed; repeated rows get equal results. An empty
    table gives no rows. Other columns of ``docs`` are not read.
    """
    scanned = stage(scan(docs, id_col, text_col), "secret-parts")
    return scanned.join(linked(scanned), "row_key", "left").select(
        F.col("id").alias(id_col), "base",
        F.concat("base", F.coalesce("links", F.array().cast(SPAN))).alias("spans"),
    )

"""Candidate scores ``(grp, item, score)``: top-k, softmax and draws, per group.

A group may hold most of the rows, so rows never meet by group alone. Sums are aggregates that combine
before the shuffle; a threshold comes from the best rows of each (group, salt); and what is found for a group goes back
to its rows by broadcast if there are few groups, which is counted, or else by a join on (group, salt).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from grainmill.constants import TEMPERATURE, TOP_K
from grainmill.session import stage_counted

SALTS = 64
BAND = 64  # exp of values within a band stays far from overflow
BROADCAST_GROUPS = 100_000  # groups whose two or three numbers may be broadcast, a few MB


def _salt() -> Column:
    return F.pmod(F.xxhash64("item"), F.lit(SALTS)).cast("int")


def _back(df: DataFrame, groups: DataFrame) -> DataFrame:
    """``df`` with the columns of ``groups``, one row for each ``grp``."""
    groups, n = stage_counted(groups, "groups")
    if n <= BROADCAST_GROUPS:
        return df.join(F.broadcast(groups), "grp")
    copies = groups.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return df.withColumn("__salt", _salt()).join(copies, ["grp", "__salt"]).drop("__salt")


def kth_score(df: DataFrame, k: int = TOP_K) -> DataFrame:
    """``(grp, kth)``: the k-th largest score counting repeats, or the smallest of a short group.

    Each (group, salt) gives its k best rows, so at most SALTS * k rows of a group meet.
    """
    best = F.row_number().over(Window.partitionBy("grp", "__salt").orderBy(F.desc("score")))
    few = df.select("grp", "score", _salt().alias("__salt")).withColumn("r", best).where(F.col("r") <= k)
    place = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("score")))
    return few.withColumn("r", place).where(F.col("r") <= k).groupBy("grp").agg(F.min("score").alias("kth"))


def top_k(df: DataFrame, k: int = TOP_K) -> DataFrame:
    """Rows scoring at least the k-th largest score of their group; ties with it all stay."""
    return _back(df, kth_score(df, k)).where(F.col("score") >= F.col("kth")).drop("kth")


def log_sum_exp(df: DataFrame, value: Column) -> DataFrame:
    """``(grp, top, z)``: sum of exp(value) = z * exp(BAND * top), in one pass.

    Values are summed in bands of BAND, each relative to its band's lower end, so no sum overflows or vanishes beside
    itself. Bands of a group add up like any partial sums; a handful of them is then put on the scale of the highest.
    """
    band = F.floor(value / BAND)
    per = df.select("grp", band.alias("band"), F.exp(value - band * BAND).alias("e")).groupBy("grp", "band").agg(F.sum("e").alias("e"))
    bands = F.array_agg(F.struct("band", "e"))
    found = per.groupBy("grp").agg(F.max("band").alias("top"), bands.alias("bands"))
    scaled = F.aggregate("bands", F.lit(0.0), lambda acc, b: acc + b["e"] * F.exp((b["band"] - F.col("top")) * float(BAND)))
    return found.select("grp", "top", scaled.alias("z"))


def softmax(df: DataFrame, temperature: float = 1.0) -> DataFrame:
    """Adds ``p``, the softmax of score / temperature within the group: one aggregate and one join back."""
    value = F.col("score") / temperature
    normed = _back(df, log_sum_exp(df, value))
    return normed.withColumn("p", F.exp(value - F.col("top") * BAND) / F.col("z")).drop("top", "z")


def _uniform(seed: int, hash_name: str) -> Column:
    """A number in (0, 1) fixed by seed, group and item."""
    if hash_name == "md5":
        text = F.concat_ws("-", F.lit(str(seed)), F.col("grp").cast("string"), F.col("item").cast("string"))
        return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("grp"), F.col("item")), 11)
    return (bits.cast("double") + 0.5) / float(2**53)


def draw(
    df: DataFrame,
    temperature: float = TEMPERATURE,
    k: int | None = TOP_K,
    seed: int = 0,
    hash_name: str = "xxhash64",
) -> DataFrame:
    """One item per group, drawn with the probabilities of top-k softmax.

    The largest of score / T plus Gumbel noise is such a draw, so no normalizer is needed and the draw
    is a plain aggregate.
    """
    kept = df if k is None else top_k(df, k)
    noise = -F.log(-F.log(_uniform(seed, hash_name)))
    return kept.groupBy("grp").agg(
        F.max_by("item", F.struct(F.col("score") / temperature + noise, -F.col("item"))).alias("item")
    )


def greedy(df: DataFrame) -> DataFrame:
    """The best item per group, ties to the smallest."""
    return df.groupBy("grp").agg(F.max_by("item", F.struct("score", -F.col("item"))).alias("item"))

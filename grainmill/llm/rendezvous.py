"""Rendezvous hashing of record keys over weighted shards.

Every (key, shard) pair has a hash; a record goes to the shard whose weighted hash wins. A shard's chance is its share
of the weights, and a new shard only takes records it now wins, so nothing moves between old shards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from grainmill.llm.common import row_slots

FRACTION = float(1 << 52)


def winner(key: Column, weights: Sequence[float], seed: int = 0) -> Column:
    """Number of the winning shard: smallest -ln(u) / weight, ties to the smaller number. Weights are above 0."""
    shares = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights)])
    digest = F.xxhash64(key, F.lit(seed))

    def bid(s: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(digest, s["i"]), 12) + F.lit(0.5)) / F.lit(FRACTION)
        return F.struct((-F.ln(u) / s["w"]).alias("bid"), s["i"].alias("i"))

    return F.array_min(F.transform(shares, bid))["i"]


def shard(
    docs: DataFrame,
    key: str = "doc_id",
    weights: Sequence[float] = (1.0,) * 40,
    grown: Sequence[float] | None = None,
    seed: int = 0,
) -> DataFrame:
    """All columns of ``docs`` plus shard, slot (gapless from 0 in a shard) and grown_shard.

    ``grown`` are the weights after growth: the old ones and one more, equal to the mean unless given. Rows with equal
    keys share a shard, NULL keys too. Slots follow a hash of the key, then the key; repeated rows take neighbouring
    slots. Column names shard, slot and grown_shard of ``docs`` are replaced.
    """
    grown = list(grown or [*weights, sum(weights) / len(weights)])
    placed = docs.drop("shard", "slot", "grown_shard").withColumns(
        {"shard": winner(F.col(key), weights, seed), "grown_shard": winner(F.col(key), grown, seed)}
    )
    place = F.xxhash64(F.col(key), F.lit(seed + 1))
    return row_slots(placed, "shard", [place, F.col(key)], F.shiftrightunsigned(place, 52).cast("int"), "slot")

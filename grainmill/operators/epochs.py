"""Epoch plans: which window goes to which rank, batch and optimizer step."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

from grainmill.constants import BATCH_SIZE, EPOCHS, GRAD_ACCUM
from grainmill.operators.ordering import prefix_sums

ROUNDS = 24  # of the keyed bijection


def _shuffle_key(hash_name: str, seed: int) -> tuple[Column, Column]:
    """Key deciding a window's place in its epoch, and its leading 16 bits as the bucket."""
    if hash_name == "xxhash64":
        key = F.xxhash64(F.lit(seed), F.col("epoch"), F.col("window_id"))
        return key
    if hash_name == "md5":
        key = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("epoch").cast("string"), F.col("window_id").cast("string")))
        return key
    raise ValueError(f"unknown hash {hash_name!r}")


def shuffle_epochs(
    window_ids: DataFrame, epochs: int = EPOCHS, seed: int = 0, hash_name: str = "xxhash64"
) -> DataFrame:
    """``(epoch, window_id, idx)``: a seeded permutation of all windows per epoch.

    The key depends on seed, epoch and window only, so retries and repartitioning change nothing. Ranges
    of the hash spread windows evenly over tasks.
    """
    key = _shuffle_key(hash_name, seed)
    keyed = window_ids.select(
        F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"), "window_id"
    ).withColumn("shuffle_key", key)
    return prefix_sums(
        keyed, ["epoch"], ["shuffle_key", "window_id"], {"idx": F.lit(1).cast("bigint")}
    ).select("epoch", "window_id", "idx")


def _keyed(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def place(window_id: Column, n: int, seed: int, epoch: int, rounds: int = ROUNDS) -> Column:
    """The window's place in its epoch, by arithmetic: a bijection of [0, n) keyed by seed and epoch.

    Swap or not: each round pairs x with (k - x) mod n, k from the key, and a hash of the larger of the two decides
    whether they change places. Every round is its own inverse, so the whole is a permutation for any n.
    """
    keys = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(_keyed(f"{seed}-{epoch}-{r}") % n).cast("bigint").alias("k")) for r in range(rounds)])

    def step(x: Column, key: Column) -> Column:
        other = (key["k"] - x + n) % n
        text = F.concat_ws("-", F.lit(str(seed)), F.lit(str(epoch)), key["r"].cast("string"), F.greatest(x, other).cast("string"))
        return F.when(F.substring(F.md5(text), 32, 1).isin(*"13579bdf"), other).otherwise(x)

    return F.aggregate(keys, window_id.cast("bigint"), step)


def permuted_epochs(window_ids: DataFrame, n_windows: int, epochs: int = EPOCHS, seed: int = 0) -> DataFrame:
    """``(epoch, window_id, idx)`` like :func:`shuffle_epochs`, for ids 0 to ``n_windows`` - 1: no sort and no shuffle."""
    n = max(1, n_windows)
    indexed = F.array(*[F.struct(F.lit(e).alias("epoch"), place(F.col("window_id"), n, seed, e).alias("idx")) for e in range(epochs)])
    return window_ids.select("window_id", F.explode(indexed).alias("e")).select("e.epoch", "window_id", "e.idx")


def shard_ranks(indexed: DataFrame, world: int, n_windows: int) -> DataFrame:
    """Give every rank the same number of windows: the list is repeated from its start until it divides,
    and rank ``r`` takes every ``world``-th entry. Adds ``rank`` and ``slot`` (place within the rank)."""
    padded = -(-n_windows // world) * world
    repeats = F.sequence(F.col("idx"), F.lit(padded - 1).cast("bigint"), F.lit(n_windows).cast("bigint"))
    return (
        indexed.withColumn("pos", F.explode(repeats))
        .select(
            "epoch", "window_id", "idx",
            (F.col("pos") % world).cast("int").alias("rank"),
            F.expr(f"pos div {world}").alias("slot"),
        )
    )


def batches(sharded: DataFrame, batch_size: int = BATCH_SIZE) -> DataFrame:
    """Adds ``batch`` and the place in it; the last batch of a rank may be short."""
    return sharded.withColumn("batch", F.expr(f"slot div {batch_size}")).withColumn(
        "place", (F.col("slot") % batch_size).cast("int")
    )


def boundary(batch: Column, accum: int = GRAD_ACCUM) -> Column:
    """Whether the optimizer steps after this batch."""
    return (batch + 1) % accum == 0


def accumulation(batched: DataFrame, accum: int = GRAD_ACCUM) -> DataFrame:
    """Adds ``group`` and ``is_boundary``; batches after an epoch's last full group take no step."""
    return batched.withColumn("group", F.expr(f"batch div {accum}")).withColumn(
        "is_boundary", boundary(F.col("batch"), accum)
    )


def plan_numbers(
    window_ids: DataFrame,
    world: int = 1,
    batch_size: int = BATCH_SIZE,
    accum: int = GRAD_ACCUM,
    epochs: int = EPOCHS,
    resume_step: int = 0,
    recipe: str = "base",
) -> DataFrame:
    """One row of plan arithmetic: windows, loader length, total steps, steps per epoch, resume epoch."""
    per_epoch = f"n_batches div {accum}"
    if recipe == "cpt":
        per_epoch = f"greatest({per_epoch}, 1L)"
    return (
        window_ids.agg(F.count("*").alias("n_windows"))
        .withColumn("per_rank", F.expr(f"(n_windows + {world - 1}) div {world}"))
        .withColumn("n_batches", F.expr(f"(per_rank + {batch_size - 1}) div {batch_size}"))
        .withColumn("total_steps", F.expr(f"n_batches * {epochs} div {accum}"))
        .withColumn("steps_per_epoch", F.expr(per_epoch))
        .withColumn("start_epoch", F.expr(f"cast({resume_step} as bigint) div nullif(steps_per_epoch, 0L)"))
    )


def lookup_windows(plan: DataFrame, windows: DataFrame) -> DataFrame:
    """The planned windows with their contents."""
    return plan.join(windows, "window_id")

"""The composed builds: token stream, training windows, epoch plan and tokenizer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from grainmill.constants import BATCH_SIZE, EPOCHS, VOCAB_SIZE, WINDOW
from grainmill.functions.arrays import append_token
from grainmill.operators import epochs, mixture, packing, recipes
from grainmill.operators.bpe_train import train
from grainmill.operators.codec import ByteCodec
from grainmill.operators.ordering import prefix_sums
from grainmill.operators.vocabulary import Vocabulary
from grainmill.session import stage
from grainmill.sources.corpus_text import tokenizer_corpus


def _drop_beyond_reach(docs: DataFrame, longest_piece: int) -> DataFrame:
    """Drop documents that cannot be in the budget, before the costly encoding.

    A document of ``b`` bytes has at least ``b / longest_piece`` tokens. Once that lower bound, summed
    over the earlier documents, reaches the budget, so has the real count.
    """
    least = F.expr(f"(octet_length(text) + {longest_piece - 1}) div {longest_piece}")
    reach = prefix_sums(
        docs, ["source"], ["ord"],
        {"__least_before": least, "__docs_before": F.lit(1).cast("bigint")},
        keep=(F.col("__least_before") < F.col("budget")) | (F.col("__docs_before") == 0),
        carry=["budget"],
    )
    return reach.drop("__least_before", "__docs_before")


@dataclass
class TokenBuild:
    budget: DataFrame
    registry: DataFrame
    kept: DataFrame
    append_end: bool
    codec: object
    totals: DataFrame | None = None  # samples and tokens of each source, counted while the kept documents were written

    def report(self) -> DataFrame:
        """Budget, samples, tokens and status of each source, without another pass if ``kept`` was staged."""
        return mixture.build_report(self.budget, self.registry, self.kept, self.totals)

    def stream(self) -> DataFrame:
        """Kept documents ``(source, ord, doc_no, start, n_tokens, ids)`` of the global token stream."""
        placed = mixture.with_positions(self.kept)
        if "ids" not in placed.columns:
            ids = self.codec.encode(F.col("text"))
            placed = placed.withColumn("ids", append_token(ids) if self.append_end else ids)
        return placed.select("source", "ord", "doc_no", "start", "n_tokens", "ids")


def token_build(
    raw: DataFrame, recipe: str, total: int | Column, codec=None, compat: bool = True, stage_kept: bool = True,
    cap: int | None = None, narrow: bool = False,
) -> TokenBuild:
    """Format, filter, encode and cut every weighted source to its token budget.

    With a codec that counts tokens without encoding, only kept documents are ever encoded. With BPE,
    documents out of the budget's reach are dropped first and the rest is encoded once, to the shared
    folder. ``compat=False`` repairs the misspelt weight and appends no second end token. ``cap`` also
    limits the rows of each source, see :func:`grainmill.operators.recipes.prepare`. With ``narrow`` only the counts
    of kept documents are built, without their text or ids.
    """
    spark = raw.sparkSession
    codec = codec or ByteCodec()
    r = recipes.RECIPES[recipe]
    append_end = r.append_end and compat
    budget = mixture.budgets(recipes.weights(spark, recipe, compat), total)
    docs = mixture.attach_budget(recipes.prepare(raw, recipe, cap, compat), budget)
    extra = 1 if append_end else 0
    if codec.counts_without_encoding:
        n = codec.n_tokens(F.col("text")) + extra
        if narrow:
            docs, n = docs.withColumn("n_tokens", n).drop("text"), F.col("n_tokens")
    else:
        ids = codec.encode(F.col("text"))
        docs = _drop_beyond_reach(docs, codec.longest_piece).withColumn(
            "ids", append_token(ids) if append_end else ids
        )
        docs = stage(docs.drop("text"), "encoded")
        n = F.size("ids")
        if narrow:
            docs, n = docs.withColumn("n_tokens", n).drop("ids"), F.col("n_tokens")
    kept, totals = mixture.budget_prefix(docs, n), None
    if stage_kept:
        sources = [r["name"] for r in budget.select("name").distinct().collect()]  # those the recipe weighs
        counted, observed = mixture.observe_sources(kept, sources)
        kept = stage(counted, "kept")
        totals = mixture.observed_totals(spark, sources, observed)
    return TokenBuild(budget, recipes.registry(spark, recipe), kept, append_end, codec, totals)


def training_windows(build: TokenBuild, window: int = WINDOW) -> DataFrame:
    return packing.pack(build.stream(), window)


def epoch_plan(
    window_ids: DataFrame, world: int = 1, n_epochs: int = EPOCHS, seed: int = 0,
    batch_size: int = BATCH_SIZE, hash_name: str = "xxhash64",
) -> DataFrame:
    """``(epoch, window_id, idx, rank, slot, batch, place, group, is_boundary)``."""
    indexed = epochs.shuffle_epochs(window_ids, n_epochs, seed, hash_name)
    return epochs.accumulation(epochs.batches(epochs.shard_ranks(indexed, world, window_ids.count()), batch_size))


def write_epoch_plan(plan: DataFrame, windows: DataFrame, path: str) -> None:
    """Planned windows with inputs and targets, in folders per epoch and rank, files in batch order."""
    full = packing.training_pairs(epochs.lookup_windows(plan, windows.select("window_id", "ids")))
    (
        full.drop("ids")
        .repartitionByRange("epoch", "rank", "slot")
        .sortWithinPartitions("epoch", "rank", "slot")
        .write.partitionBy("epoch", "rank")
        .parquet(path)
    )


def tokenizer_build(raw: DataFrame, vocab_size: int = VOCAB_SIZE) -> Vocabulary:
    return train(tokenizer_corpus(raw), vocab_size)

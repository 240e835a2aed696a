"""A Katz backoff language model and the scores of all documents.

Word pairs and words have Good-Turing discounted counts; what discounting frees at a history goes to its unseen words in
proportion to the lower order, with a weight that makes every history's probabilities add up to one exactly.

Documents lie in row blocks of bounded size. Each block counts its words and pairs; counts meet by hash in parts, whose
tables go back to the blocks, one number for each key a block has sent. Of the blocks that share a pair
one owns it and adds it to its history's sums, so that a history of any size is summed from one row for each block.
The probability of a token is then found recursively: pair, else backoff weight times word, else the unknown word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from grainmill.llm import arrays as A
from grainmill.llm.common import shuffle_partitions
from grainmill.session import stage

CUTOFF = 5  # counts above are not discounted
BLOCK_BYTES = 10 << 20
PART_BYTES = 10 << 20
END, START = np.uint64(0x9D39247E33776D41), np.uint64(0x2AF7398005AAA5C7)

NAMES = ["part", "row_block", "role", "n", "keys", "values", "more"]
PACKED = "part int, row_block int, role int, n int, keys binary, values binary, more binary"
COUNTED = PACKED + ", stats array<bigint>"
WORD, PAIR, HISTORY = range(3)
STATS = CUTOFF + 3  # total, types, types seen 1 .. CUTOFF + 1 times


# ---- row blocks ------------------------------------------------------------------------------------------------

def packed_blocks(docs: DataFrame, columns: list[str], text: str, blocks: int) -> DataFrame:
    """(row_block, body): the rows of each batch dealt to row blocks, as compressed Arrow tables, one shuffle."""
    import pyarrow.ipc as ipc

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in A.slices(batch, text, 32 << 20):
                of = part.column("row_block").to_numpy()
                order = np.argsort(of, kind="stable")
                ids, starts = np.unique(of[order], return_index=True)
                bodies = []
                rows = part.select([*columns, text]).take(pa.array(order))
                for a, b in zip(starts, [*starts[1:], len(order)]):
                    sink = pa.BufferOutputStream()
                    with ipc.new_stream(sink, rows.schema, options=ipc.IpcWriteOptions(compression="zstd")) as out:
                        out.write_batch(pa.RecordBatch.from_arrays(
                            [pa.concat_arrays([c.slice(a, b - a)]) for c in rows.columns], schema=rows.schema))
                    bodies.append(sink.getvalue().to_pybytes())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(bodies, pa.binary())], ["row_block", "body"])

    return docs.select("row_block", *columns, text).mapInArrow(run, "row_block int, body binary").repartition(blocks, "row_block")


def unpacked(table: pa.Table | pa.RecordBatch) -> pa.Table:
    import pyarrow.ipc as ipc

    return pa.concat_tables(ipc.open_stream(b).read_all() for b in table.column("body").to_pylist())


# ---- a block's tokens ------------------------------------------------------------------------------------------

class _Tokens:
    """Tokens of a row block, their histories and pairs, and the training counts within the block."""

    def __init__(self, docs: pa.Table):
        self.ids, self.held = docs.column("id"), docs.column("held").to_numpy()
        words, first = A.word_hashes(A.text_bytes(docs.column("text")), lower=True)
        docs_n = len(first) - 1
        self.first = first + np.arange(docs_n + 1)  # one end for each text
        ends = self.first[1:] - 1
        tokens = np.empty(self.first[-1], np.uint64)
        is_end = np.zeros(len(tokens), bool)
        is_end[ends] = True
        tokens[is_end], tokens[~is_end] = END, words
        history = np.empty_like(tokens)
        history[1:] = tokens[:-1]
        history[self.first[:-1]] = START
        train = np.repeat(~self.held, np.diff(self.first))
        self.words, self.word_of = np.unique(tokens, return_inverse=True)
        self.word_n = np.bincount(self.word_of, weights=train, minlength=len(self.words)).astype(np.int64)
        pairs = A.mixed(history * A.BASE_A + tokens)
        self.pairs, self.pair_at, self.pair_of = np.unique(pairs, return_index=True, return_inverse=True)
        self.pair_n = np.bincount(self.pair_of, weights=train, minlength=len(self.pairs)).astype(np.int64)
        # Histories by number: that of the word, or one more for the beginning.
        begin = len(self.words)
        self.history_of = np.empty(len(tokens), np.int64)
        self.history_of[1:] = self.word_of[:-1]
        self.history_of[self.first[:-1]] = begin

    def told(self, answers: pa.Table, parts: int) -> None:
        """Replace local counts by totals. An answer holds one value for each key of the part, in their order."""
        self.pair_own = self.pair_n > 0
        word_edges, pair_edges = edges(self.words, parts), edges(self.pairs, parts)
        for row in answers.to_pylist():
            if row["role"] == HISTORY:
                continue
            values = A.unpack(row["values"], row["n"]).view(np.int64)
            if row["role"] == WORD:
                self.word_n[word_edges[row["part"]] : word_edges[row["part"] + 1]] = values >> 1
            else:
                at = slice(pair_edges[row["part"]], pair_edges[row["part"] + 1])
                self.pair_n[at], self.pair_own[at] = values >> 1, (values & 1) > 0
        at = np.searchsorted(self.words, END)
        starts = self.word_n[at] if at < len(self.words) else 0
        self.history_n = np.concatenate([self.word_n, [starts]])
        self.history_keys = np.concatenate([self.words, [START]])


def edges(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each part of the hashes begins in ascending keys, and their number."""
    step = (1 << 64) // parts + 1
    inner = np.searchsorted(keys, np.array([i * step for i in range(1, parts)], dtype=np.uint64))
    return np.concatenate([[0], inner, [len(keys)]])


def _rows(block: int, role: int, parts: int, keys: np.ndarray, values: np.ndarray):
    at = edges(keys, parts)
    for part in range(parts):
        a, b = at[part], at[part + 1]
        if b > a:
            yield (part, block, role, int(b - a), A.pack(keys[a:b], True), A.pack(values[a:b]), None)


def _table(rows: list[tuple], stats: list | None = None) -> pa.Table:
    kinds = [pa.int32()] * 4 + [pa.binary()] * 3
    columns = list(zip(*rows)) if rows else [[]] * 7
    arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
    if stats is None:
        return pa.table(arrays, names=NAMES)
    return pa.table([*arrays, pa.array(stats, pa.list_(pa.int64()))], names=[*NAMES, "stats"])


def _count(parts: int):
    def run(key: tuple, packed: pa.Table) -> pa.Table:
        t = _Tokens(unpacked(packed))
        block = int(key[0].as_py())
        return _table([*_rows(block, WORD, parts, t.words, t.word_n), *_rows(block, PAIR, parts, t.pairs, t.pair_n)])

    return run


def _total(table: pa.Table) -> pa.Table:
    """Totals of one part and role: answers for the blocks that cannot know them, and statistics."""
    rows = sorted(table.to_pylist(), key=lambda x: x["row_block"])
    if not rows:
        return _table([], [])
    part, role = rows[0]["part"], rows[0]["role"]
    each = [(x["row_block"], A.unpack(x["keys"], x["n"], True), A.unpack(x["values"], x["n"]).view(np.int64)) for x in rows]
    keys, counts = np.concatenate([k for _, k, _ in each]), np.concatenate([c for _, _, c in each])
    distinct, where = np.unique(keys, return_inverse=True)
    totals = np.zeros(len(distinct), np.int64)
    np.add.at(totals, where, counts)
    owner = np.full(len(distinct), len(each), np.int64)
    turn = np.repeat(np.arange(len(each)), [len(k) for _, k, _ in each])
    with_any = counts > 0
    np.minimum.at(owner, where[with_any], turn[with_any])
    out, start = [], 0
    for i, (block, k, _) in enumerate(each):
        at = where[start : start + len(k)]
        start += len(k)
        out.append((part, block, role, len(k), None, A.pack(totals[at] * 2 + (owner[at] == i)), None))
    seen = totals[totals > 0]
    small = np.bincount(np.minimum(seen, CUTOFF + 2), minlength=CUTOFF + 3)[1 : CUTOFF + 2]
    stats = [role, int(seen.sum()), len(seen), *map(int, small)]
    return _table([*out, (part, -1, role, 0, None, None, None)], [None] * len(out) + [stats])


# ---- the model -------------------------------------------------------------------------------------------------

@dataclass
class Model:
    """Global counts: tokens, distinct words, and for words and pairs the types seen 1 .. CUTOFF + 1 times."""

    tokens: int
    types: int
    word_types: list[int]
    pair_types: list[int]

    def __post_init__(self):
        self.word_rate, self.pair_rate = discounts(self.word_types), discounts(self.pair_types)
        r = np.arange(1, CUTOFF + 1)
        freed = float(((1 - self.word_rate) * r * np.array(self.word_types[:CUTOFF])).sum())
        self.unknown = freed / self.tokens if self.tokens else 0.0
        self.plain = not 0 < self.unknown < 1  # too few words to discount: half a count each and for the unknown word
        if self.plain:
            self.unknown = 0.5 / (self.tokens + 0.5 * (self.types + 1))

    def word(self, n: np.ndarray) -> np.ndarray:
        """Probability of words seen n times; for 0 that of the unknown word."""
        if self.plain:
            return (n + 0.5) / (self.tokens + 0.5 * (self.types + 1))
        return np.where(n > 0, _discounted(n, self.word_rate) / max(self.tokens, 1), self.unknown)

    def base(self, n: np.ndarray) -> np.ndarray:
        return (n + 0.5) / (self.tokens + 0.5 * (self.types + 1))

    def freed(self, n: np.ndarray) -> np.ndarray:
        """Counts that discounting takes from pairs seen n times."""
        return n - _discounted(n, self.pair_rate)


def discounts(types: list[int]) -> np.ndarray:
    """Good-Turing discount rates of counts 1 .. CUTOFF after Katz.

    Counts of counts that do not fall smoothly, as copies make them, can put a rate outside (0, 1]; then the largest
    smaller cutoff is taken whose rates are inside, and counts above it are not discounted. If there is none, each
    count gives up the same share n1 / (n1 + 2 n2) of one.
    """
    n, rate = np.array(types, dtype=float), np.ones(CUTOFF)
    for top in range(CUTOFF, 1, -1):
        if (n[: top + 1] <= 0).any():
            continue
        r = np.arange(1, top + 1)
        over = (top + 1) * n[top] / n[0]
        if over == 1:
            continue
        found = ((r + 1) * n[1 : top + 1] / (r * n[:top]) - over) / (1 - over)
        if ((found > 0) & (found <= 1)).all() and (found < 1).any():
            rate[:top] = found
            return rate
    if n[0] > 0:
        rate = 1 - n[0] / (n[0] + 2 * n[1]) / np.arange(1, CUTOFF + 1) * (1.0 if n[1] else 0.5)
    return rate


def _discounted(n: np.ndarray, rate: np.ndarray) -> np.ndarray:
    return n * np.where(n <= CUTOFF, rate[np.clip(n, 1, CUTOFF) - 1], 1.0)


def _sums(parts: int, model: Model):
    """What each block's own pairs add to their histories, and which histories the block asks for."""

    def run(key: tuple, packed: pa.Table, answers: pa.Table) -> pa.Table:
        if not packed.num_rows:
            return _table([])
        t = _Tokens(unpacked(packed))
        t.told(answers, parts)
        size = len(t.history_keys)
        at = t.pair_at[t.pair_own]
        history = t.history_of[at]
        freed = np.bincount(history, weights=model.freed(t.pair_n[t.pair_own]), minlength=size)
        lower = np.bincount(history, weights=model.word(t.word_n[t.word_of[at]]), minlength=size)
        asks = np.zeros(size, np.int64)
        asks[t.history_of[t.pair_n[t.pair_of] == 0]] = 1
        keep = t.history_n > 0
        order = np.flatnonzero(keep)[np.argsort(t.history_keys[keep])]
        out, block = [], int(key[0].as_py())
        at = edges(t.history_keys[order], parts)
        for part in range(parts):
            i = order[at[part] : at[part + 1]]
            if len(i):
                sums = pa.compress(np.stack([freed[i], lower[i]]).tobytes(), codec="zstd", asbytes=True)
                out.append((part, block, HISTORY, len(i), A.pack(t.history_keys[i], True), A.pack(asks[i]), sums))
        return _table(out)

    return run


def _pairs_of(row: dict) -> np.ndarray:
    return np.frombuffer(pa.decompress(row["more"], 16 * row["n"], codec="zstd", asbytes=True), float).reshape(2, -1)


def _weigh(table: pa.Table) -> pa.Table:
    """Sums of each history, for the blocks that ask, and for all of its blocks where nothing is freed."""
    rows = sorted(table.to_pylist(), key=lambda x: x["row_block"])
    if not rows:
        return _table([])
    keys = [A.unpack(x["keys"], x["n"], True) for x in rows]
    distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.stack([np.bincount(where, weights=w, minlength=len(distinct))
                     for w in np.concatenate([_pairs_of(x) for x in rows], axis=1)])
    out, start = [], 0
    for x, k in zip(rows, keys):
        got = sums[:, where[start : start + len(k)]]
        start += len(k)
        pick = (A.unpack(x["values"], x["n"]) > 0) | (got[0] <= 0)
        if pick.any():
            more = pa.compress(np.ascontiguousarray(got[:, pick]).tobytes(), codec="zstd", asbytes=True)
            out.append((x["part"], x["row_block"], HISTORY, int(pick.sum()), A.pack(k[pick], True), None, more))
    return _table(out)


SCORES = "id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def _score(parts: int, model: Model):
    def run(key: tuple, packed: pa.Table, answers: pa.Table) -> pa.Table:
        t = _Tokens(unpacked(packed))
        t.told(answers, parts)
        size = len(t.history_keys)
        freed, lower = np.ones(size), np.zeros(size)  # no answer: something is freed, and nobody asks
        order = np.argsort(t.history_keys)
        for row in answers.to_pylist():
            if row["role"] == HISTORY:
                at = order[np.searchsorted(t.history_keys[order], A.unpack(row["keys"], row["n"], True))]
                freed[at], lower[at] = _pairs_of(row)
        # A history whose counts are all above the cutoff frees one count more than it has.
        none = freed <= 0
        total = t.history_n + none
        with np.errstate(divide="ignore", invalid="ignore"):
            weight = np.where(none, 1.0, freed) / total / (1.0 - lower)
        n, h = t.pair_n[t.pair_of], t.history_of
        word = model.word(t.word_n[t.word_of])
        backed = np.where(t.history_n[h] > 0, weight[h] * word, word)
        seen = _discounted(n, model.pair_rate) / np.maximum(total[h], 1)
        logs = np.log10(np.where(n > 0, seen, backed))
        base = np.log10(model.base(t.word_n[t.word_of]))
        sums = [np.add.reduceat(x, t.first[:-1]) for x in (logs, base, (t.word_n[t.word_of] > 0).astype(np.int64))]
        return pa.table({
            "id": t.ids, "held_out": pa.array(t.held), "n_tokens": pa.array(np.diff(t.first), pa.int64()),
            "n_known": pa.array(sums[2], pa.int64()), "base_score": pa.array(sums[1]), "score": pa.array(sums[0]),
        })

    return run


def score_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None
) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from the rows for which ``held_out`` is false or NULL; by default it is true where the CRC-32 of
    the identifier as text leaves 1 when divided by 5. A text is its words, A-Z in lower case, and one end. Scores are
    log10 probabilities. NULL text counts as empty: its end alone. Identifiers are integers; NULL and repeated ones are
    scored as any other row. Without training rows every token is unknown. An empty table gives no rows.
    """
    spark = docs.sparkSession
    held = held_out if held_out is not None else F.crc32(F.col(id_col).cast("string")) % 5 == 1
    size = docs.select(F.sum(F.octet_length(text_col))).first()[0] or 0
    blocks = max(shuffle_partitions(spark), -(-size // BLOCK_BYTES))
    parts = max(1, -(-size // PART_BYTES))
    packed = packed_blocks(
        docs.select(
            F.pmod(F.xxhash64(id_col, text_col), F.lit(blocks)).cast("int").alias("row_block"),
            F.col(id_col).cast("bigint").alias("id"), F.coalesce(held, F.lit(False)).alias("held"),
            F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        ), ["id", "held"], "text", blocks)
    counted = packed.groupBy("row_block").applyInArrow(_count(parts), PACKED)
    totals = stage(counted.groupBy("part", "role").applyInArrow(_total, COUNTED), "gram-counts")

    numbers = {
        r["role"]: r for r in totals.where("stats is not null").groupBy(F.col("stats")[0].alias("role")).agg(
            *[F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(1, STATS + 1)]).collect()
    }
    types = lambda role: [int(numbers[role][f"s{i}"]) for i in range(3, STATS + 1)] if role in numbers else [0] * (CUTOFF + 1)
    model = Model(
        int(numbers[WORD]["s1"]) if numbers else 0, int(numbers[WORD]["s2"]) if numbers else 0, types(WORD), types(PAIR))

    told = totals.where("stats is null").drop("stats")
    sums = packed.groupBy("row_block").cogroup(told.groupBy("row_block")).applyInArrow(_sums(parts, model), PACKED)
    weights = sums.groupBy("part").applyInArrow(_weigh, PACKED)
    answers = told.unionByName(weights)
    scored = packed.groupBy("row_block").cogroup(answers.groupBy("row_block")).applyInArrow(_score(parts, model), SCORES)
    return scored.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        "base_score", "score")

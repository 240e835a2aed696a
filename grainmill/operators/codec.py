"""Encoding documents to token ids and back.

Pre-tokenizing runs in the JVM. The Arrow function receives arrays of pre-tokens, looks each distinct
one up once per batch, and merges only those not in the task's cache. Decoding is all Column
expressions.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from grainmill.constants import SPECIAL_TOKENS
from grainmill.functions.text import pretokens, pretokens_atomic
from grainmill.operators.vocabulary import BYTE_IDS, N_SPECIAL, Vocabulary
from grainmill.session import stage

IDS = T.ArrayType(T.IntegerType())
FREQUENT = 10_000  # pre-tokens of a dictionary that are broadcast, at most
CACHE_PIECES = 200_000  # distinct pre-tokens a task remembers before it starts over
CHUNK = 500_000  # pre-tokens, about, that are encoded at once, so that a batch costs little more than its ids


def merge_word(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Apply merges to one pre-token: lowest rank first, leftmost first among equals."""
    n = len(symbols)
    if n < 2:
        return symbols
    sym = list(symbols)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = right[i]
        if j < n and (hit := ranks.get((sym[i], sym[j]))):
            heappush(heap, (hit[0], i, sym[i], sym[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, a, b = heappop(heap)
        j = right[i]
        if sym[i] != a or j >= n or sym[j] != b:
            continue  # one of the two has been merged away since
        sym[i], sym[j] = ranks[a, b][1], -1
        right[i] = right[j]
        if right[i] < n:
            left[right[i]] = i
        if left[i] >= 0:
            offer(left[i])
        offer(i)
    return [s for s in sym if s >= 0]


def _gather(lengths: np.ndarray, table: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the runs of ``table`` named by ``picks``; also the start of each run in the result."""
    starts = np.concatenate([[0], np.cumsum(lengths)])
    sizes = lengths[picks]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    index = np.arange(ends[-1]) + np.repeat(starts[picks] - ends[:-1], sizes)
    return table[index], ends


def _chunks(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows, of which ``ends`` holds the running size, of some CHUNK each; one row at least."""
    lo = 0
    while lo < len(ends) - 1:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + CHUNK, "right")) - 1)
        yield lo, hi
        lo = hi


def _ids_of(words: pa.Array, broadcast, cache: dict[str, array]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of an array of pre-tokens, one after the other, and where each begins; ``cache`` remembers what is merged."""
    ranks, markers = broadcast.value
    flat = words.dictionary_encode()
    distinct = flat.dictionary.to_pylist()
    if len(cache) + len(distinct) > CACHE_PIECES:
        cache.clear()
    runs = []
    for w in distinct:
        ids = cache.get(w)
        if ids is None:
            ids = [markers[w]] if w in markers else merge_word([BYTE_IDS[b] for b in w.encode()], ranks)
            cache[w] = ids = array("i", ids)
        runs.append(ids)
    lengths = np.array([len(r) for r in runs], dtype=np.int64)
    table = np.frombuffer(b"".join(r.tobytes() for r in runs), dtype=np.int32)
    return _gather(lengths, table, flat.indices.to_numpy())


def _row_ends(words: pa.Array) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(words.value_lengths().fill_null(0).to_numpy())])


def _word_encoder(vocab_broadcast):
    cache: dict[str, array] = {}

    @F.arrow_udf(IDS)
    def encode(words: pa.Array) -> pa.Array:
        rows, flat, values, ends = _row_ends(words), words.flatten(), [], [np.zeros(1, np.int64)]
        for lo, hi in _chunks(rows):
            ids, at = _ids_of(flat.slice(rows[lo], rows[hi] - rows[lo]), vocab_broadcast, cache)
            values.append(ids)
            ends.append(ends[-1][-1] + at[rows[lo + 1 : hi + 1] - rows[lo]])
        values = np.concatenate([np.zeros(0, np.int32), *values])
        return pa.ListArray.from_arrays(
            pa.array(np.concatenate(ends), pa.int32()), pa.array(values, pa.int32()), mask=words.is_null())

    return encode


def _use_counter(vocab_broadcast, n_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses, cache = np.zeros(n_ids, np.int64), {}
        for batch in batches:
            words = batch.column("words")
            rows, flat = _row_ends(words), words.flatten()
            for lo, hi in _chunks(rows):
                ids, _ = _ids_of(flat.slice(rows[lo], rows[hi] - rows[lo]), vocab_broadcast, cache)
                uses += np.bincount(ids, minlength=n_ids)
        used = np.flatnonzero(uses)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(uses[used])], ["id", "uses"])

    return run


@F.arrow_udf(IDS)
def _byte_ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    table = np.array(BYTE_IDS, dtype=np.int32)
    for text in batches:
        raw = text.cast(pa.large_binary())
        offsets = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1]
        data = raw.buffers()[2]
        data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
        for lo, hi in _chunks(offsets):
            yield pa.ListArray.from_arrays(
                pa.array(offsets[lo : hi + 1] - offsets[lo], pa.int32()),
                pa.array(table[data[offsets[lo] : offsets[hi]]], pa.int32()), mask=text.slice(lo, hi - lo).is_null())


class ByteCodec:
    """A vocabulary without merges: every UTF-8 byte is a token, so counts need no encoding."""

    counts_without_encoding = True
    longest_piece = 1

    def n_tokens(self, text: Column) -> Column:
        return F.octet_length(text)

    def encode(self, text: Column) -> Column:
        return _byte_ids(text)

    def decode(self, ids: Column) -> Column:
        return _decode(ids, Vocabulary(), "split")


class BpeCodec:
    """``special='split'`` treats markers as ordinary text, ``'atomic'`` keeps each as its reserved id."""

    counts_without_encoding = False

    def __init__(self, spark: SparkSession, vocab: Vocabulary, special: str = "split"):
        if special not in ("split", "atomic"):
            raise ValueError(f"special must be 'split' or 'atomic', not {special!r}")
        self.vocab, self.special = vocab, special
        self.longest_piece = vocab.longest_piece
        if special == "atomic":
            self.longest_piece = max(self.longest_piece, *(len(t) for t in SPECIAL_TOKENS))
        markers = {t: i for i, t in enumerate(SPECIAL_TOKENS)} if special == "atomic" else {}
        self._ranks = spark.sparkContext.broadcast((vocab.merge_ranks, markers))
        self._udf = _word_encoder(self._ranks)

    def pieces(self, text: Column) -> Column:
        return pretokens_atomic(text) if self.special == "atomic" else pretokens(text)

    def encode(self, text: Column) -> Column:
        return self._udf(self.pieces(text))

    def uses(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """``(id, uses)``: how often each id occurs in all texts. Tasks add ids up; one row an id leaves each."""
        counter = _use_counter(self._ranks, len(self.vocab.pieces))
        counted = docs.select(self.pieces(F.col(text)).alias("words")).mapInArrow(counter, "id int, uses bigint")
        return counted.groupBy("id").agg(F.sum("uses").alias("uses"))

    def encode_pieces(self, words: Column) -> Column:
        """Ids of an array of pre-tokens, as made by :meth:`pieces`."""
        return self._udf(words)

    def decode(self, ids: Column) -> Column:
        return _decode(ids, self.vocab, self.special)


def _decode(ids: Column, vocab: Vocabulary, special: str) -> Column:
    """Bytes of each piece, joined; invalid UTF-8 becomes U+FFFD. Registered markers are skipped."""
    table = F.split(F.lit(",".join(b.hex() for b in vocab.piece_bytes)), ",")
    if special == "atomic":
        ids = F.filter(ids, lambda i: i >= N_SPECIAL)
    digits = F.array_join(F.transform(ids, lambda i: F.get(table, i)), "")
    return F.make_valid_utf8(F.unhex(digits).cast("string"))


def token_list(ids: Column, vocab: Vocabulary) -> Column:
    """Pieces of an id array, spelled in stand-in characters."""
    table = F.split(F.lit("\n".join(vocab.pieces)), "\n")
    return F.transform(ids, lambda i: F.get(table, i))


def _packed(numbers: Column) -> Column:
    """Non-negative ints as bytes, four each, that sort as the arrays do."""
    return F.unhex(F.array_join(F.transform(numbers, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def _unpacked(packed: Column) -> Column:
    """The ints of :func:`_packed`, all but the first."""
    n = F.call_function("div", F.octet_length(packed), F.lit(4)).cast("int")
    none = F.array().cast(IDS)
    each = F.transform(F.sequence(F.lit(5), n * 4, F.lit(4)), lambda k: F.conv(F.hex(F.substring(packed, k, 4)), 16, 10).cast("int"))
    return F.when(n > 1, each).otherwise(none)


def encode_by_dictionary(docs: DataFrame, codec: BpeCodec, keys: list[str], text: str = "text") -> DataFrame:
    """``(*keys, ids)``: every distinct pre-token is encoded once for all documents and joined back to its places.

    The same ids as :meth:`BpeCodec.encode`, which keeps a dictionary for each task instead. ``keys`` tell documents
    apart. Of the dictionary the part that makes up most places, at most FREQUENT pre-tokens, is broadcast; no other
    pre-token fills more than a FREQUENT-th of the shuffled join. What is gathered for a document is a few bytes a place,
    packed: place and ids.
    """
    placed = docs.select(*keys, F.posexplode_outer(codec.pieces(F.col(text))).alias("pos", "w"))
    counted = placed.where("w is not null").groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    encoded = counted.select("w", "n", codec.encode_pieces(F.array("w")).alias("ids"))
    dictionary = stage(encoded.select("w", "n", _packed(F.col("ids")).alias("ids")), "piece-ids")
    total = dictionary.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * FREQUENT > total
    known = placed.join(F.broadcast(dictionary.where(often).select("w", "ids")), "w", "left")
    rest = known.where("ids is null").drop("ids").join(dictionary.where(~often).select("w", "ids"), "w", "left")
    every = known.where("ids is not null").unionByName(rest)
    parts = F.array_sort(F.collect_list(F.concat(F.unhex(F.lpad(F.hex("pos"), 8, "0")), "ids")))
    return every.groupBy(*keys).agg(parts.alias("parts")).select(
        *keys, F.flatten(F.transform("parts", _unpacked)).alias("ids"))


def audit(docs: DataFrame, codec) -> DataFrame:
    """Tokens, characters and characters per token, per source."""
    n = F.octet_length("text") if codec.counts_without_encoding else F.size(codec.encode(F.col("text")))
    return (
        docs.select("source", F.length("text").alias("chars"), n.cast("bigint").alias("tokens"))
        .groupBy("source")
        .agg(F.sum("tokens").alias("tokens"), F.sum("chars").alias("chars"))
        .withColumn("chars_per_token", F.try_divide("chars", "tokens"))
    )

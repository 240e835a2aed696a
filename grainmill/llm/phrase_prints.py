"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into phrases as LZ78 does: each phrase is the longest known one and a further byte, and joins the
dictionary. Texts that compress well together share phrases. The phrase set is hashed; the fingerprint is its SIZE
smallest hashes, from which the share of common phrases of two texts is estimated: of the smallest hashes of both
together, those that both have. Texts with fewer phrases than that are compared exactly.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from grainmill.llm import arrays as A
from grainmill.llm.common import shuffle_partitions
from grainmill.session import stage_counted

SIZE = 64  # hashes of a fingerprint, 32 bits each
DICTIONARY = 1 << 19  # phrases known at once; a longer text starts a new dictionary, its phrase set goes on
SAMPLE_PER_RANGE = 32  # keys sampled for each range of the order of documents
INVERSE = pow(int(A.BASE_A), -1, 1 << 64)

_byte_values = A.mixed(np.arange(1, 257, dtype=np.uint64))


def phrase_ends(data: bytes) -> list[int]:
    """Where each phrase ends. What is left at the end of the text is a phrase too, known or not."""
    root: dict = {}
    node, ends, room = root, [], DICTIONARY
    for i, byte in enumerate(data, 1):
        known = node.get(byte)
        if known is None:
            node[byte] = {}
            ends.append(i)
            room -= 1
            if not room:
                root, room = {}, DICTIONARY
            node = root
        else:
            node = known
    if node is not root:
        ends.append(len(data))
    return ends


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Signer:
    """Fingerprints of texts; equal phrases have equal hashes wherever they stand."""

    def __init__(self) -> None:
        self.up, self.down = _powers(int(A.BASE_A), 0), _powers(INVERSE, 0)

    def __call__(self, data: bytes) -> bytes:
        if not data:
            return b""
        if len(data) > len(self.up):
            n = 1 << (len(data) - 1).bit_length()
            self.up, self.down = _powers(int(A.BASE_A), n), _powers(INVERSE, n)
        stops = np.array(phrase_ends(data))
        starts = np.concatenate([[0], stops[:-1]])
        sums = np.cumsum(_byte_values[np.frombuffer(data, np.uint8)] * self.up[: len(data)], dtype=np.uint64)
        before = np.concatenate([np.zeros(1, np.uint64), sums[stops[:-1] - 1]])
        hashes = (A.mixed((sums[stops - 1] - before) * self.down[starts]) >> np.uint64(32)).astype(np.uint32)
        return np.unique(hashes)[:SIZE].astype(">u4").tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Estimated share of common phrases, 0 to 1; two empty texts are alike."""
    if a == b:
        return 1.0
    left, right = (set(np.frombuffer(x, ">u4").tolist()) for x in (a, b))
    both = sorted(left | right)[:SIZE]
    return sum(x in left and x in right for x in both) / len(both)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text of a batch, equal rows as one with their number."""
    sign = Signer()
    for batch in batches:
        for piece in A.slices(batch, "text"):
            rows: dict[tuple, int] = {}
            for key in zip(piece["id"].to_pylist(), A.text_bytes(piece["text"])):
                rows[key] = rows.get(key, 0) + 1
            ids, texts = zip(*rows)
            yield pa.RecordBatch.from_pydict({
                "id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.binary()).cast(pa.string(), safe=False),
                "print": pa.array(map(sign, texts), pa.binary()), "copies": pa.array(rows.values(), pa.int64()),
            })


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, print, copies) for each document; rows equal in both, of one batch, are one row with ``copies``.

    ``print`` holds the hashes as unsigned 32-bit big-endian integers, ascending. A NULL text counts as empty, and an
    empty one has an empty print. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_signed, "id bigint, text string, print binary, copies bigint")


def _order(id_col: Column, text: Column) -> list[Column]:
    """Ascending keys of descending identifiers, NULL last, then a hash of the text."""
    return [id_col.isNull().cast("int").alias("k0"), F.coalesce(F.bitwise_not(id_col), F.lit(0)).alias("k1"),
            F.xxhash64(text).alias("k2")]


KEYS = ["k0", "k1", "k2"]


def _range(cuts: list[tuple[int, int, int]]) -> Column:
    """Number of cut points at or below the key, found in two steps."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    given = lambda rows: F.from_json(
        F.lit(json.dumps([dict(zip(KEYS, r)) for r in rows])), "array<struct<k0:int,k1:bigint,k2:bigint>>")
    key = F.struct(*KEYS)
    base = F.size(F.filter(given(cuts[step - 1 :: step]), lambda c: c <= key)) * step
    return base + F.size(F.filter(F.slice(given(cuts), base + 1, F.lit(step)), lambda c: c <= key))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, print, copies, next_text, next_print): every document beside the one with the next smaller identifier,
    the last beside the first.

    NULL identifiers come last; rows that share one are ordered by a hash of their texts, and are one row with
    ``copies`` if the texts are equal too: each copy but the last has its own text next. Documents meet in ranges of the
    order, cut by a sample of the keys; the first document of each range is also put at the end of the range before, so
    texts are shuffled once. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ranges = shuffle_partitions(spark)
    keys, n = stage_counted(
        docs.select(*_order(F.col(id_col).cast("bigint"), F.coalesce(F.col(text_col), F.lit("")))), "order-keys")
    every = max(1, n // (SAMPLE_PER_RANGE * ranges))
    sample = keys.where(F.pmod(F.xxhash64(*KEYS, F.lit(5)), F.lit(every)) == 0).distinct()
    seen = sorted(tuple(r) for r in sample.limit(4 * SAMPLE_PER_RANGE * ranges).collect())
    at = _range(sorted({seen[i * len(seen) // ranges] for i in range(1, ranges)} if seen else ()))

    # One row for each range: its first key, and the range before it that has rows.
    order = Window.orderBy("range")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = keys.groupBy(at.alias("range")).agg(F.min(F.struct(*KEYS)).alias("key")).select(
        "key.*", F.coalesce(F.lag("range").over(order), F.last("range").over(whole)).alias("guest_of"))
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), *_order(
        F.col(id_col).cast("bigint"), F.coalesce(F.col(text_col), F.lit(""))))
    guests = (
        texts.join(F.broadcast(firsts), KEYS).groupBy("guest_of").agg(F.first("text").alias("text"))
        .select(F.lit(None).cast("bigint").alias("id"), "text", F.col("guest_of").alias("range"))
    )
    own = fingerprints(docs, id_col, text_col)
    rows = own.select("*", *_order(F.col("id"), F.col("text"))).select(
        "id", "text", "print", "copies", at.alias("range"), F.lit(False).alias("guest"), *KEYS)
    signed = fingerprints(guests.withColumnRenamed("range", "at"), "at").select(
        F.lit(None).cast("bigint").alias("id"), "text", "print", "copies", F.col("id").cast("int").alias("range"),
        F.lit(True).alias("guest"), *[F.lit(0).cast(t).alias(k) for k, t in zip(KEYS, ("int", "bigint", "bigint"))])
    following = Window.partitionBy("range").orderBy("guest", *KEYS)
    return rows.unionByName(signed).select(
        "id", "text", "print", "copies", "guest",
        F.lead("text").over(following).alias("next_text"), F.lead("print").over(following).alias("next_print"),
    ).where("not guest").drop("guest")


def edited(text: Column, other: Column) -> Column:
    """``text`` with its last half replaced by as many characters of ``other``, or all of them."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(other, F.lit(1), half))


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sign = Signer()
    for batch in batches:
        prints = batch["print"].to_pylist()
        changed = [sign(t) for t in A.text_bytes(batch["edited"])]
        near_edited = [likeness(a, b) for a, b in zip(prints, changed)]
        near_next = [likeness(a, b) for a, b in zip(prints, batch["next_print"].to_pylist())]
        yield pa.RecordBatch.from_pydict({
            "id": batch["id"], "n_chars": batch["n_chars"], "edited_sha256": batch["edited_sha256"], "print": batch["print"],
            "edited_print": pa.array(changed, pa.binary()), "near_edited": near_edited, "near_next": near_next,
            "times": batch["times"],
        })


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, print, edited_print, near_edited, near_next), a row for each document.

    The edited text takes its last half from the next document, see :func:`with_next` and :func:`edited`.
    """
    pairs = with_next(docs, id_col, text_col)
    # Of c equal rows, c - 1 are followed by their own text.
    one = F.struct(F.col("next_text").alias("t"), F.col("next_print").alias("p"), F.lit(1).cast("bigint").alias("n"))
    self_next = F.struct(F.col("text").alias("t"), F.col("print").alias("p"), (F.col("copies") - 1).alias("n"))
    each = pairs.select(
        "id", "text", "print", F.explode(F.when(F.col("copies") == 1, F.array(one)).otherwise(F.array(one, self_next))).alias("next"))
    changed = each.select(
        "id", F.length("text").cast("bigint").alias("n_chars"), "print", F.col("next.p").alias("next_print"),
        F.col("next.n").alias("times"), edited(F.col("text"), F.col("next.t")).alias("edited"))
    found = changed.select(
        "id", "n_chars", "print", "next_print", "edited", "times", F.sha2("edited", 256).alias("edited_sha256"))
    schema = ("id bigint, n_chars bigint, edited_sha256 string, print binary, edited_print binary, "
              "near_edited double, near_next double, times bigint")
    return found.mapInArrow(_compared, schema).select(
        F.explode(F.sequence(F.lit(1).cast("bigint"), "times")).alias("copy"), "*").drop("copy", "times")

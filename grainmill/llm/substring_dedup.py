"""Removal of repeated passages by fixed-block anchors.

A window of SPAN words holds a whole aligned block of its document, blocks being (SPAN + 1) / 2 words long. So the
blocks of all documents are indexed and probed with the block-long window from every word on. Hits, and only they, are
extended to the windows around them, which are compared in both documents; adjoining equal windows make up the maximal
exact repeats.

Documents live in blocks of rows of bounded size, dealt out by one shuffle of the text that all steps read. What travels
besides is packed columns: hashes, distinct within a row block, with the smallest or largest identifier there. A passage
in any number of documents is so one entry for each row block, and answers go back to row blocks, not documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from grainmill.llm import arrays as A
from grainmill.llm.common import hidden, shuffle_partitions

SPAN = 13
BLOCK_BYTES = 12 << 20  # text in a row block
PART_BYTES = 12 << 20  # text whose windows meet in one task
NO_ID = np.iinfo(np.int64).max

SPARE_BITS = 14  # a shortened hash meets a wrong one in one of 2**14 probes; hits are compared as windows

# keys and more: the hash and its second half; low and high: ranks among the identifiers, which are in names.
NAMES = ["part", "row_block", "role", "n", "keys", "more", "low", "high", "names"]
PACKED = "part int, row_block int, role int, n int, " + ", ".join(f"{c} binary" for c in NAMES[4:])
INDEX, PROBE, WINDOW = range(3)


def _rows(
    row_block: int, role: int, parts: int, bits: int, keys: np.ndarray, low: np.ndarray | None, high: np.ndarray | None,
    more: np.ndarray | None = None,
) -> list[tuple]:
    """Rows of ascending ``keys`` of so many bits with identifiers, one row for each part that has any."""
    step = (1 << bits) // parts + 1
    inner = np.searchsorted(keys, np.array([i * step for i in range(1, parts)], dtype=np.uint64))
    edges = np.concatenate([[0], inner, [len(keys)]])
    out = []
    for part in range(parts):
        a, b = edges[part], edges[part + 1]
        if b > a:
            given = [x[a:b] for x in (low, high) if x is not None]
            names = np.unique(np.concatenate(given))
            ranks = [b"" if x is None else A.pack(np.searchsorted(names, x[a:b])) for x in (low, high)]
            extra = A.pack(more[a:b]) if more is not None else b""
            out.append((part, row_block, role, int(b - a), A.pack(keys[a:b], True), extra, *ranks,
                        np.array([len(names)], np.int64).tobytes() + A.pack(names, True)))
    return out


def _keys(row: dict) -> np.ndarray:
    return A.unpack(row["keys"], row["n"], True)


def _ids(row: dict, which: str) -> np.ndarray:
    count = int(np.frombuffer(row["names"][:8], np.int64)[0])
    names = A.unpack(row["names"][8:], count, True).view(np.int64)
    return names[A.unpack(row[which], row["n"]).astype(np.int64)]


def _table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32()] * 4 + [pa.binary()] * 5
    names = NAMES
    columns = list(zip(*rows)) if rows else [[]] * 9
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


class _Texts:
    """Words of the documents of a row block."""

    def __init__(self, table: pa.Table | pa.RecordBatch, text: str, ident: str, span: int, bits: int):
        self.texts = A.text_bytes(table.column(text))
        self.words, self.first = A.word_hashes(self.texts)
        ids = table.column(ident)
        ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
        self.ids = ids.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
        self.owner = np.repeat(self.ids, np.diff(self.first))
        self.span, self.block, self.bits = span, (span + 1) // 2, bits

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash of the block-long window from each word on, whether it is whole, whether it is an aligned block)."""
        ok = A.whole(self.first, self.block) & (self.owner != NO_ID)
        place = np.arange(self.first[-1]) - np.repeat(self.first[:-1], np.diff(self.first))
        h = A.windows(self.words, self.block) >> np.uint64(64 - self.bits)
        return h, ok, ok & (place % self.block == 0)

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ok = A.whole(self.first, self.span) & (self.owner != NO_ID)
        return A.windows(self.words, self.span), A.windows(self.words, self.span, A.BASE_B) >> np.uint64(32), ok


def _extreme(keys: np.ndarray, ids: np.ndarray, largest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct keys, each with its smallest or largest identifier."""
    order = np.lexsort((-ids if largest else ids, keys))
    keys, ids = keys[order], ids[order]
    at = A.first_of_runs(keys)
    return keys[at], ids[at]


def _probe_rows(parts: int, bits: int, text: str, ident: str, row_block: str, span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column(row_block).to_numpy()
            for block in np.unique(blocks):
                t = _Texts(batch.filter(pa.array(blocks == block)), text, ident, span, bits)
                h, ok, aligned = t.grams()
                keys, ids = _extreme(h[aligned], t.owner[aligned], False)
                rows = _rows(int(block), INDEX, parts, bits, keys, ids, None)
                keys, ids = _extreme(h[ok], t.owner[ok], True)
                rows += _rows(int(block), PROBE, parts, bits, keys, None, ids)
                yield from _table(rows).to_batches()

    return run


def _hits(bits: int):
    def run(table: pa.Table) -> pa.Table:
        """Which probes of each row block meet an entry of a smaller document, and which entries are met so."""
        rows = table.to_pylist()
        got = {r: [(x["row_block"], _keys(x), _ids(x, "low" if r == INDEX else "high")) for x in rows if x["role"] == r]
               for r in (INDEX, PROBE)}
        if not got[INDEX] or not got[PROBE]:
            return _table([])
        join = lambda role, i: np.concatenate([x[i] for x in got[role]])
        index, least = _extreme(join(INDEX, 1), join(INDEX, 2), False)
        probe, most = _extreme(join(PROBE, 1), join(PROBE, 2), True)
        out = []
        for role, keys, ids in ((PROBE, index, least), (INDEX, probe, most)):
            for block, k, own in got[role]:
                at, hit = _found(keys, k)
                hit &= (ids[at] < own) if role == PROBE else (ids[at] > own)
                if hit.any():
                    out += _rows(block, role, 1, bits, k[hit], ids[at][hit], None)
        return _table(out)

    return run


def _answers(table: pa.Table, role: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys in ascending order with their second hash and identifiers."""
    rows = [x for x in table.to_pylist() if x["role"] == role]
    if not rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys = np.concatenate([_keys(x) for x in rows])
    more = np.concatenate([A.unpack(x["more"], x["n"]) if x["more"] else np.zeros(x["n"], np.uint64) for x in rows])
    ids = np.concatenate([_ids(x, "low") for x in rows])
    order = np.argsort(keys, kind="stable")
    return keys[order], more[order], ids[order]


def _found(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value its first place in ascending keys, and whether it is there."""
    if not len(keys):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return at, keys[at] == values


def _found_pairs(keys: np.ndarray, more: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for pairs; places with equal first halves follow each other."""
    at, same = _found(keys, a)
    at = at.copy()
    while (off := same & (more[at] != b if len(more) else False)).any():
        after = np.minimum(at + 1, len(keys) - 1)
        goes_on = off & (after > at) & (keys[after] == a)
        at = np.where(goes_on, after, at)
        same = same & (~off | goes_on)
    return at, same


def _runs(a: np.ndarray, b: np.ndarray, ids: np.ndarray):
    """Distinct ascending pairs with their smallest and largest identifiers."""
    order = np.lexsort((ids, b, a))
    a, b, ids = a[order], b[order], ids[order]
    if not len(a):
        return a, b, ids, ids
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return a[new], b[new], ids[new], ids[np.concatenate([new[1:], [len(a)]]) - 1]


def _extend(parts: int, bits: int, text: str, ident: str, span: int):
    def run(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows or not answers.num_rows:
            return _table([])
        t = _Texts(docs, text, ident, span, bits)
        h, ok, aligned = t.grams()
        keys, _, least = _answers(answers, PROBE)
        at, hit = _found(keys, h)
        hit &= ok
        hit[hit] = least[at[hit]] < t.owner[hit]
        keys, _, _ = _answers(answers, INDEX)
        hit |= aligned & _found(keys, h)[1]
        # A window belongs to a hit that begins at most span - block words after it.
        n = len(hit)
        ends = np.concatenate([[0], np.cumsum(hit)])
        near = ends[np.minimum(np.arange(n) + span - t.block + 1, n)] > ends[:-1]
        a, b, fits = t.spans()
        pick = near & fits
        a, b, low, high = _runs(a[pick], b[pick], t.owner[pick])
        return _table(_rows(int(key[0].as_py()), WINDOW, parts, 64, a, low, high, b))

    return run


def _repeats(table: pa.Table) -> pa.Table:
    """Windows of each row block that also start in a smaller document, with the smallest."""
    rows = table.to_pylist()
    if not rows:
        return _table([])
    got = [(x["row_block"], _keys(x), A.unpack(x["more"], x["n"]), _ids(x, "low"), _ids(x, "high")) for x in rows]
    a, b, least, _ = _runs(*[np.concatenate([x[i] for x in got]) for i in (1, 2, 3)])
    out = []
    for block, k, m, _, own in got:
        at, _ = _found_pairs(a, b, k, m)
        hit = least[at] < own
        if hit.any():
            out += _rows(block, WINDOW, 1, 64, k[hit], least[at][hit], None, m[hit])
    return _table(out)


def _remove(text: str, ident: str, span: int, keep_text: bool, others: list[str]):
    def run(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        t = _Texts(docs, text, ident, span, 64)
        n = int(t.first[-1])
        gone = np.zeros(n, bool)
        if n and answers.num_rows:
            a, b, fits = t.spans()
            keys, more, least = _answers(answers, WINDOW)
            at, hit = _found_pairs(keys, more, a, b)
            hit &= fits
            hit[hit] = least[at[hit]] < t.owner[hit]
            edge = np.zeros(n + span, np.int64)
            starts = np.flatnonzero(hit)
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + span, -1)
            gone = np.cumsum(edge)[:n] > 0
        counts = np.diff(t.first)
        total = np.concatenate([[0], np.cumsum(gone)])
        removed = total[t.first[1:]] - total[t.first[:-1]]
        kept = []
        for i, body in enumerate(t.texts):
            w = body.split()
            if removed[i]:
                out = gone[t.first[i] : t.first[i + 1]]
                w = [x for x, dead in zip(w, out.tolist()) if not dead]
            joined = b" ".join(w)
            kept.append(joined if keep_text else hashlib.sha256(joined).hexdigest())
        result = pa.array([k.decode() for k in kept]) if keep_text else pa.array(kept, pa.string())
        return pa.table([
            *[docs.column(c) for c in others], pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), result,
        ], names=[*others, "n_words", "n_removed", "kept"])

    return run


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, keep_text: bool = True
) -> DataFrame:
    """All columns of ``docs`` but the text, plus n_words, n_removed and kept.

    Words covered by ``span`` words that also occur, in that order, in a document of smaller identifier are removed;
    the input decides, not what is left. ``kept`` is the rest joined by single spaces, or its SHA-256 if not
    ``keep_text``. Identifiers are integers. Rows that share an identifier do not affect each other; a row without
    one is left as it is and affects no other. NULL text counts as empty. An empty table gives no rows.
    """
    if span < 3 or span % 2 == 0:
        raise ValueError("span must be odd and above 2")
    spark = docs.sparkSession
    size = docs.select(F.sum(F.octet_length(text_col))).first()[0] or 0
    blocks = max(shuffle_partitions(spark), -(-size // BLOCK_BYTES))
    parts = max(1, -(-size // PART_BYTES))
    bits = min(64, int(size).bit_length() + SPARE_BITS)
    others = [c for c in docs.columns if c != text_col]
    ident, text, block = hidden(docs, "ident", "text", "row_block")
    keyed = docs.select(
        *others, F.col(id_col).cast("bigint").alias(ident), F.col(text_col).alias(text),
        F.pmod(F.xxhash64(id_col, text_col), F.lit(blocks)).cast("int").alias(block),
    ).repartition(blocks, block)
    probes = keyed.mapInArrow(_probe_rows(parts, bits, text, ident, block, span), PACKED)
    hits = probes.groupBy("part").applyInArrow(_hits(bits), PACKED)
    spans = keyed.groupBy(block).cogroup(hits.groupBy("row_block")).applyInArrow(
        _extend(parts, bits, text, ident, span), PACKED
    )
    repeats = spans.groupBy("part").applyInArrow(_repeats, PACKED)
    out = T.StructType(
        [docs.schema[c] for c in others if c not in ("n_words", "n_removed", "kept")]
        + [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]
    )
    names = [c for c in others if c not in ("n_words", "n_removed", "kept")]
    return keyed.groupBy(block).cogroup(repeats.groupBy("row_block")).applyInArrow(
        _remove(text, ident, span, keep_text, names), out
    )

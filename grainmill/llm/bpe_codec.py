"""Byte-level BPE encoding and decoding over Arrow batches.

All texts of a batch are one array of code points. A table gives each its class; a class is a function on the states of
the pre-token automaton, and functions compose associatively, so a blocked prefix scan over composed functions finds
the state at every character, and with it every boundary, without a regular expression. The slices between boundaries
are looked up as distinct byte strings in the task's cache; only unseen ones are merged pair by pair.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

CACHE_PIECES = 400_000  # distinct pieces a task remembers before it starts over
BATCH_CHARS = 1 << 21  # characters encoded at once; a longer text is a batch of its own

# Classes of characters once the following ones are known.
LETTER, NUMBER, OTHER, JOIN, ALONE, SPACES, SHORT, LONG, BREAK = range(9)
# States: after a finished token, in letters, numbers, others, white space, after a joining space, and inside a
# contraction that still needs one or two letters.
START, IN_L, IN_N, IN_O, IN_W, JOINED, NEED1, NEED2 = range(8)


def _step(state: int, kind: int) -> tuple[int, bool]:
    """Next state, and whether a token begins at the character."""
    if kind == LETTER:
        if state == NEED2:
            return NEED1, False
        if state == NEED1:
            return START, False
        return IN_L, state not in (IN_L, JOINED)
    if kind == NUMBER:
        return IN_N, state not in (IN_N, JOINED)
    if kind in (OTHER, SHORT, LONG):
        if state in (IN_O, JOINED):
            return IN_O, False
        return {OTHER: IN_O, SHORT: NEED1, LONG: NEED2}[kind], True
    if kind == SPACES:
        return IN_W, state != IN_W
    return (JOINED if kind == JOIN else START), True


@lru_cache(1)
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(compose[f, g] = g after f, image[f, state], begins[state, class]); functions 0..8 are those of the classes."""
    found = [tuple(_step(s, k)[0] for s in range(8)) for k in range(9)]
    for f in found:  # grows until closed under composition
        for k in range(9):
            h = tuple(found[k][s] for s in f)
            if h not in found:
                found.append(h)
    number = {}
    for i, f in enumerate(found):
        number.setdefault(f, i)
    compose = np.array([[number[tuple(g[s] for s in f)] for g in found] for f in found], dtype=np.uint8)
    begins = np.array([[_step(s, k)[1] for k in range(9)] for s in range(8)])
    return compose, np.array(found, dtype=np.uint8), begins


@lru_cache(1)
def class_table() -> np.ndarray:
    """Class of every code point: letter, number, other, or 9 for U+0020 and 10 for other white space."""
    import regex

    every = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x110000)))
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", 10)):
        table[[ord(m) for m in regex.findall(pattern, every)]] = kind
    table[0x20] = 9
    return table


def classes(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Class of each character, what follows it taken into account; ``starts`` are the first characters of texts."""
    n = len(points)
    raw = class_table()[points]
    ends = np.zeros(n + 1, dtype=bool)
    ends[starts] = True
    ends[n] = True
    last = ends[1:]  # a character that ends its text
    white = raw >= 9
    before_word = np.zeros(n, dtype=bool)
    before_word[:-1] = white[:-1] & ~white[1:] & ~last[:-1]
    out = np.where(white, SPACES, raw).astype(np.uint8)
    out[before_word] = np.where(raw[before_word] == 9, JOIN, ALONE)
    marks = np.flatnonzero(points == 0x27)
    if len(marks):
        padded = np.concatenate([points, np.zeros(2, dtype=points.dtype)])
        closed = np.concatenate([ends, [True, True]])
        a, b = padded[marks + 1], padded[marks + 2]
        one = ~closed[marks + 1] & np.isin(a, [ord(c) for c in "stmd"])
        two = ~closed[marks + 1] & ~closed[marks + 2] & np.isin(
            a.astype(np.int64) << 32 | b, [ord(x) << 32 | ord(y) for x, y in ("re", "ve", "ll")]
        )
        out[marks[two]] = LONG
        out[marks[one]] = SHORT
    return out


def scan(functions: np.ndarray, block: int = 64) -> np.ndarray:
    """Inclusive prefix compositions of an array of automaton functions."""
    compose, _, _ = automaton()
    n = len(functions)
    if n <= block:
        out = functions.copy()
        for i in range(1, n):
            out[i] = compose[out[i - 1], out[i]]
        return out
    rows = -(-n // block)
    padded = np.zeros(rows * block, dtype=np.uint8)
    padded[:n] = functions
    grid = np.ascontiguousarray(padded.reshape(rows, block).T)
    for i in range(1, block):
        grid[i] = compose[grid[i - 1], grid[i]]
    whole = scan(grid[-1], block)
    grid[:, 1:] = compose[whole[:-1][None, :], grid[:, 1:]]
    return np.ascontiguousarray(grid.T).reshape(-1)[:n]


def boundaries(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Positions where tokens begin, over all texts."""
    if not len(points):
        return np.zeros(0, dtype=np.int64)
    _, image, begins = automaton()
    kinds = classes(points, starts)
    state = np.empty(len(points), dtype=np.uint8)
    # A text begins in START whatever came before: what follows a break is a constant function.
    functions = kinds.copy()
    compose, found, _ = automaton()
    after_break = compose[BREAK, kinds[starts]]
    functions[starts] = after_break
    state[0] = START
    state[1:] = image[scan(functions)[:-1], START]
    state[starts] = START
    return np.flatnonzero(begins[state, kinds])


@lru_cache(4)
def load_ranks(path: str) -> tuple[dict[bytes, int], pa.Array]:
    """Ranks by bytes, and bytes by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f.read().splitlines() if line.strip()]
    ranks = {base64.b64decode(a): int(b) for a, b in pairs}
    size = max(ranks.values()) + 1
    pieces: list[bytes | None] = [None] * size
    for piece, rank in ranks.items():
        pieces[rank] = piece
    return ranks, pa.array(pieces, pa.large_binary())


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the adjacent pair of lowest rank, leftmost first, until none is left."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    if len(piece) > 500:
        return _merge_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    far = 1 << 60
    scores = [ranks.get(parts[i] + parts[i + 1], far) for i in range(len(parts) - 1)]
    while scores and (best := min(scores)) < far:
        i = scores.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del scores[i]
        if i < len(scores):
            scores[i] = ranks.get(parts[i] + parts[i + 1], far)
        if i:
            scores[i - 1] = ranks.get(parts[i - 1] + parts[i], far)
    return [ranks[p] for p in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for long pieces, with a heap over linked neighbours."""
    from heapq import heapify, heappop, heappush

    n = len(piece)
    end, prev = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n

    def offer(i: int):
        j = end[i]
        rank = ranks.get(piece[i : end[j]]) if j < n else None
        return None if rank is None else (rank, i, end[j])

    heap = [x for i in range(n) if (x := offer(i))]
    heapify(heap)
    while heap:
        _, i, stop = heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        gone = end[i]
        alive[gone] = False
        end[i] = stop
        if stop < n:
            prev[stop] = i
        for k in (i, prev[i]):
            if k >= 0 and (x := offer(k)):
                heappush(heap, x)
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class Codec:
    """Encodes and decodes with one rank file; keeps a cache of merged pieces."""

    def __init__(self, path: str):
        self.ranks, self.pieces = load_ranks(path)
        self.cache: dict[bytes, list[int]] = {}

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all texts, first id of each text and the total, end of each id in bytes of its text)."""
        counts = np.array([len(t) for t in texts], dtype=np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")
        firsts = np.concatenate([[0], np.cumsum(counts)])
        cuts = boundaries(points, firsts[:-1][counts > 0])
        width = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
        place = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
        data = "".join(texts).encode()
        slices = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(cuts),
            [None, pa.py_buffer(np.concatenate([place[cuts], [len(data)]]).astype(np.int64).tobytes()), pa.py_buffer(data)],
        ).dictionary_encode()
        distinct = slices.dictionary.to_pylist()
        if len(self.cache) + len(distinct) > CACHE_PIECES:
            self.cache.clear()
        runs = []
        for piece in distinct:
            ids = self.cache.get(piece)
            if ids is None:
                ids = self.cache[piece] = merge_piece(piece, self.ranks)
            runs.append(ids)
        sizes = np.array([len(r) for r in runs], dtype=np.int64)
        table = np.array([i for r in runs for i in r], dtype=np.int64)
        picks = slices.indices.to_numpy(zero_copy_only=False)
        run_starts = np.concatenate([[0], np.cumsum(sizes)])
        taken = sizes[picks] if len(picks) else np.zeros(0, dtype=np.int64)
        ends = np.concatenate([[0], np.cumsum(taken)])
        ids = table[np.arange(ends[-1]) + np.repeat(run_starts[picks] - ends[:-1], taken)] if len(picks) else table
        doc_first = ends[np.searchsorted(cuts, firsts)]
        return ids, doc_first, self.token_ends(ids, doc_first)

    def token_ends(self, ids: np.ndarray, doc_first: np.ndarray) -> np.ndarray:
        lengths = self.lengths()[ids]
        total = np.concatenate([[0], np.cumsum(lengths)])
        return total[1:] - np.repeat(total[doc_first[:-1]], np.diff(doc_first))

    @lru_cache(1)  # noqa: B019  one codec a task
    def lengths(self) -> np.ndarray:
        return np.array([len(p or b"") for p in self.pieces.to_pylist()], dtype=np.int64)

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bytes of all ids joined, and the end of each id in them."""
        ends = np.cumsum(self.lengths()[ids])
        if not len(ids):
            return b"", ends
        return self.pieces.take(pa.array(ids)).buffers()[2].to_pybytes()[: int(ends[-1])], ends


ENCODED = T.StructType([
    T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.IntegerType())),
])


def _batches(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > BATCH_CHARS:
            yield start, i
            start, size = i, 0
        size += len(t)
    if texts:
        yield start, len(texts)


def _lists(values: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.astype(np.int32)))


def encode_documents(docs: DataFrame, ranks_path: str, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """All columns of ``docs`` (the text only with ``keep_text``), plus ids and ends (bytes up to the end of each id).

    NULL counts as empty and gives empty arrays. The rank file must lie at the same path on every worker, as an
    installed package does. Columns named ids and ends are replaced.
    """
    others = [c for c in docs.columns if c not in ("ids", "ends") and (keep_text or c != text_col)]
    schema = T.StructType([docs.schema[c] for c in others] + list(ENCODED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks_path)
        for batch in batches:
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            for a, b in _batches(texts):
                ids, first, ends = codec.encode(texts[a:b])
                columns = [batch.column(c).slice(a, b - a) for c in others]
                yield pa.RecordBatch.from_arrays([*columns, _lists(ids, first), _lists(ends, first)], [*others, "ids", "ends"])

    return docs.select(*others, *([] if keep_text else [text_col])).mapInArrow(run, schema)


def decode_documents(
    encoded: DataFrame, ranks_path: str, digests: bool = False, keep_ids: bool = False
) -> DataFrame:
    """All columns of ``encoded`` but ends and, unless ``keep_ids``, ids, plus ``bytes``; with ``digests`` n_tokens, ids_sha256, decoded_sha256.

    Empty or NULL ids give empty bytes. With ``digests`` the bytes are left out, so that long tables stay narrow.
    """
    others = [c for c in encoded.columns if c not in ("ends", "bytes") and (keep_ids or c != "ids")]
    fields = [encoded.schema[c] for c in others]
    names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["bytes"]
    kinds = [T.LongType(), T.StringType(), T.StringType()] if digests else [T.BinaryType()]
    schema = T.StructType(fields + [T.StructField(n, k) for n, k in zip(names, kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks_path)
        for batch in batches:
            column = batch.column("ids")
            sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ids = column.flatten().to_numpy(zero_copy_only=False)
            first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            data, ends = codec.decode(ids)
            at = np.concatenate([[0], ends])[first]
            texts = [data[at[i] : at[i + 1]] for i in range(len(sizes))]
            if digests:
                raw = ids.astype("<u4")
                new = [
                    pa.array(sizes, pa.int64()),
                    pa.array([hashlib.sha256(raw[first[i] : first[i + 1]].tobytes()).hexdigest() for i in range(len(sizes))]),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
                ]
            else:
                new = [pa.array(texts, pa.binary())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], *new], [*others, *names])

    return encoded.select(*others, *([] if keep_ids else ["ids"])).mapInArrow(run, schema)

"""Numpy helpers for Arrow tasks: words of many texts as numbers, hashes of word windows, and packed columns."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

BASE_A, BASE_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column, b'' for NULL."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).fill_null(b"").to_pylist()


def slices(batch: pa.RecordBatch, column: str, limit: int = 8 << 20):
    """Pieces of a batch with about ``limit`` bytes of text each; a longer text is a piece of its own."""
    sizes = np.cumsum(pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        done = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, done + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word of all texts, first word of each text and the total).

    ``bytes.split`` cuts at U+0020 and U+0009 to U+000D, and ``bytes.lower`` changes A-Z only.
    """
    numbers, counts, distinct = word_numbers(texts, lower)
    return hash_words(distinct)[numbers] if len(numbers) else np.zeros(0, np.uint64), counts


def word_numbers(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(number of every word of all texts, first word of each text and the total, the words by number)."""
    lists = [(t.lower() if lower else t).split() for t in texts]
    first = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)]).astype(np.int64)
    coded = pa.array(chain.from_iterable(lists), pa.large_binary()).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), first, coded.dictionary.to_pylist()


def hash_words(distinct: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, distinct), dtype=np.uint64, count=len(distinct))


def mixed(h: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every bit over all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def windows(words: np.ndarray, size: int, base: np.uint64 = BASE_A) -> np.ndarray:
    """Hash of the ``size`` words from each position of the joined texts on; zero where fewer follow at the very end."""
    n = len(words)
    out = np.zeros(n, dtype=np.uint64)
    if n < size:
        return out
    m = n - size + 1
    acc = words[:m].copy()
    for k in range(1, size):
        acc *= base
        acc += words[k : m + k]
    out[:m] = mixed(acc)
    return out


def whole(first: np.ndarray, size: int) -> np.ndarray:
    """Whether the ``size`` words from each position on lie in one text."""
    counts = np.diff(first)
    left = np.repeat(first[1:], counts) - np.arange(first[-1])
    return left >= size


def pack(values: np.ndarray, ascending: bool = False) -> bytes:
    """64-bit values as compressed byte planes; ascending ones as differences."""
    v = np.ascontiguousarray(values).view(np.uint64)
    if ascending and len(v):
        v = np.concatenate([v[:1], np.diff(v)])
    return pa.compress(v.view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True) if len(v) else b""


def unpack(data: bytes, n: int, ascending: bool = False) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(pa.decompress(data, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    v = np.ascontiguousarray(planes.reshape(8, n).T).view(np.uint64).ravel()
    return np.cumsum(v, dtype=np.uint64) if ascending else v


def first_of_runs(sorted_values: np.ndarray) -> np.ndarray:
    """Positions where a new value begins."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))

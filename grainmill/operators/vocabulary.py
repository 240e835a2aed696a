"""The token table: reserved markers, the 256 byte pieces, then merged pieces.

Its size is the vocabulary size (8,004 by default), so it lives on the driver and is broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from grainmill.constants import SPECIAL_TOKENS


def byte_alphabet() -> list[str]:
    """The printable stand-in character of each byte value.

    Printable Latin-1 bytes stand for themselves; the others take code points from 256 on, in order.
    """
    own = set(range(0x21, 0x7F)) | set(range(0xA1, 0xAD)) | set(range(0xAE, 0x100))
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


BYTE_CHARS = byte_alphabet()
N_SPECIAL = len(SPECIAL_TOKENS)
# Byte pieces are numbered in code-point order of their stand-ins, after the reserved markers.
BYTE_IDS = [0] * 256
for _id, _byte in enumerate(sorted(range(256), key=lambda b: BYTE_CHARS[b]), start=N_SPECIAL):
    BYTE_IDS[_byte] = _id


@dataclass(frozen=True)
class Vocabulary:
    merges: list[tuple[str, str]] = field(default_factory=list)

    @cached_property
    def pieces(self) -> list[str]:
        """Piece of every id. A merge that spells an existing piece adds no id."""
        out = [*SPECIAL_TOKENS, *sorted(BYTE_CHARS)]
        seen = set(out)
        for left, right in self.merges:
            if left + right not in seen:
                seen.add(left + right)
                out.append(left + right)
        return out

    @cached_property
    def ids(self) -> dict[str, int]:
        return {p: i for i, p in enumerate(self.pieces)}

    @cached_property
    def merge_ranks(self) -> dict[tuple[int, int], tuple[int, int]]:
        """``(left id, right id) -> (rank, merged id)``."""
        ids = self.ids
        return {
            (ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in reversed(list(enumerate(self.merges)))
        }

    @cached_property
    def piece_bytes(self) -> list[bytes]:
        of_char = {c: b for b, c in enumerate(BYTE_CHARS)}
        return [bytes(of_char[c] for c in p) for p in self.pieces]

    @property
    def longest_piece(self) -> int:
        return max(len(b) for b in self.piece_bytes[N_SPECIAL:])

    def vocab_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(enumerate(self.pieces)), "id int, piece string").select("piece", "id")

    def merge_table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, a, b) for i, (a, b) in enumerate(self.merges)]
        return spark.createDataFrame(rows, "rank int, left string, right string")

    @staticmethod
    def from_tables(vocab: DataFrame, merges: DataFrame) -> "Vocabulary":
        """Rebuild from ``(piece, id)`` and ``(rank, left, right)`` tables, which hold one row per token."""
        v = Vocabulary([(r["left"], r["right"]) for r in merges.orderBy("rank").collect()])
        stored = [r["piece"] for r in vocab.orderBy("id").collect()]
        if stored != v.pieces:
            raise ValueError("vocabulary and merge list disagree")
        return v

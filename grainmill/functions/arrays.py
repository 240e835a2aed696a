"""Token-array helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from grainmill.constants import END_ID, WINDOW


def last_n(ids: Column, n: int = WINDOW) -> Column:
    return F.slice(ids, F.greatest(F.size(ids) - (n - 1), F.lit(1)), F.lit(n))


def cut_at_stop(ids: Column, stop: int = END_ID) -> Column:
    """Prefix up to and including the first stop token; the whole array if there is none."""
    at = F.array_position(ids, stop).cast("int")
    return F.when(at > 0, F.slice(ids, F.lit(1), at)).otherwise(ids)


def append_token(ids: Column, token: int = END_ID) -> Column:
    return F.concat(ids, F.array(F.lit(token)))


def shift_pair(ids: Column, window: int = WINDOW) -> tuple[Column, Column]:
    """Inputs and next-token targets of one packed window, widened to BIGINT."""
    x = F.slice(ids, 1, window).cast("array<bigint>")
    y = F.slice(ids, 2, window).cast("array<bigint>")
    return x, y

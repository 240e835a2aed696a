"""Hard negatives by threshold joins over an inverted index of integer vectors.

Dimensions are ordered from the least to the most energy. An index block holds some thousand rows; its posting lists
leave out of each row the first dimensions as long as their norm times that of any anchor stays under the threshold.
A threshold join adds up partial scores from the last dimension on, drops pairs whose partial score and remaining norms
cannot reach the threshold, and scores the rest exactly. Thresholds start high and are lowered, in rounds over the
anchors that are left, until every anchor has its positives, and then until every window of scores is full.

Anchors are a stated query set: they meet the index block by block, in rounds of a bounded size. No pair leaves a task
but the best few for each anchor or window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from grainmill.llm import arrays as A
from grainmill.session import stage, stage_counted

SCALE = 256
ROWS = 4096  # of an index block, about
STEP = 8  # dimensions added up at once
TILE = 512  # anchors scored at once against a block
PAIRS = 1 << 16  # pairs scored exactly at once
FEW = 16  # once less than one pair in so many is left halfway, these are scored and no more is added up
ROUND_BYTES = 4 << 20  # of anchors that are broadcast at once, about
POSITIVE_LEVELS = (0.8, 0.5, 0.3, 0.15, None)  # thresholds, as shares of the product of the norms; None: no threshold
NEGATIVE_LEVELS = (0.75, 0.5, None)  # thresholds, as shares of the positive's score; None: the lower end of the window
EXACT = float(1 << 52)  # integers that float64 adds up exactly

HIT = "anchor bigint, slot int, id bigint, score bigint"


def integers(vector: Column) -> Column:
    """floor(256 x) for each component x."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("bigint"))


def usable(rows: DataFrame, id_col: str, vector_col: str, label_col: str, label: Column | None = None) -> DataFrame:
    """(row, id, label, v) of the rows with a label and a vector whose components are all finite, in the shared folder."""
    x = F.col(vector_col)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    taken = rows.where(F.col(label_col).isNotNull() & x.isNotNull() & ~F.coalesce(bad, F.lit(False)))
    return stage(taken.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("id"),
        (F.col(label_col) if label is None else label).cast("bigint").alias("label"), integers(x).alias("v"),
    ), "vectors")


@dataclass
class Vectors:
    """Rows as arrays, dimensions in index order; ``norms[:, s]`` is the norm of the dimensions before step ``s``."""

    row: np.ndarray
    id: np.ndarray
    named: np.ndarray
    label: np.ndarray
    v: np.ndarray
    exact: bool
    norms: np.ndarray

    @staticmethod
    def of(table: pa.Table | pa.RecordBatch, order: np.ndarray) -> "Vectors":
        ids, lists = table["id"], table["v"]
        if isinstance(lists, pa.ChunkedArray):
            ids, lists = ids.combine_chunks(), lists.combine_chunks()
        sizes = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        v = np.zeros((len(sizes), len(order)), dtype=np.int64)
        v[np.arange(len(order))[None, :] < sizes[:, None]] = flat  # missing components are zero
        return Vectors.make(
            table["row"].to_numpy(), ids.fill_null(0).to_numpy(zero_copy_only=False),
            ids.is_valid().to_numpy(zero_copy_only=False), table["label"].to_numpy(), v[:, order])

    @staticmethod
    def make(row, id, named, label, v) -> "Vectors":
        squares = v.astype(np.float64) ** 2
        edges = np.append(np.arange(0, v.shape[1], STEP), v.shape[1])
        sums = np.concatenate([np.zeros((len(v), 1)), np.cumsum(squares, axis=1)], axis=1)[:, edges]
        norms = np.sqrt(sums)
        return Vectors(row, id, named, label, v, bool((sums[:, -1] < EXACT).all()), norms)

    def take(self, at: np.ndarray | slice) -> "Vectors":
        return Vectors(self.row[at], self.id[at], self.named[at], self.label[at], self.v[at], self.exact, self.norms[at])


def above(x: Vectors, q: Vectors, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, row, score) arrays of the pairs whose score reaches the anchor's ``least``, a tile of anchors at a time."""
    if not len(x.row) or not len(q.row):
        return
    steps = x.norms.shape[1] - 1
    reach = np.min(least / np.maximum(q.norms[:, -1], 1e-300))
    # Steps that a row's posting lists leave out: those before the first edge at which its norm could reach a threshold.
    out = np.maximum((x.norms < reach * (1 - 1e-9)).sum(axis=1) - 1, 0)
    by_out = np.argsort(out, kind="stable")
    x, out = x.take(by_out), out[by_out]
    xf = x.v.astype(np.float64)
    listed = np.searchsorted(out, np.arange(steps), "right")  # rows in the lists of each step: those up to here
    rest = x.norms[np.arange(len(out)), out]
    for t in range(0, len(q.row), TILE):
        qt, low = q.take(slice(t, t + TILE)), least[t : t + TILE, None]
        slack = 1e-9 * qt.norms[:, -1:] * x.norms[:, -1].max(initial=0.0)
        partial = np.zeros((len(qt.row), len(x.row)))
        whole = False  # partial scores are scores
        qf = qt.v.astype(np.float64)
        for s in reversed(range(steps)):
            k, dims = listed[s], slice(s * STEP, min((s + 1) * STEP, xf.shape[1]))
            partial[:, :k] += qf[:, dims] @ xf[:k, dims].T
            if s == steps // 2:
                left = np.maximum(out, s)  # what is still to come, listed or not
                alive = partial + qt.norms[:, left] * x.norms[np.arange(len(left)), left] >= low - slack
                if np.count_nonzero(alive) < alive.size // FEW:
                    break
        else:
            alive = partial + qt.norms[:, out] * rest >= low - slack
            whole = x.exact and q.exact and not out.any()
        a, b = np.nonzero(alive)
        if whole:
            scores = partial[a, b].astype(np.int64)
        else:
            scores = np.empty(len(a), dtype=np.int64)
            for i in range(0, len(a), PAIRS):
                cut = slice(i, i + PAIRS)
                scores[cut] = np.einsum("ij,ij->i", qt.v[a[cut]], x.v[b[cut]])
        enough = scores >= np.ceil(low[a, 0])
        yield a[enough] + t, by_out[b[enough]], scores[enough]


def _best(group: np.ndarray, ids: np.ndarray, named: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
    """Positions of the first ``n`` of each group: higher scores first, then smaller identifiers, NULL last."""
    order = np.lexsort((ids, ~named, -score, group))
    starts = A.first_of_runs(group[order])
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[place < n]


class Best:
    """The best hits so far for each group, an anchor and slot, of a task."""

    def __init__(self, n: int):
        self.n, self.hits = n, (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))

    def add(self, group: np.ndarray, ids: np.ndarray, named: np.ndarray, score: np.ndarray) -> None:
        every = [np.concatenate(c) for c in zip(self.hits, (group, ids, named, score))]
        kept = _best(*every, self.n)
        self.hits = tuple(c[kept] for c in every)


@dataclass
class Index:
    blocks: DataFrame  # (block, row, id, label, v), a row for each block
    order: np.ndarray  # dimensions, least energy first
    norm: float  # of the longest vector


def _packed(block: pa.Table) -> pa.Table:
    of = {c: block[c].combine_chunks() for c in ("row", "id", "label")}
    lists = lambda a: pa.array([a.to_pylist()], pa.list_(pa.int64()))
    v = block["v"].combine_chunks()
    sizes = pa.compute.list_value_length(v)
    values = v.flatten().to_numpy(zero_copy_only=False)
    return pa.table({
        **{c: lists(a) for c, a in of.items()}, "sizes": lists(sizes.cast(pa.int64())),
        "n_values": pa.array([len(values)], pa.int64()), "v": pa.array([A.pack(values)], pa.binary()),
    })


BLOCKS = "row array<bigint>, id array<bigint>, label array<bigint>, sizes array<bigint>, n_values bigint, v binary"


def index(rows: DataFrame, n: int) -> Index:
    """``rows`` (row, id, label, v) dealt at random to blocks of about ROWS, each packed into one row of a table."""
    energy = rows.select(F.posexplode("v").alias("dim", "x")).groupBy("dim").agg(
        F.sum(F.col("x").cast("double") * F.col("x")).alias("e")).collect()  # one row for each dimension
    dims = max((r["dim"] for r in energy), default=-1) + 1
    size = np.zeros(dims)
    for r in energy:
        size[r["dim"]] = r["e"]
    squares = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x)
    longest = rows.agg(F.max(squares)).first()[0] or 0.0
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(-(-n // ROWS) or 1)))
    blocks = stage(dealt.groupBy("block").applyInArrow(_packed, BLOCKS), "vector-blocks")
    return Index(blocks, np.argsort(size, kind="stable"), float(np.sqrt(longest)))


def _unpacked(batch: pa.RecordBatch, order: np.ndarray) -> Iterator[Vectors]:
    for i in range(batch.num_rows):
        part = batch.slice(i, 1)
        sizes = part["sizes"].flatten().to_numpy(zero_copy_only=False)
        flat = A.unpack(part["v"][0].as_py(), part["n_values"][0].as_py()).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(flat))
        rows = {c: part[c].flatten() for c in ("row", "id", "label")}
        yield Vectors.of(pa.table({**rows, "v": lists}), order)


Hits = Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]
Search = Callable[[Vectors, pa.Table], Callable[[Vectors], Hits]]


def _in_rounds(index: Index, anchors: DataFrame, n: int, best: int, search: Search) -> DataFrame:
    """(anchor, slot, id, score): the best few of what ``search`` finds, over all blocks.

    ``search(anchors, table)`` gives a function from a block to (group, place in the block, score), with group = 1,000
    anchor + slot. Anchors are broadcast in chunks of a bounded size, one job for each chunk.
    """
    spark, order = anchors.sparkSession, index.order
    chunks = -(-n * max(1, len(order)) * 8 // ROUND_BYTES)
    dealt = anchors.withColumn("chunk", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(max(1, chunks))))
    found = None
    for c in range(chunks):
        table = dealt.where(F.col("chunk") == c).drop("chunk").toArrow()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        sent = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())

        def score(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            asked = pa.ipc.open_stream(sent.value).read_all()
            q, hits = Vectors.of(asked, order), Best(best)
            within = search(q, asked)
            for batch in batches:
                for block in _unpacked(batch, order):
                    for group, at, scores in within(block):
                        hits.add(group, block.id[at], block.named[at], scores)
            group, ids, named, scores = hits.hits
            yield pa.RecordBatch.from_pydict({
                "anchor": q.row[group // 1000], "slot": pa.array(group % 1000, pa.int32()),
                "id": pa.array(ids, pa.int64(), mask=~named), "score": scores,
            })

        hits = stage(index.blocks.mapInArrow(score, HIT), "vector-hits")
        sent.destroy()
        found = hits if found is None else found.unionByName(hits)
    place = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    ranked = found.withColumn("place", F.row_number().over(place)).where(F.col("place") <= best)
    return stage(ranked, "vector-best")


def positives(index: Index, anchors: DataFrame, n: int, k: int) -> DataFrame:
    """(anchor, place, id, score): the first ``k`` other rows of each anchor's label, or all if there are fewer."""
    done = None
    for share in POSITIVE_LEVELS:
        def search(q: Vectors, _: pa.Table, share=share, norm=index.norm) -> Callable[[Vectors], Hits]:
            least = np.full(len(q.row), -np.inf) if share is None else share * norm * q.norms[:, -1]

            def within(x: Vectors) -> Hits:
                for a, b, score in above(x, q, least):
                    same = (q.label[a] == x.label[b]) & (q.row[a] != x.row[b])
                    yield a[same] * 1000, b[same], score[same]

            return within

        found = _in_rounds(index, anchors, n, k, search)
        if share is not None:
            full = found.where(F.col("place") == k).select(F.col("anchor").alias("row"))
            anchors, n = stage_counted(anchors.join(full, "row", "left_anti"), "vector-anchors")
            found = found.join(full.withColumnRenamed("row", "anchor"), "anchor", "left_semi")
        done = found if done is None else done.unionByName(found)
        if not n:
            break
    return stage(done.drop("slot"), "vector-positives")


def negatives(index: Index, windows: DataFrame, n: int, k: int, low: int, high: int) -> DataFrame:
    """(anchor, slot, place, id, score): the first ``k`` rows of other labels in each window of scores.

    ``windows`` (row, id, label, v, slots, scores): for each anchor its open windows and their positives' scores, which
    a negative's score is to reach at ``low`` hundredths and not to pass at ``high``.
    """
    done = None
    for share in NEGATIVE_LEVELS:
        def search(q: Vectors, asked: pa.Table, share=share) -> Callable[[Vectors], Hits]:
            given = list(zip(asked["slots"].to_pylist(), asked["scores"].to_pylist()))
            width = max(len(s) for s, _ in given)
            slots, scores = np.full((len(given), width), -1), np.zeros((len(given), width), dtype=np.int64)
            for i, (s, p) in enumerate(given):
                slots[i, : len(s)], scores[i, : len(p)] = s, p
            least, most = -(-low * scores // 100), high * scores // 100
            start = least if share is None else np.maximum(least, np.ceil(share * scores))
            floor = np.where(slots >= 0, start, np.inf).min(axis=1)

            def within(x: Vectors) -> Hits:
                for a, b, score in above(x, q, floor):
                    other = q.label[a] != x.label[b]
                    a, b, score = a[other], b[other], score[other]
                    for w in range(width):
                        inside = (slots[a, w] >= 0) & (score >= least[a, w]) & (score <= most[a, w])
                        yield a[inside] * 1000 + slots[a[inside], w], b[inside], score[inside]

            return within

        found = _in_rounds(index, windows, n, k, search)
        if share is not None:
            full = found.where(F.col("place") == k).select("anchor", "slot")
            left = windows.select("row", F.explode(F.arrays_zip("slots", "scores")).alias("w")).select("row", "w.*")
            left = left.join(full.select(F.col("anchor").alias("row"), F.col("slot").alias("slots")), ["row", "slots"], "left_anti")
            again = left.groupBy("row").agg(F.collect_list("slots").alias("slots"), F.collect_list("scores").alias("scores"))
            windows, n = stage_counted(windows.drop("slots", "scores").join(again, "row"), "vector-windows")
            found = found.join(full, ["anchor", "slot"], "left_semi")
        done = found if done is None else done.unionByName(found)
        if not n:
            break
    return done


def mine(
    rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    label: Column | None = None, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Scores are integer inner products of floor(256 x). For each anchor (a row of which ``is_anchor``, an expression on
    id, label and v, holds) and each of its first ``n_positives`` other rows of its label: the first ``n_negatives`` rows of other
    labels whose score is from ``low`` to ``high`` hundredths of the positive's. Higher scores come first, ties by
    smaller identifier, NULL identifiers last. Rows with a NULL label or vector or a component that is NULL or not
    finite take no part. Vectors of different lengths count as filled up with zeros. Rows that share an identifier are
    rows of their own. An empty table, or one without anchors, gives no rows. Scores are 64-bit integers.
    Other columns are not read. At most 1,000 positives.
    """
    vectors = usable(rows, id_col, vector_col, label_col, label)
    found = index(vectors, vectors.count())
    anchors, n = stage_counted(vectors.where(is_anchor), "vector-anchors")
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not n or not len(found.order):
        return rows.sparkSession.createDataFrame([], schema)
    near = positives(found, anchors, n, n_positives)
    per = near.groupBy(F.col("anchor").alias("row")).agg(
        F.collect_list(F.col("place") - 1).alias("slots"), F.collect_list("score").alias("scores"))
    windows, n = stage_counted(anchors.join(per, "row"), "vector-windows")
    if not n:
        return rows.sparkSession.createDataFrame([], schema)
    far = negatives(found, windows, n, n_negatives, low, high)
    pairs = near.select("anchor", (F.col("place") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    names = anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return far.join(pairs, ["anchor", "slot"]).join(names, "anchor").select(
        "anchor_id", "positive_id", F.col("place").alias("rank"), F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))

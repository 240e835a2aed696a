"""Merkle manifest of a table: a leaf for every row, a root for every part and for all, and a witness for each leaf.

Leaves are appended in order to an open tree: it keeps the roots of its complete subtrees, and every leaf the part of its
witness that lies in its subtree. When a subtree meets its completed sibling, both extend their leaves' witnesses by each
other's root. A block of aligned 2^LEVELS leaves is such a tree, built in one task; its root is a further append to a
tree of blocks, and so on, until a part has one node. The manifest is one table for each of these depths, so rows that
come later reopen only the last block of each depth (:func:`append`).
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from grainmill.operators.ordering import prefix_sums
from grainmill.session import stage

LEVELS = 10  # of a block: 1,024 nodes
BLOCK = 1 << LEVELS
NODE = "part string, pos bigint, digest string, row struct<id:bigint,extra:string>"
TREE = f"{NODE}, block bigint, root string, witness array<struct<left:boolean,digest:string>>"


def written(value: Column) -> Column:
    """Byte count, colon and value; '-' for NULL."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Iterable[Column]) -> Column:
    return F.sha2(F.concat(*map(written, values)), 256)


def _hash(*digests: str) -> str:
    from hashlib import sha256

    return sha256("".join(digests).encode()).hexdigest()


class OpenTree:
    """An append-only tree over the leaves of one block, with the witnesses of its leaves as far as they are known."""

    def __init__(self, size: int):
        self.open: list[tuple[int, int, int, str]] = []  # (height, first leaf, leaf after the last, root)
        self.left = np.zeros((size, LEVELS), dtype=bool)
        self.sibling = np.full((size, LEVELS), "", dtype=object)

    def _settle(self) -> None:
        """Join the last two subtrees while they are siblings of equal height."""
        while len(self.open) > 1 and self.open[-1][0] == self.open[-2][0]:
            h, mid, stop, right = self.open.pop()
            _, start, _, left = self.open.pop()
            self.sibling[start:mid, h], self.sibling[mid:stop, h] = right, left
            self.left[mid:stop, h] = True
            self.open.append((h + 1, start, stop, _hash(left, right)))

    def append(self, digest: str) -> None:
        at = self.open[-1][2] if self.open else 0
        self.open.append((0, at, at + 1, digest))
        self._settle()

    def close(self, height: int | None) -> tuple[int, str]:
        """(height, root) once every subtree without a sibling is hashed alone up to ``height``, or to a single node."""
        while len(self.open) > 1 or (height is not None and self.open[0][0] < height):
            h, start, stop, root = self.open.pop()
            self.open.append((h + 1, start, stop, _hash(root)))
            self._settle()
        return self.open[0][0], self.open[0][3]


def _block_tree(block: pa.Table) -> pa.Table:
    nodes = block.sort_by("pos")
    tree = OpenTree(len(nodes))
    for digest in nodes["digest"].to_pylist():
        tree.append(digest)
    height, root = tree.close(nodes["height"][0].as_py())
    entries = pa.StructArray.from_arrays(
        [pa.array(tree.left[:, :height].ravel()), pa.array(tree.sibling[:, :height].ravel(), pa.string())], ["left", "digest"])
    witness = pa.ListArray.from_arrays(pa.array(np.arange(len(nodes) + 1) * height, pa.int32()), entries)
    return pa.table({
        **{c: nodes[c] for c in ("part", "pos", "digest", "row", "block")},
        "root": pa.array([root] * len(nodes), pa.string()), "witness": witness,
    })


@dataclass
class Manifest:
    """``counts`` (part, n); ``depths[k]`` (part, pos, digest, row, block, root, witness within the block)."""

    counts: DataFrame
    depths: list[DataFrame]


def _extend(old: list[DataFrame], fresh: DataFrame, counts: DataFrame) -> list[DataFrame]:
    """All depths after the nodes ``fresh``, new or changed, have been put in; ``counts`` are the new ones."""
    out: list[DataFrame] = []
    largest = counts.agg(F.max("n")).first()[0] or 0
    while True:
        k, size = len(out), BLOCK ** len(out)
        fresh = fresh.withColumn("block", F.expr(f"pos div {BLOCK}"))
        if k < len(old):
            touched = fresh.select("part", "block").distinct()
            rest = old[k].select(*fresh.columns).join(touched, ["part", "block"], "left_semi")
            fresh = fresh.unionByName(rest.join(fresh.select("part", "pos"), ["part", "pos"], "left_anti"))
        nodes = F.expr(f"(n + {size - 1}) div {size}")
        sized = fresh.join(counts, "part").select(
            *fresh.columns, F.when(nodes > BLOCK, LEVELS).otherwise(F.lit(None)).cast("int").alias("height"))
        grown = stage(sized.groupBy("part", "block").applyInArrow(_block_tree, TREE), f"merkle-{k}")
        if k < len(old):
            out.append(old[k].join(touched, ["part", "block"], "left_anti").select(*grown.columns).unionByName(grown))
        else:
            out.append(grown)
        if largest <= size * BLOCK:
            return out
        above = grown if k + 1 < len(old) else out[k]  # a new depth takes all blocks, an old one those that changed
        fresh = above.where(f"pos % {BLOCK} = 0").select(
            "part", F.col("block").alias("pos"), F.col("root").alias("digest"),
            F.lit(None).cast("struct<id:bigint,extra:string>").alias("row"))


def _leaves(docs: DataFrame, part: str, order: str, fields: list[str], extra: Column | None) -> DataFrame:
    """(part, pos, digest, row), positions from 0 in each part; equal rows take neighbouring ones."""
    rows = docs.select(
        F.coalesce(F.concat(F.lit("1"), F.col(part).cast("string")), F.lit("0")).alias("part"),
        F.col(order).cast("bigint").alias("id"), leaf(F.col(c) for c in fields).alias("digest"),
        (F.lit(None) if extra is None else extra).cast("string").alias("extra"),
        F.monotonically_increasing_id().alias("tie"),  # tells equal rows apart once written
    )
    keyed = stage(rows, "merkle-leaves").select(
        "part", F.col("id").isNotNull().cast("int").alias("named"), F.coalesce("id", F.lit(0)).alias("at"),
        "digest", "tie", "extra")
    order_by = ["named", "at", "digest", "tie"]
    return prefix_sums(keyed, ["part"], order_by, {"pos": F.lit(1).cast("bigint")}).select(
        "part", "pos", "digest",
        F.struct(F.when(F.col("named") == 1, F.col("at")).alias("id"), "extra").alias("row"))


def build(docs: DataFrame, part: str, order: str, fields: list[str], extra: Column | None = None) -> Manifest:
    """The manifest of ``docs``: one tree for each value of ``part``, leaves in ascending order of the integer ``order``.

    A leaf is the SHA-256 of ``fields``. NULL parts are a part of their own, the first; NULL identifiers come first in
    theirs; rows that share an identifier are ordered by leaf. Equal rows are leaves of their own. An empty table gives
    an empty manifest. ``extra`` is text kept beside each leaf. Other columns are not read.
    """
    leaves = _leaves(docs, part, order, fields, extra)
    leaves = stage(leaves, "merkle-nodes")
    counts = stage(leaves.groupBy("part").agg(F.count(F.lit(1)).alias("n")), "merkle-counts")
    return Manifest(counts, _extend([], leaves, counts))


def append(manifest: Manifest, docs: DataFrame, part: str, order: str, fields: list[str], extra: Column | None = None) -> Manifest:
    """The manifest with the rows of ``docs`` appended, each part's after those it has, in order among themselves.

    Only the last block of each depth is opened again; all other witnesses stay as they are. Where identifiers grow from
    batch to batch, as in a stream, the result is the manifest of all rows together.
    """
    leaves = stage(_leaves(docs, part, order, fields, extra), "merkle-nodes")
    before = manifest.counts.withColumnRenamed("n", "had")
    moved = leaves.join(before, "part", "left").withColumn("pos", F.col("pos") + F.coalesce("had", F.lit(0))).drop("had")
    added = leaves.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    counts = stage(manifest.counts.unionByName(added).groupBy("part").agg(F.sum("n").alias("n")), "merkle-counts")
    return Manifest(counts, _extend(manifest.depths, stage(moved, "merkle-nodes"), counts))


def _whole(depths: list[DataFrame]) -> DataFrame:
    """(part, pos, digest, row, subroot, witness up to it): the depths joined on the block each node lies in."""
    above = None
    for depth in reversed(depths):
        tree = depth.select("part", "pos", "digest", "row", "block", "root", "witness")
        if above is not None:
            upper = above.select("part", F.col("pos").alias("block"), F.col("subroot").alias("root"), F.col("witness").alias("higher"))
            tree = tree.drop("root").join(upper, ["part", "block"]).withColumn("witness", F.concat("witness", "higher"))
        above = tree.select("part", "pos", "digest", "row", F.col("root").alias("subroot"), "witness")
    return above


def witnesses(manifest: Manifest) -> DataFrame:
    """(part, pos, id, extra, leaf, subroot, root, witness) for each leaf.

    The subroots are the leaves of a last tree, in bytewise order of their parts. ``witness`` has an entry for each level
    from the leaf to the root: the sibling and whether it stands left; '' where the node is hashed alone.
    """
    leaves = _whole(manifest.depths)
    top = manifest.depths[-1].where("pos = 0").select("part", F.col("root").alias("digest"))
    placed = prefix_sums(
        top.select(F.lit(0).alias("all"), "part"), ["all"], ["part"], {"pos": F.lit(1).cast("bigint")}
    ).drop("all").join(top, "part").withColumnRenamed("part", "name")
    nodes = stage(placed.select(
        F.lit("").alias("part"), "pos", "digest", F.struct(F.lit(None).cast("bigint").alias("id"), F.col("name").alias("extra")).alias("row")
    ), "merkle-parts")
    counts = nodes.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    roots = _whole(_extend([], nodes, counts)).select(
        F.col("row.extra").alias("part"), F.col("subroot").alias("root"), F.col("witness").alias("higher"))
    return leaves.join(roots, "part").select(
        F.expr("if(part = '0', null, substring(part, 2))").alias("part"), "pos", "row.id", "row.extra",
        F.col("digest").alias("leaf"), "subroot", "root", F.concat("witness", "higher").alias("witness"))


def fold(node: Column, witness: Column) -> Column:
    """The root that follows from a leaf and its witness."""
    return F.aggregate(witness, node, lambda acc, s: F.sha2(
        F.when(s["left"], F.concat(s["digest"], acc)).otherwise(F.concat(acc, s["digest"])), 256))


def proof(witness: Column) -> Column:
    """Digest of the siblings from leaf to root."""
    return F.sha2(F.array_join(F.transform(witness, lambda s: s["digest"]), ""), 256)

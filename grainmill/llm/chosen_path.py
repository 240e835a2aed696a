"""Near-duplicates by the chosen-path set similarity join.

A document is the set of its word shingles; minwise hashing turns it into SIGNATURE tokens. Each of TREES independent
trees sends a document down the paths of tokens its nodes select. A node of few documents compares all of them. A
larger one compares all with one member, its pivot: those that are surely alike are linked to it and need no more here,
and if only few are not, these are compared with the whole node. Otherwise the node branches again, or if its documents are so alike
that branching would not part them, it is a family: these are compared on the full sets, in blocks. Comparisons are
otherwise estimates from signatures; links are confirmed on the full sets, first a forest of them, then those between
the components that are left, so that a group of thousands of near copies costs a few comparisons for each of its
members. A family that links do not hold together is compared in full, all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from grainmill.llm import arrays as A
from grainmill.llm.common import ROWS_A_TASK, gathered, hidden
from grainmill.llm.components import components
from grainmill.session import stage, stage_counted

SHINGLE = 5
SIGNATURE = 128
TREES = 10
LEAF = 24  # documents a node may hold to be compared exhaustively
STEPS = (2, 4, 4, 2)  # tokens that the levels of a tree add to a path; one at first would let a common passage fill nodes
DENSE = 0.7  # mean estimate between a node and its pivot from which on branching would not part its documents
BLOCK = 1024  # documents of a family that are compared in one task
BLOCK_SHINGLES = 1 << 20  # and their shingles
HUBS = 16  # documents of a family, about, that are in each of its blocks, so that links hold blocks together
COLUMNS = 2048  # shingles multiplied at once
LIKELY = 0.6  # estimates below are no candidates: four standard errors under the threshold
CLEAR = 0.82  # estimates above are nearly always links
SURE = 0.9  # estimates above are links to a pivot, but for confirmation
SETS_A_TASK = 2000  # pairs whose full sets are worth a task
PAIRS_A_TASK = 64  # pairs of one document that are confirmed in one group

SIGNED = "id bigint, n bigint, key_a bigint, key_b bigint, tokens array<int>"


def shingle_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all shingles with repeats, first of each text and the total). Fewer words make one shingle."""
    words, first = A.word_hashes(texts, lower=True)
    counts = np.diff(first)
    h = A.windows(words, SHINGLE)
    keep = A.whole(first, SHINGLE)
    for i in np.flatnonzero((counts > 0) & (counts < SHINGLE)):
        at, n = int(first[i]), int(counts[i])
        h[at] = A.windows(words[at : at + n], n, A.BASE_B)[0]
        keep[at] = True
    sizes = np.where(counts >= SHINGLE, counts - SHINGLE + 1, (counts > 0).astype(np.int64))
    return h[keep], np.concatenate([[0], np.cumsum(sizes)])


def _sign(ident: str, text: str):
    rng = np.random.default_rng(11)
    scale = rng.integers(1, 1 << 63, SIGNATURE, dtype=np.uint64) | np.uint64(1)
    shift = rng.integers(1, 1 << 63, SIGNATURE, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in A.slices(batch, text):
                h, first = shingle_hashes(A.text_bytes(part.column(text)))
                full = np.flatnonzero(np.diff(first))
                tokens = np.zeros((part.num_rows, SIGNATURE), np.uint32)
                if len(full):
                    for k in range(SIGNATURE):
                        v = ((h * scale[k] + shift[k]) >> np.uint64(32)).astype(np.uint32)
                        tokens[full, k] = np.minimum.reduceat(v, first[full])
                n = np.zeros(part.num_rows, np.int64)
                keys = np.zeros((2, part.num_rows), np.uint64)
                for i in full:
                    u = np.unique(h[first[i] : first[i + 1]])
                    n[i] = len(u)
                    keys[0, i], keys[1, i] = A.mixed(u).sum(), A.mixed(u ^ A.BASE_A).sum()
                flat = pa.array(tokens.view(np.int32).ravel())
                offs = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * SIGNATURE)
                yield pa.RecordBatch.from_arrays(
                    [part.column(ident), pa.array(n), pa.array(keys[0].view(np.int64)), pa.array(keys[1].view(np.int64)),
                     pa.ListArray.from_arrays(offs, flat)], ["id", "n", "key_a", "key_b", "tokens"])

    return run


def alike(a: Column, b: Column) -> Column:
    """Share of equal signature tokens, an estimate of the Jaccard similarity."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.lit(float(SIGNATURE))


def _branches(node: Column, tokens: Column, steps: int) -> Column:
    """Child nodes of a document, ``steps`` tokens further down: the node's hash selects which tokens.

    A pair as similar as a link shares a step with probability 3/4, so a node has 4/3 children a step on average.
    """
    pick = lambda k: F.pmod(F.xxhash64(node, F.lit(k)), F.lit(SIGNATURE)).cast("int")
    path = lambda way: F.xxhash64(node, *[x for k in range(steps) for x in (pick(way * 8 + k), F.get(tokens, pick(way * 8 + k)))])
    whole, part = divmod((4 / 3) ** steps, 1)
    ways = [path(way) for way in range(int(whole))]
    one_more = F.pmod(F.xxhash64(node, F.lit(-3)), F.lit(1000)) < int(1000 * part)
    return F.when(one_more, F.array(*ways, path(int(whole)))).otherwise(F.array(*ways))


def _sketch(tokens: Column) -> Column:
    """One byte of each signature token."""
    return F.transform(tokens, lambda x: (x.bitwiseAND(255) - 128).cast("tinyint"))


def candidates(signed: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(a, b, est) with a < b: pairs that some tree brings together and whose signatures are alike; and families.

    ``signed`` is a stored table of id, tokens and bytes, their sketch. A large node whose members are alike on average
    does not get smaller by branching; nor does what the last level leaves. Their members (pivot, id) are returned, if
    any. A pivot has the smallest hash of its node in every tree, so that the nodes of one family mostly have one pivot
    and are compared once. Levels only place documents in nodes; small nodes of all levels are compared together.
    """
    roots = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))
    members = signed.select("id", "tokens", roots.alias("tree")).select(
        "id", F.explode(_branches(F.xxhash64("tree", F.lit(5)), F.col("tokens"), STEPS[0])).alias("node"))
    small, stars, few_nodes, dense_nodes, n_stars = [], [], [], [], 0
    for after in [*STEPS[1:], None]:
        members, n = stage_counted(members, "nodes")
        sizes = members.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min(
            F.struct(F.xxhash64("id").alias("h"), F.col("id").alias("id"))).alias("first"))
        sizes = sizes.where("size > 1").select("node", "size", F.col("first.id").alias("pivot"))
        placed = members.join(sizes, "node").join(signed.select("id", "bytes"), "id")
        placed, n = stage_counted(gathered(placed, n), "placed")
        small.append(placed.where(F.col("size") <= LEAF).select("node", "id", "bytes"))
        pivots = placed.where("id = pivot").select("node", F.col("bytes").alias("pivot_bytes"))
        star = placed.where(F.col("size") > LEAF).join(pivots, "node").withColumn(
            "est", alike(F.col("bytes"), F.col("pivot_bytes"))).drop("pivot_bytes")
        star, n = stage_counted(gathered(star, n), "stars")
        if not n:
            break
        nodes = star.groupBy("node").agg(F.count_if(F.col("est") < SURE).alias("open"), F.avg("est").alias("mean"))
        nodes = stage(gathered(nodes.where("open > 0"), n), "open-nodes")
        few, dense = F.col("open") <= LEAF, (F.col("mean") >= DENSE) if after else F.lit(True)
        stars.append(star)
        n_stars += n
        few_nodes.append(nodes.where(few).select("node"))
        dense_nodes.append(nodes.where(~few & dense).select("node"))
        if after:
            left = star.join(nodes.where(~few & ~dense).select("node"), "node", "left_semi").select("node", "id")
            members = gathered(left, n).join(signed.select("id", "tokens"), "id").select(
                "id", F.explode(_branches(F.col("node"), F.col("tokens"), after)).alias("node"))
    met, family = _within(_union(small)), None
    if stars:
        star = _union(stars)
        rest = star.where(F.col("est") < SURE).join(_union(few_nodes), "node", "left_semi")
        clear = _ordered(star.where(F.col("est") >= LIKELY), "id", "pivot", "est")
        met = met.unionByName(_across(rest, star)).unionByName(clear)
        dense = star.join(_union(dense_nodes), "node", "left_semi").select("pivot", "id").distinct()
        family, n = stage_counted(gathered(dense, n_stars), "families")
        family = family if n else None
    return met.groupBy("a", "b").agg(F.max("est").alias("est")), family


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out


def _ordered(df: DataFrame, a: str, b: str, *more: str) -> DataFrame:
    return df.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), *more)


def _across(left: DataFrame, right: DataFrame) -> DataFrame:
    """Estimated pairs of different documents that share a node; signatures come with the documents, not the pairs."""
    y = right.select("node", F.col("id").alias("b"), F.col("bytes").alias("y"))
    met = left.select("node", F.col("id").alias("a"), F.col("bytes").alias("x")).join(y, "node")
    est = alike(F.col("x"), F.col("y")).alias("est")
    return _ordered(met.where("a <> b").select("a", "b", est).where(F.col("est") >= LIKELY), "a", "b", "est")


def _within(small: DataFrame) -> DataFrame:
    y = small.select("node", F.col("id").alias("b"), F.col("bytes").alias("y"))
    met = small.select("node", F.col("id").alias("a"), F.col("bytes").alias("x")).join(y, "node").where("a < b")
    return met.select("a", "b", alike(F.col("x"), F.col("y")).alias("est")).where(F.col("est") >= LIKELY)


def _sets(ident: str, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in A.slices(batch, text):
                h, first = shingle_hashes(A.text_bytes(part.column(text)))
                sets = [np.unique(h[first[i] : first[i + 1]]).tobytes() for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column(ident), pa.array(sets, pa.binary())], ["id", "shingles"])

    return run


def _confirm(percent: int):
    def run(key: tuple, pairs: pa.Table, hubs: pa.Table) -> pa.Table:
        hub_sets = [np.frombuffer(x, np.uint64) for x in hubs.column("shingles_at").to_pylist()]
        good = []
        for other, data in zip(pairs.column("other").to_pylist(), pairs.column("shingles").to_pylist()):
            s = np.frombuffer(data, np.uint64)
            for hub in hub_sets:
                both = len(np.intersect1d(hub, s, assume_unique=True))
                if 100 * both >= percent * (len(hub) + len(s) - both):
                    good.append(other)
                    break
        return pa.table({"a": pa.array([key[0].as_py()] * len(good), pa.int64()), "b": pa.array(good, pa.int64())})

    return run


def confirmed(pairs: DataFrame, n: int, sets: DataFrame, percent: int) -> DataFrame:
    """Those of at most ``n`` pairs (a, b) whose full sets are similar. Each pair is checked where the set of its busier document lies."""
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    busy = ends.groupBy("id").agg(F.count(F.lit(1)).alias("deg"))
    both = pairs.join(busy.select(F.col("id").alias("a"), F.col("deg").alias("deg_a")), "a").join(
        busy.select(F.col("id").alias("b"), F.col("deg").alias("deg_b")), "b")
    left = F.col("deg_a") >= F.col("deg_b")
    hubbed = both.select(
        F.when(left, F.col("a")).otherwise(F.col("b")).alias("hub"),
        F.when(left, F.col("b")).otherwise(F.col("a")).alias("other"), F.greatest("deg_a", "deg_b").alias("deg"),
    ).withColumn("slot", F.pmod(F.xxhash64("other"), F.ceil(F.col("deg") / PAIRS_A_TASK)).cast("int")).drop("deg")
    hubbed, n = stage_counted(gathered(hubbed, n), "pairs")
    asked = hubbed.join(sets.withColumnRenamed("id", "other"), "other")
    hubs = hubbed.select(F.col("hub").alias("at"), F.col("slot").alias("part")).distinct()
    hubs = hubs.join(sets.select(F.col("id").alias("at"), F.col("shingles").alias("shingles_at")), "at")
    good = asked.groupBy("hub", "slot").cogroup(hubs.groupBy("at", "part")).applyInArrow(
        _confirm(percent), "a bigint, b bigint")
    return gathered(good, n * (ROWS_A_TASK // SETS_A_TASK))


def _linked(left: list[np.ndarray], right: list[np.ndarray], same: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of a left and a right set are similar or ``same``: the sets as rows of 0 and 1, multiplied."""
    none = np.zeros(0, np.uint64)
    a, b = np.concatenate([none, *left]), np.concatenate([none, *right])
    apart = np.concatenate([a, *[x for x, twice in zip(right, same.any(axis=0)) if not twice]])
    values, times = np.unique(apart, return_counts=True)
    shared = np.intersect1d(np.intersect1d(a, b), values[times > 1], assume_unique=True)

    def entries(sets: list[np.ndarray], flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        cols = np.searchsorted(shared, flat)
        hit = cols < len(shared)
        hit[hit] = shared[cols[hit]] == flat[hit]
        order = np.argsort(cols[hit], kind="stable")
        return rows[hit][order], cols[hit][order]

    (rows_a, cols_a), (rows_b, cols_b) = entries(left, a), entries(right, b)
    both = np.zeros((len(left), len(right)))
    for c in range(0, len(shared), COLUMNS):
        x, y = np.zeros((len(left), COLUMNS), np.float32), np.zeros((len(right), COLUMNS), np.float32)
        for m, rows, cols in ((x, rows_a, cols_a), (y, rows_b, cols_b)):
            lo, hi = np.searchsorted(cols, [c, c + COLUMNS])
            m[rows[lo:hi], cols[lo:hi] - c] = 1
        both += x @ y.T
    sizes = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :]
    return (100 * both >= percent * (sizes - both)) | same


def _forest(met: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (left, right) of ``met`` that hold together whatever all of its pairs do."""
    free, out = (np.ones(met.shape[0], bool), np.ones(met.shape[1], bool)), []
    for start in range(met.shape[0]):
        if not free[0][start]:
            continue
        free[0][start] = False
        todo = [(0, start)]
        while todo:
            side, at = todo.pop()
            new = np.flatnonzero((met[:, at] if side else met[at]) & free[1 - side])
            free[1 - side][new] = False
            out.extend((int(k), at) if side else (at, int(k)) for k in new)
            todo.extend((1 - side, int(k)) for k in new)
    return out


def _compare(left: pa.Table, right: pa.Table, percent: int) -> pa.Table:
    ids = [np.array(t.column("id").to_pylist(), np.int64) for t in (left, right)]
    sets = [[np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()] for t in (left, right)]
    edges = _forest(_linked(*sets, ids[0][:, None] == ids[1][None, :], percent))
    pairs = [(int(ids[0][i]), int(ids[1][j])) for i, j in edges if ids[0][i] != ids[1][j]]
    return pa.table({k: pa.array([p[at] for p in pairs], pa.int64()) for at, k in enumerate("ab")})


def _sized(rows: DataFrame, name: str) -> DataFrame:
    """Members and number of blocks of each family of (pivot, id, n)."""
    n = F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)
    return rows.groupBy("pivot").agg(F.count(F.lit(1)).alias("size"), F.ceil(n).cast("int").alias(name))


def _in_blocks(family: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that hold together what is linked within one block of a family, or over its hubs."""
    hub = (F.col("id") == F.col("pivot")) | (F.pmod(F.xxhash64("id", F.lit(3)), F.col("size")) < HUBS)
    own = F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).cast("int")
    placed = family.join(_sized(family, "blocks"), "pivot").select("pivot", "id", F.explode(
        F.when(hub, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))).alias("block"))
    return placed.join(sets, "id").groupBy("pivot", "block").applyInArrow(
        lambda t: _compare(t, t, percent), "a bigint, b bigint")


def _strangers(family: DataFrame, n: int, parts: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of those outside the largest component of a family with all its members, each block with each."""
    of = family.join(parts, family["id"] == parts["node"], "left").select(
        "pivot", "id", "n", F.coalesce("component", "id").alias("part"))
    of = stage(gathered(of, n), "family-parts")
    most = of.groupBy("pivot", "part").agg(F.count(F.lit(1)).alias("k")).groupBy("pivot").agg(
        F.max(F.struct("k", "part")).alias("most"))
    out = of.join(most, "pivot").where(F.col("part") != F.col("most.part")).select("pivot", "id", "n")
    out, n_out = stage_counted(gathered(out, n), "strangers")
    if not n_out:
        return out.select(F.col("id").alias("a"), F.col("id").alias("b"))
    grid = _sized(out, "rows").drop("size").join(_sized(family, "cols").drop("size"), "pivot")
    spread = lambda over: F.explode(F.sequence(F.lit(0), F.col(over) - 1))
    own = lambda over: F.pmod(F.xxhash64("id", F.lit(7)), F.col(over)).cast("int")
    x = out.join(grid, "pivot").select("pivot", "id", own("rows").alias("row"), spread("cols").alias("col"))
    y = family.join(grid, "pivot").select("pivot", "id", spread("rows").alias("row"), own("cols").alias("col"))
    x, y = gathered(x, n_out * (1 + n // BLOCK)), gathered(y, n * (1 + n_out // BLOCK))
    y = stage(y, "grid").join(sets, "id").select(*[F.col(c).alias(f"{c}_at") for c in ("pivot", "row", "col", "id", "shingles")])
    return stage(x, "grid").join(sets, "id").groupBy("pivot", "row", "col").cogroup(
        y.groupBy("pivot_at", "row_at", "col_at")).applyInArrow(
            lambda a, b: _compare(a, b.rename_columns([c.removesuffix("_at") for c in b.column_names]), percent),
            "a bigint, b bigint")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Two documents are linked if the Jaccard similarity of their shingle sets is ``percent`` or more; component_id is
    the smallest identifier that links reach, and kept says whether it is the row's own. Identifiers are integers.
    Documents without words, NULL text among them, and rows without identifier are linked with nothing; the latter
    have component_id NULL and are kept. Rows that share an identifier count as one document. An empty table gives no
    rows. Other columns of ``docs`` are not read.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    signed, n_rows = stage_counted(texts.mapInArrow(_sign("id", "text"), SIGNED), "signatures")
    alive = signed.where("n > 0 and id is not null")
    classes = alive.groupBy("key_a", "key_b", "n").agg(F.min("id").alias("class"))
    classed = alive.select("id", "key_a", "key_b", "n").join(classes, ["key_a", "key_b", "n"]).select("id", "class")
    classed = stage(gathered(classed, n_rows), "classes")
    lead = alive.join(classed.where("id = class").select("id").distinct(), "id", "left_semi").select(
        "id", "n", "tokens", _sketch(F.col("tokens")).alias("bytes"))

    lead = stage(gathered(lead, n_rows), "leaders")
    pairs, family = candidates(lead)
    pairs, n_pairs = stage_counted(pairs, "candidates")
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    ends = (ends.unionByName(family.select("id")) if family else ends).distinct()
    # The list of documents grows with the corpus, so it is not broadcast at any size.
    sets = stage(texts.join(ends.hint("merge"), "id", "left_semi").mapInArrow(_sets("id", "text"), "id bigint, shingles binary"), "sets")

    # A forest: each document with its smallest partner among those that are clearly alike, or else with the likeliest.
    each = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "est"))
    best = each.groupBy("a").agg(F.max(F.struct(F.least("est", F.lit(CLEAR)).alias("e"), (-F.col("b")).alias("b"))).alias("best"))
    forest = _ordered(best.select("a", (-F.col("best.b")).alias("b")), "a", "b").distinct()
    forest, n_forest = stage_counted(gathered(forest, n_pairs), "forest")
    links = confirmed(forest, n_forest, sets, percent)
    if family:
        sizes = lead.groupBy("id").agg(F.max("n").alias("n"))
        n_family = family.count()
        family = stage(gathered(family.join(sizes, "id").select("pivot", "id", "n"), n_family), "families")
        links = links.unionByName(gathered(_in_blocks(family, sets, percent), n_family * (ROWS_A_TASK // SETS_A_TASK)))
    links, n_links = stage_counted(links, "links")
    parts = components(links, n_links)
    of = lambda end: parts.select(F.col("node").alias(end), F.col("component").alias(f"part_{end}"))
    apart = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where(
        F.coalesce("part_a", "a") != F.coalesce("part_b", "b")
    ).select("a", "b").join(forest, ["a", "b"], "left_anti")
    more = confirmed(apart, n_pairs, sets, percent)
    if family:
        more = more.unionByName(_strangers(family, n_family, parts, sets, percent))
    more, n_more = stage_counted(more, "links")

    lead_of = classed.groupBy("id").agg(F.min("class").alias("lead"))
    shared = classed.join(lead_of, "id").select(F.col("class").alias("a"), F.col("lead").alias("b")).where("a <> b")
    linked = components(links.unionByName(more).unionByName(shared), n_links + n_more + n_rows)
    whole = lead_of.join(linked.withColumnRenamed("node", "lead"), "lead", "left").select(
        F.col("id").alias("of"), F.coalesce("component", "lead").alias("component"))
    out = signed.select("id", "n").join(whole, F.col("id") == F.col("of"), "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
        component.eqNullSafe(F.col("id")).alias("kept"),
    )


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: those whose identifier is their component's, and those without one.

    Of rows that share an identifier one stays, that with the smallest hash of its text.
    """
    mine, turn = hidden(docs, "id", "turn")
    stays = near_groups(docs, id_col, text_col, percent).where("kept").select(F.col(id_col).alias("stays")).distinct()
    keyed = docs.where(F.col(id_col).isNotNull()).withColumn(mine, F.col(id_col).cast("bigint"))
    met = keyed.join(stays, keyed[mine] == stays["stays"], "left_semi")
    first = Window.partitionBy(mine).orderBy(F.xxhash64(text_col))
    one = met.withColumn(turn, F.row_number().over(first)).where(F.col(turn) == 1).drop(mine, turn)
    return one.unionByName(docs.where(F.col(id_col).isNull()))

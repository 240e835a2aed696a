"""Line deduplication with a segment-partition edit join.

Equal lines are one line with its first place. A line is cut into EDITS + 1 segments; if two lines are at most EDITS
edits apart, one segment of the one occurs in the other near the same place. Lines meet under the contents of their
segments and a class of lengths. Keys under which many lines are indexed are not paired: their lines are cut again,
without the shared segment, under the key they share and by exact lengths, and pairs whose sketches are too far apart
are left out. Where that leaves many lines together they are compared with the earliest of them, and those that are
close to one are late and leave, so that a group of near lines costs a few comparisons for each. Candidates are verified
by a banded bit-parallel edit distance.

What is shuffled once is the text by document; the rows under keys are two numbers each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from grainmill.llm.common import shuffle_partitions
from grainmill.session import stage, stage_counted

EDITS = 2
MIN_CHARS = 24  # shorter lines are compared for equality only; a multiple of NARROW_CLASS
WIDE = 128  # from so many characters on, classes of lengths are wide
NARROW_CLASS, WIDE_CLASS = 8, 64  # lengths a class holds; more than EDITS
COMMON = 10_000  # a line with a share of 1 / COMMON of all lines is common; there are at most so many
CROWDED_BITS = 26  # of 64 that lines under a key set; some 33 lines, from which on the key is refined
CROWDED = 32  # the same for refined keys, which are counted
LEVELS = 3  # refinements of crowded keys
PIVOTS = 4  # earliest lines under a key that all others are compared with first; then twice as many
MOST_PIVOTS = 1024
BAND = 2 * EDITS + 1


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# ---- segments --------------------------------------------------------------------------------------------------

def _moves() -> list[tuple[int, int, int, bool]]:
    """(characters the other line is shorter, segment, move, indexed) of all keys of a line.

    With ``i`` segments before it that all hold an edit, a segment moves by at most ``i`` places, and the same counts
    from the end; so nine substrings, besides the line's own segments, are enough for two edits.
    """
    own = [(0, i, 0, True) for i in range(EDITS + 1)]
    return own + [
        (less, i, move, False)
        for less in range(EDITS + 1) for i in range(EDITS + 1)
        for move in range(max(-i, less - EDITS + i), min(i, less + EDITS - i) + 1)
        if less or move  # an unmoved segment of a line as long is an index key, and the index meets itself
    ]


def _each(lines: DataFrame, moves: list[tuple[int, int, int, bool]]) -> DataFrame:
    """``lines`` once for each move, as d, i, m, x: rows, because functions over arrays are not compiled."""
    given = F.array(*[
        F.struct(F.lit(d).alias("d"), F.lit(i).alias("i"), F.lit(m).alias("m"), F.lit(x).alias("x")) for d, i, m, x in moves
    ])
    return lines.select("*", F.explode(given).alias("t")).select(*lines.columns, "t.*")


def _without_part(rest: bool) -> list[Column]:
    """With ``rest``, the line without the substring at start, as rest."""
    line, start, size = F.col("line"), F.col("start"), F.col("size")
    cut = F.concat(line.substr(F.lit(1), start - 1), line.substr(start + size, F.length(line)))
    return [cut.alias("rest")] if rest else []


def _keys(lines: DataFrame, rest: bool = False) -> DataFrame:
    """key, indexed and the columns of ``lines`` (base, line, chars, others), with ``rest`` also rest: all keys under a base.

    A line of n characters is cut into EDITS + 1 segments, of which the last ones are longer by one. Keys hold the
    length of the shorter line.
    """
    length = F.col("chars") - F.col("d")
    least = F.call_function("div", length, F.lit(EDITS + 1)).cast("int")
    short = F.col("least") * (EDITS + 1) + (EDITS + 1) - length
    cut = _each(lines, _moves()).withColumn("least", least).withColumn("short", short)
    start = F.col("least") * F.col("i") + F.greatest(F.col("i") - F.col("short"), F.lit(0)) + 1 + F.col("m")
    size = F.col("least") + F.when(F.col("i") >= F.col("short"), 1).otherwise(0)
    cut = cut.withColumn("start", start).withColumn("size", size).where(
        F.col("x") | ((length >= EDITS + 1) & (F.col("start") >= 1)))
    key = F.xxhash64("base", length, "i", F.col("line").substr(F.col("start"), F.col("size")))
    return cut.select(*lines.columns, key.alias("key"), F.col("x").alias("indexed"), *_without_part(rest))


def _wide_keys(lines: DataFrame, rest: bool = False) -> DataFrame:
    """The same of whole lines, without a base and under fewer keys: these hold a class of lengths instead of a length.

    All segments of a class are as long as its least length allows. The last one is counted from the end and does not
    move, the ones before it from the beginning, and the i-th moves by at most i places. A line that is longer than its
    class's least length by less than EDITS also meets the class before.
    """
    moves = [(d, i, m, m == 0) for d in (0, EDITS) for i in range(EDITS + 1) for m in ([0] if i == EDITS else range(-i, i + 1))]
    chars = F.col("chars")
    of = lambda n: n - F.when(n < WIDE, F.pmod(n, F.lit(NARROW_CLASS))).otherwise(F.pmod(n, F.lit(WIDE_CLASS)))
    cut = _each(lines, moves).withColumn("class", of(chars - F.col("d")))
    cut = cut.where((F.col("d") == 0) | (F.col("class") != of(chars))).where(F.col("class") >= MIN_CHARS)
    cut = cut.withColumn("size", F.call_function("div", F.col("class"), F.lit(EDITS + 1)).cast("int"))
    start = F.when(F.col("i") == EDITS, chars - F.col("size")).otherwise(F.col("size") * F.col("i") + F.col("m")) + 1
    cut = cut.withColumn("start", start)
    key = F.xxhash64("class", "i", F.col("line").substr(F.col("start"), F.col("size")))
    return cut.select(*lines.columns, key.alias("key"), F.col("x").alias("indexed"), *_without_part(rest))


def _met(keys: DataFrame, partitions: int) -> DataFrame:
    """Pairs of an indexed line and another under the same key, less those whose lengths or sketches, if given, differ too much.

    All rows of a key are dealt to one partition, once.
    """
    more = [c for c in ("chars", "sketch") if c in keys.columns]
    once = keys.repartition(partitions, "key").groupBy("key", "line_id").agg(
        F.max("indexed").alias("indexed"), *[F.min(c).alias(c) for c in more])
    left = once.where("indexed").select("key", F.col("line_id").alias("x"), *[F.col(c).alias(f"{c}_x") for c in more])
    met = left.join(once.select("key", F.col("line_id").alias("y"), F.col("indexed").alias("both"), *more), "key")
    if more:
        met = met.where(F.abs(F.col("chars") - F.col("chars_x")) <= EDITS).where(
            _near(F.col("sketch"), F.col("sketch_x")))
    return met.where("x < y or (x > y and not both)").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _sketch(line: Column) -> Column:
    """For 64 kinds of pairs of neighbouring characters whether their number is odd. An edit changes at most four of the bits."""
    one = lambda a, b: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(a, b), F.lit(64)).cast("int"))
    return _let(_chars(line), lambda c: F.aggregate(
        F.sequence(F.lit(0), F.size(c)), F.lit(0).cast("bigint"),
        lambda acc, k: acc.bitwiseXOR(one(F.get(c, k - 1), F.get(c, k)))))


def _near(a: Column, b: Column) -> Column:
    """Whether sketches are as near as those of lines at most EDITS edits apart always are."""
    return F.bit_count(a.bitwiseXOR(b)) <= 4 * EDITS


def shared_keys(lines: DataFrame, partitions: int) -> DataFrame:
    """(key, line_id, indexed, crowded) of keys that several lines have; crowded says whether many lines are indexed under it.

    Lines are told apart by six bits of their identifiers, one bit of a number for each; copies of a line count once.
    """
    keys = _wide_keys(lines).select("key", "line_id", "indexed").repartition(partitions, "key")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("line_id", F.lit(64)).cast("int"))
    counted = keys.groupBy("key").agg(
        F.min("line_id").alias("least"), F.max("line_id").alias("most"), F.bit_or(F.when(F.col("indexed"), bit)).alias("seen"))
    shared = counted.where("least < most and seen is not null").select(
        "key", (F.bit_count("seen") >= CROWDED_BITS).alias("crowded"))
    return stage(keys.join(shared.hint("shuffle_hash"), "key"), "shared-keys")


def crowded_keys(lines: DataFrame, shared: DataFrame | None = None) -> tuple[DataFrame, int]:
    """Keys under which many lines are indexed, and how many keys these are. ``shared``: :func:`shared_keys`, if known."""
    shared = shared_keys(lines, shuffle_partitions(lines.sparkSession)) if shared is None else shared
    return stage_counted(shared.where("crowded").select("key").distinct(), "crowded")


def crowded_pairs(lines: DataFrame, crowded: DataFrame, partitions: int) -> tuple[list[DataFrame], DataFrame | None]:
    """Pairs of lines that share a crowded key and, with it, a key of what is left of them.

    Lines under keys that are crowded at the last level, too, are not paired: they are returned as (key, line_id, sketch), if any.
    """
    found = []
    whole = ["line_id", "n_chars", "sketch"]  # of the whole line, at all levels
    lines = stage(lines.select(
        "line_id", "line", "chars", F.col("chars").alias("n_chars"), _sketch(F.col("line")).alias("sketch")), "crowd-lines")
    rows = _wide_keys(lines, True).join(crowded, "key", "left_semi")
    for _ in range(LEVELS):
        left = stage(rows.select(
            *whole, F.col("key").alias("base"), F.col("rest").alias("line"), F.length("rest").alias("chars")).distinct(), "shared")
        rows = stage(_keys(left).select("key", "indexed", "line_id", F.col("n_chars").alias("chars"), "sketch"), "refined")
        counts = rows.where("indexed").groupBy("key").agg(F.countDistinct("line_id").alias("n"))
        crowded, n = stage_counted(counts.where(F.col("n") > CROWDED).select("key"), "crowded")
        found.append(stage(_met(rows.join(crowded, "key", "left_anti") if n else rows, partitions).distinct(), "pairs"))
        if not n:
            return found, None
        rows = _keys(left, True).join(crowded, "key", "left_semi")
    return found, stage(rows.select("key", "line_id", "sketch").distinct(), "crowds")


def late_in_crowds(crowds: DataFrame, lines: DataFrame, places: DataFrame) -> list[DataFrame]:
    """(first) of the lines of ``crowds`` that are close to an earlier one under the same key.

    Lines are compared with the earliest under their keys, then with the next ones; a line that is late is compared no
    more, but others are with it. ``lines`` has their texts, ``places`` (line_id, first).
    """
    ids = crowds.select("line_id").distinct()
    texts = stage(lines.join(ids, "line_id", "left_semi").groupBy("line_id").agg(F.min("line").alias("line")), "crowd-texts")
    rank = F.row_number().over(Window.partitionBy("key").orderBy("first", "line_id"))
    todo = ranked = stage(crowds.join(places, "line_id").withColumn("rank", rank), "crowd-places")
    other = texts.select(F.col("line_id").alias("x"), F.col("line").alias("line_x"))
    found, done, step = [], 0, PIVOTS
    while (todo.agg(F.max("rank")).first()[0] or 0) > max(done, 1):
        pivots = ranked.where(F.col("rank").between(done + 1, done + step)).groupBy("key").agg(
            F.collect_list(F.struct(F.col("first").alias("at"), F.col("line_id").alias("x"), "sketch")).alias("pivots"))
        asked = todo.where(F.col("rank") > done + 1).join(pivots, "key").groupBy("line_id", "first", "sketch").agg(
            F.array_distinct(F.flatten(F.collect_set("pivots"))).alias("pivots"))
        met = asked.select("line_id", "first", "sketch", F.explode("pivots").alias("p")).where(
            F.col("p.at") < F.col("first")).where(_near(F.col("sketch"), F.col("p.sketch"))).select("line_id", "first", "p.x")
        close = met.join(texts, "line_id").join(other, "x").where(
            F.abs(F.length("line") - F.length("line_x")) <= EDITS).where(banded_distance(F.col("line"), F.col("line_x")) <= EDITS)
        late = stage(close.select("line_id", "first").distinct(), "late")
        found.append(late.select("first"))
        done, step = done + step, min(2 * step, MOST_PIVOTS)
        left = todo.where(F.col("rank") > done).join(late.select("line_id", "first"), ["line_id", "first"], "left_anti")
        todo = stage(left, "crowd-places")
    return found


# ---- edit distance ---------------------------------------------------------------------------------------------

def banded_distance(a: Column, b: Column) -> Column:
    """Edit distance of two strings whose lengths differ by at most EDITS; right where it is at most EDITS.

    Common beginnings and ends are cut off first. The sum follows the diagonal on which the last cell lies.
    """
    longer = F.when(F.length(a) >= F.length(b), F.struct(a.alias("p"), b.alias("t"))).otherwise(
        F.struct(b.alias("p"), a.alias("t")))
    mask = (1 << BAND) - 1
    bits = 2 * BAND

    def run(box: Column) -> Column:
        p, t, m, n = box["p"], box["t"], F.size(box["p"]), F.size(box["t"])
        ahead = m - n
        # Packed: distance so far, VP and VN. Bit k stands for the row k - EDITS from the diagonal; the band moves
        # down by one row a column. At first VP holds the rows below the first.
        start = F.lit((((1 << BAND) - (1 << EDITS)) << BAND)).cast("int")

        def column(acc: Column, j: Column) -> Column:
            c, eq = F.get(t, j), None
            for k in range(BAND):
                bit = F.when(F.get(p, j - EDITS + k) == c, 1 << k).otherwise(0)
                eq = bit if eq is None else eq + bit
            vp, vn = F.shiftright(acc, BAND).bitwiseAND(mask), acc.bitwiseAND(mask)

            def carried(x: Column) -> Column:
                sum_ = (x.bitwiseAND(vp) + vp).bitwiseXOR(vp)
                return _let(sum_.bitwiseOR(x).bitwiseAND(mask), moved)

            def moved(d0: Column) -> Column:
                hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp)))
                down = F.shiftright(d0, 1)
                new_vp = d0.bitwiseAND(vp).bitwiseOR(F.bitwise_not(down.bitwiseOR(hp))).bitwiseAND(mask)
                new_vn = down.bitwiseAND(hp).bitwiseAND(mask)
                far = F.shiftright(acc, bits) + 1 - F.call_function("shiftright", d0, ahead + EDITS).bitwiseAND(1)
                return F.shiftleft(far, bits) + F.shiftleft(new_vp, BAND) + new_vn

            # The sum never falls along the diagonal: past EDITS the rest of the columns cannot matter.
            done = F.shiftright(acc, bits) + ahead > EDITS
            return F.when(done, acc).otherwise(_let(eq.bitwiseOR(vn), carried).cast("int"))

        total = F.aggregate(F.sequence(F.lit(0), n - 1), start, column)
        return F.when(n == 0, m).otherwise(F.shiftright(total, bits) + ahead)

    def middle(box: Column) -> Column:
        p, t = box["p"], box["t"]
        room = F.length(t)
        head = _common(lambda k, size: p.substr(k + 1, size) == t.substr(k + 1, size), room)

        def cut(h: Column) -> Column:
            lp, lt = F.length(p), F.length(t)
            tail = _common(lambda k, size: p.substr(lp - k - size + 1, size) == t.substr(lt - k - size + 1, size), room - h)
            return _let(tail, lambda e: _let(
                F.struct(_chars(p.substr(h + 1, lp - h - e)).alias("p"), _chars(t.substr(h + 1, lt - h - e)).alias("t")), run))

        return _let(head, cut)

    return _let(longer, middle)


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, "", -1), lambda c: c != "")


def _common(same, room: Column) -> Column:
    """Longest run for which ``same(done, more)`` holds, by halving steps; at most ``room``."""
    steps = F.lit([1 << k for k in range(24, -1, -1)])
    return F.aggregate(
        steps, F.lit(0), lambda k, size: F.when((k + size <= room) & same(k, size), k + size).otherwise(k).cast("int")
    )


# ---- the operator ----------------------------------------------------------------------------------------------

def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with the text less the removed lines, plus n_lines and n_removed.

    Lines are cut at line feeds. A line with a word is removed if an equal line, or one at most EDITS edits away and
    both of MIN_CHARS characters or more, has an earlier place: in a document of smaller identifier (NULL last), or
    further up in the same. The input decides, not what is left. Lines without words stay. Rows of equal identifier
    and text count as one place and lose the same lines; rows of equal identifier and other text are ordered by a hash
    of the text. NULL text stays NULL, with no lines. An empty table gives no rows. Columns of ``docs`` named n_lines
    or n_removed are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_removed")
    names = docs.columns
    place = F.struct(
        F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"))
    others = [c for c in names if c not in (id_col, text_col)]
    # The identifier travels in the place, so that without other columns one shuffle of the text serves all readers.
    source = docs.select(
        place.alias("place"), F.col(text_col).alias("text"), *([F.struct(*others).alias("rest")] if others else []))
    # Places read back from the shared folder have nullable fields. With others here joins would cast them, and Spark
    # shuffle the text once more.
    same = T.StructType([T.StructField(f.name, f.dataType) for f in source.schema["place"].dataType])
    source = source.withColumn("place", F.col("place").cast(same))
    text = F.col("text")
    with_word = F.length(F.btrim(F.col("line"), F.lit(" \t\n\x0b\x0c\r"))) > 0
    every = source.select("place", F.posexplode(F.split(text, "\n", -1)).alias("pos", "line")).where(with_word)
    keyed = every.select(
        "place", "pos", F.xxhash64("line").alias("line_id"), F.xxhash64("line", F.lit(1)).alias("check"),
        F.length("line").alias("chars"))

    # Distinct lines: first place and number of occurrences.
    first = stage(keyed.groupBy("line_id", "check").agg(
        F.min(F.struct("place", "pos")).alias("first"), F.count(F.lit(1)).alias("n"), F.max("chars").alias("chars")), "lines")

    by_place = source.repartition(shuffle_partitions(spark), "place")

    def text_of(lines: DataFrame) -> DataFrame:
        """(line_id, line, first) of lines given by line_id and first, fetched from their documents."""
        wanted = lines.groupBy(F.col("first.place").alias("place")).agg(
            F.collect_list(F.struct("line_id", F.col("first.pos").alias("pos"))).alias("wanted"))
        met = by_place.join(wanted, "place").select("place", "wanted", F.split(text, "\n", -1).alias("all"))
        got = F.transform("wanted", lambda w: F.struct(
            w["line_id"].alias("line_id"), w["pos"].alias("pos"), F.get(F.col("all"), w["pos"]).alias("line")))
        return met.select("place", F.inline(got)).select(
            "line_id", "line", F.struct("place", "pos").alias("first"))

    long_lines = first.where(F.col("chars") >= MIN_CHARS).select("line_id", "first")
    # Copies of a common line would crowd its keys, so all but the first leave; the others are few enough to stay.
    total = first.agg(F.sum("n")).first()[0] or 0
    common = first.where(F.col("n") > max(1, total // COMMON)).select(F.col("line_id").alias("common"), "first")
    compared = every.select(
        F.xxhash64("line").alias("line_id"), "line", F.length("line").alias("chars"), F.struct("place", "pos").alias("at")
    ).where(F.col("chars") >= MIN_CHARS).join(F.broadcast(common), F.col("line_id") == F.col("common"), "left").where(
        F.col("common").isNull() | (F.col("at") == F.col("first"))
    ).select("line_id", "line", "chars")
    partitions = shuffle_partitions(spark)
    shared = shared_keys(compared, partitions)
    crowded, n_crowded = crowded_keys(compared, shared)
    pairs, found, crowds = _met(shared.where("not crowded"), partitions), [], None
    if n_crowded:
        ids = stage(shared.where("crowded").select("line_id").distinct(), "crowded-ids")  # its size is known: few are broadcast
        in_crowds = stage(compared.join(ids, "line_id", "left_semi").groupBy("line_id").agg(
            F.min("line").alias("line"), F.min("chars").alias("chars")), "crowded-lines")
        found, crowds = crowded_pairs(in_crowds, crowded, partitions)
    for more in found:
        pairs = pairs.unionByName(more)
    pairs = stage(pairs.distinct(), "pairs")
    ends = pairs.select(F.col("a").alias("line_id")).unionByName(pairs.select(F.col("b").alias("line_id"))).distinct()
    texts = text_of(long_lines.join(ends, "line_id", "left_semi"))
    side = lambda end: texts.select(
        F.col("line_id").alias(end), F.col("line").alias(f"line_{end}"), F.col("first").alias(f"first_{end}"))
    close = pairs.join(side("a"), "a").join(side("b"), "b").where(
        F.abs(F.length("line_a") - F.length("line_b")) <= EDITS
    ).where(banded_distance(F.col("line_a"), F.col("line_b")) <= EDITS)
    late = close.select(F.greatest("first_a", "first_b").alias("first"))
    for more in late_in_crowds(crowds, in_crowds, long_lines) if crowds else []:
        late = late.unionByName(more)
    late = late.distinct().withColumn("late", F.lit(True))

    doomed = first.join(late, "first", "left").where("late or n > 1").select(
        "line_id", "check", "first", F.coalesce("late", F.lit(False)).alias("late"))
    gone = keyed.select("place", "pos", "line_id", "check").join(doomed, ["line_id", "check"]).where(
        F.col("late") | (F.struct("place", "pos") != F.col("first")))
    removed = gone.groupBy("place").agg(F.sort_array(F.collect_set("pos")).alias("removed"))
    parts = F.split(text, "\n", -1)
    joined = by_place.join(removed, "place", "left")
    none = F.array().cast("array<int>")
    new_text = F.when(F.col("removed").isNull(), text).otherwise(
        _let(F.struct(parts.alias("l"), F.col("removed").alias("r")), lambda x: F.array_join(_without(x["l"], x["r"]), "\n")))
    own = {text_col: new_text, id_col: F.col("place.id")}
    return joined.select(
        *[own[c].alias(c) if c in own else F.col(f"rest.`{c}`").alias(c) for c in names],
        F.coalesce(F.size(parts), F.lit(0)).cast("bigint").alias("n_lines"),
        F.size(F.coalesce("removed", none)).cast("bigint").alias("n_removed"),
    )


def _without(lines: Column, removed: Column) -> Column:
    """``lines`` less those at the ascending places ``removed``."""
    at = lambda j: F.coalesce(F.get(removed, j), F.size(lines))
    before = lambda j: F.when(j == 0, F.lit(-1)).otherwise(F.get(removed, j - 1))
    runs = F.transform(
        F.sequence(F.lit(0), F.size(removed)), lambda j: F.slice(lines, before(j) + 2, at(j) - before(j) - 1))
    return F.flatten(runs)

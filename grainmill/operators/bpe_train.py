"""Training a byte-level BPE vocabulary as Spark jobs.

The corpus is read once, for pre-token counts. From then on words lie in blocks, rows of a table: the symbol ids of some
hundred thousand words one after the other, and their counts. A block is merged and counted as numpy arrays, and only the
words that hold a merged pair are touched. Words stay in Spark at any size. All pairs are counted once; after that a
round, one job, applies the merges that are certain, and tries a batch of guesses on top of them: it returns by how much
each guess in turn changes the count of each pair. With these the driver, which keeps one count for each pair of symbols,
which the vocabulary bounds, plays the batch again: as long as the most frequent pair is among the guesses it is taken,
out of turn if it has no symbol in common with those before it, whose changes and its own are then put right exactly. So
the merges are those that one at a time would also find. The guesses come from the most frequent words, at most HEAD of
them, which the driver holds; they decide nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from grainmill.constants import MIN_FREQUENCY, VOCAB_SIZE
from grainmill.functions.text import pretokens
from grainmill.operators.vocabulary import BYTE_IDS, N_SPECIAL, Vocabulary
from grainmill.session import stage, stage_counted

HEAD = 200_000  # words from which guesses are made
HEAD_BYTES = 64  # of such a word, at most
GUESSES = 512  # in a round, at most
WORDS_PER_TASK = 8_000
WORDS_PER_BLOCK = 400_000  # on average, at most
BLOCK_SYMBOLS = 8_000_000  # from which on a block is closed
RESTAGE = 16  # rounds between two rewrites of the word table to the shared folder
_BASE, _GAP_SIZE = 0x100, 0x800
MAX_VOCAB = 0x110000 - _GAP_SIZE - _BASE  # one character per symbol, in words of characters; the surrogates are none
_BITS = 21  # of a symbol in a key; three fit in a number
_PAIR = (1 << 2 * _BITS) - 1
_END = -1  # stands before the first word of a block and after each
_GONE = -2  # a place whose symbol was merged into the one before
BLOCKS = "symbols binary, counts binary, keys array<bigint>, n array<bigint>"


def word_counts(lines: DataFrame, line: str = "line") -> DataFrame:
    """``(w, cnt)`` over all lines; each line keeps its newline, as in a text file."""
    return (
        lines.select(F.explode(pretokens(F.concat(F.col(line), F.lit("\n")))).alias("w"))
        .groupBy("w")
        .agg(F.count("*").alias("cnt"))
    )


def pair_counts(words: DataFrame) -> DataFrame:
    """``(pair, cnt)``: adjacent symbol pairs of ``(w, cnt)`` words, overlaps included."""
    pairs = F.regexp_extract_all("w", F.lit("(?s)(?=(..))"), F.lit(1))
    return (
        words.select(F.explode(pairs).alias("pair"), "cnt")
        .groupBy("pair")
        .agg(F.sum("cnt").alias("cnt"))
    )


# ---- blocks of words ---------------------------------------------------------------------------------------------

def _keys(*symbols: np.ndarray) -> np.ndarray:
    """One number for the symbols of a pair or a triple; they are numbered from 1 in it, so pairs are no triples."""
    key = np.zeros(len(symbols[0]), np.int64)
    for s in symbols:
        key = (key << _BITS) + s + 1
    return key


def _key(a: int, b: int) -> int:
    return (a + 1 << _BITS) + b + 1


def _grams_of(key: int) -> tuple[int, ...]:
    mask = (1 << _BITS) - 1
    parts = (key >> 2 * _BITS, key >> _BITS & mask, key & mask)
    return tuple(x - 1 for x in parts if x)


def _pair_starts(s: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places in ``s`` at which a pair of ``wanted`` (rows of two symbols) starts."""
    if not len(wanted):
        return np.zeros(0, np.int64)
    size = int(max(s.max(), wanted.max())) + 2  # the last element answers for _END
    left, right = np.zeros(size, bool), np.zeros(size, bool)
    left[wanted[:, 0]], right[wanted[:, 1]] = True, True
    at = np.flatnonzero(left[s[:-1]] & right[s[1:]])
    return at[np.isin(_keys(s[at], s[at + 1]), _keys(wanted[:, 0], wanted[:, 1]))]


def _all_pairs(s: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all pairs in words, overlaps included, and the counts of their words."""
    word = np.cumsum(s == _END) - 1
    at = np.flatnonzero((s[:-1] >= 0) & (s[1:] >= 0))
    return _keys(s[at], s[at + 1]), counts[word[at]]


def _groups(keys: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The places of each key."""
    order = np.argsort(keys, kind="stable")
    keys, at = keys[order], at[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else keys
    return zip(keys[first].tolist(), np.split(at, first[1:]))


class _Chain:
    """Words whose symbols are linked, so that a merge costs no more than its occurrences.

    ``starts`` has the places at which the pairs of ``wanted`` keys (all, if None) may start.
    """

    def __init__(self, s: np.ndarray, counts: np.ndarray, at: np.ndarray, wanted: np.ndarray | None = None):
        self.s, self.n, self.wanted = s, counts[np.cumsum(s == _END) - 1 - (np.arange(len(s)) == len(s) - 1)], wanted
        self.next, self.prev = np.arange(1, len(s) + 1), np.arange(-1, len(s) - 1)
        self.starts = {k: (x,) for k, x in _groups(_keys(s[at], s[at + 1]), at)}

    def copy(self) -> _Chain:
        new = object.__new__(_Chain)
        new.s, new.n, new.wanted = self.s.copy(), self.n, self.wanted
        new.next, new.prev, new.starts = self.next.copy(), self.prev.copy(), dict(self.starts)
        return new

    def _pairs(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ``at`` where a pair starts, and its key."""
        at = np.unique(at)
        a, b = self.s[at], self.s[self.next[at]]
        pair = (a >= 0) & (b >= 0)
        return at[pair], _keys(a[pair], b[pair])

    def merge(self, a: int, b: int, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        """Merge all occurrences from left to right: keys of pairs, repeated, and by how much their counts change."""
        key = _key(a, b)
        at = np.unique(np.concatenate([np.zeros(0, np.int64), *self.starts.pop(key, ())]))
        at = at[(self.s[at] == a) & (self.s[self.next[at]] == b)]
        if a == b and len(at):  # of a run every other place
            first = np.concatenate([[True], self.next[at[:-1]] != at[1:]])
            at = at[(np.arange(len(at)) - np.repeat(np.flatnonzero(first), np.diff(np.append(np.flatnonzero(first), len(at))))) % 2 == 0]
        right = self.next[at]
        before, lost = self._pairs(np.concatenate([self.prev[at], at, right]))
        after = self.next[right]
        self.s[at], self.s[right] = symbol, _GONE
        self.next[at], self.prev[after] = after, at
        now, won = self._pairs(np.concatenate([self.prev[at], at]))
        keep = slice(None) if self.wanted is None else np.isin(won, self.wanted)
        for k, places in _groups(won[keep], now[keep]):
            self.starts[k] = (*self.starts.get(k, ()), places)
        return np.concatenate([lost, won]), np.concatenate([-self.n[before], self.n[now]])


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, n
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    n = np.add.reduceat(n, first)
    return keys[first][n != 0], n[n != 0]


def _split(s: np.ndarray, counts: np.ndarray, touched: np.ndarray) -> tuple[np.ndarray, ...]:
    """Symbols and counts of the words that are ``touched``, and of the others."""
    held = np.concatenate([[False], np.repeat(touched, np.diff(np.flatnonzero(s == _END)))])
    start = np.array([_END], np.int32)
    return np.concatenate([start, s[held]]), counts[touched], np.concatenate([start, s[1:][~held[1:]]]), counts[~touched]


def _merged(s: np.ndarray, counts: np.ndarray, merges: np.ndarray) -> tuple[np.ndarray, ...]:
    """Symbols and counts of a block after the merges (rows of left, right and new symbol), each from left to right;
    keys of (merge, left, right) and by how much the merge changes the count of the pair. Words of one symbol are left out."""
    keys, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at = _pair_starts(s, merges[:, :2])
    if not len(at):
        return s, counts, keys[0], n[0]
    touched = np.zeros(len(counts), bool)
    touched[np.searchsorted(np.flatnonzero(s == _END), at) - 1] = True
    changed, changed_counts, s, counts = _split(s, counts, touched)
    chain = _Chain(
        changed, changed_counts, _pair_starts(changed, merges[:, :2]), np.unique(_keys(merges[:, 0], merges[:, 1])))
    for i, merge in enumerate(merges.tolist()):
        pairs, by = _summed(*chain.merge(*merge))
        keys.append((i + 1 << 2 * _BITS) + pairs)
        n.append(by)
    changed = chain.s[chain.s != _GONE]
    changed, changed_counts, _, _ = _split(changed, changed_counts, np.diff(np.flatnonzero(changed == _END)) > 2)
    return np.concatenate([s, changed[1:]]), np.concatenate([counts, changed_counts]), np.concatenate(keys), np.concatenate(n)


def _round(s: np.ndarray, counts: np.ndarray, merges: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, ...]:
    """Symbols and counts of a block after the merges; keys and their numbers.

    Of two symbols the change of their pair's count, of three their count after the merges. Triples are those that hold
    a pair of ``around``. Words of one symbol are left out.
    """
    s, counts, changed, by = _merged(s, counts, merges)
    keys, n = [changed & _PAIR], [by]
    at = _pair_starts(s, around)
    starts = np.zeros(len(s), bool)
    starts[at], starts[at - 1] = True, True  # a pair never starts at 0, where _END is
    at = np.flatnonzero(starts[:-2])
    at = at[(s[at] >= 0) & (s[at + 2] >= 0)]
    if len(at):
        keys.append(_keys(s[at], s[at + 1], s[at + 2]))
        n.append(counts[np.searchsorted(np.flatnonzero(s == _END), at) - 1])
    return s, counts, *_summed(np.concatenate(keys), np.concatenate(n))


def _block(s: np.ndarray, counts: np.ndarray, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    lists = [pa.array([x], pa.list_(pa.int64())) for x in (keys, n)]
    return pa.RecordBatch.from_arrays(
        [pa.array([s.astype(np.int32).tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary()), *lists],
        ["symbols", "counts", "keys", "n"])


def _to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the words (w, cnt) of a task, with the counts of all their pairs."""
    def closed(parts: list) -> pa.RecordBatch:
        s = np.concatenate([np.array([_END], np.int32), *[p[0] for p in parts]])
        counts = np.concatenate([p[1] for p in parts])
        return _block(s, counts, *_summed(*_all_pairs(s, counts)))

    parts, size = [], 0
    for batch in batches:
        s = _symbols(batch.column("w"))
        parts.append((s, batch.column("cnt").to_numpy()))
        size += len(s)
        if size >= BLOCK_SYMBOLS:
            yield closed(parts)
            parts, size = [], 0
    if parts:
        yield closed(parts)


def _symbols(words: pa.Array) -> np.ndarray:
    """The symbols of the words, _END after each."""
    byte_ids = np.array([*BYTE_IDS, _END], np.int32)
    words = words.cast(pa.large_binary())
    first = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[first[0] : first[-1]]
    return byte_ids[np.insert(data.astype(np.int64), first[1:] - first[0], 256)]


def _head(often: pa.Table) -> _Chain:
    """A chain of all pairs of the words (w, cnt)."""
    s = [_symbols(x) for x in often["w"].chunks if len(x)]
    s = np.concatenate([np.array([_END], np.int32), *s])
    counts = often["cnt"].to_numpy() if len(often) else np.zeros(1, np.int64)
    return _Chain(s, counts, np.flatnonzero((s[:-1] >= 0) & (s[1:] >= 0)))


def _apply(blocks: DataFrame, merges: list[tuple[int, int, int]], guesses: list[tuple[int, int, int]]) -> DataFrame:
    """The blocks after the merges, with what each of the guesses would change then."""
    m, tried = np.array(merges, np.int64).reshape(-1, 3), np.array(guesses, np.int64).reshape(-1, 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, counts in zip(batch.column("symbols"), batch.column("counts")):
                s, counts = np.frombuffer(s.as_buffer(), np.int32), np.frombuffer(counts.as_buffer(), np.int64)
                s, counts, _, _ = _merged(s, counts, m)
                yield _block(s, counts, *_merged(s, counts, tried)[2:])

    return blocks.select("symbols", "counts").mapInArrow(run, BLOCKS)


def _changes(blocks: DataFrame) -> pa.Table:
    """``(g, n)``: the numbers of all blocks, added up."""
    each = blocks.selectExpr("inline(arrays_zip(keys, n))").groupBy(F.col("keys").alias("g"))
    return each.agg(F.sum("n").alias("n")).where("n <> 0").toArrow()


class _Ranking:
    """Counts of pairs, by key, and the most frequent one; ties go to smaller symbols."""

    def __init__(self, counts: dict[int, float]):
        self.counts = counts
        self.heap = [(-n, key) for key, n in counts.items()]
        heapify(self.heap)

    def copy(self) -> _Ranking:
        new = object.__new__(_Ranking)
        new.counts, new.heap = dict(self.counts), self.heap.copy()
        return new

    def best(self) -> tuple[int, float]:
        """The most frequent pair and its count; 0 if there is none."""
        while self.heap and self.counts.get(self.heap[0][1], 0) != -self.heap[0][0]:
            heappop(self.heap)
        return (self.heap[0][1], -self.heap[0][0]) if self.heap else (0, 0)

    def change(self, by: Iterable[tuple[int, float]]) -> None:
        for key, n in by:
            n += self.counts.get(key, 0)
            if n > 0:
                self.counts[key] = n
                heappush(self.heap, (-n, key))
            else:
                self.counts.pop(key, None)


class _Pieces:
    """The pieces of a growing vocabulary, and the merges that made them."""

    def __init__(self):
        self.pieces = list(Vocabulary().pieces)
        self.known = {p: i for i, p in enumerate(self.pieces)}
        self.merges: list[tuple[str, str]] = []

    def add(self, a: int, b: int) -> int:
        """The symbol of the merge of two; a piece known before keeps its own."""
        left, right = self.pieces[a], self.pieces[b]
        self.merges.append((left, right))
        if left + right not in self.known:
            self.known[left + right] = len(self.pieces)
            self.pieces.append(left + right)
        return self.known[left + right]

    def cut(self, n_merges: int, n_pieces: int) -> None:
        """Forget the last merges and pieces."""
        for piece in self.pieces[n_pieces:]:
            del self.known[piece]
        del self.pieces[n_pieces:], self.merges[n_merges:]


def _guess(ranking: _Ranking, head: _Chain, vocab: _Pieces, n: int, vocab_size: int, min_frequency: int) -> list[tuple[int, int, int]]:
    """The next ``n`` merges, as the words of ``head`` let expect them; the first is certain. Adds them to ``vocab``."""
    ranking, head, out, tried = ranking.copy(), head.copy(), [], set()
    while len(out) < n and len(vocab.pieces) < vocab_size:
        key, count = ranking.best()
        if count < min_frequency:
            break
        a, b = _grams_of(key)
        if (a, b) in tried:  # a piece known before has made the pair anew
            break
        tried.add((a, b))
        out.append((a, b, vocab.add(a, b)))
        keys, by = _summed(*head.merge(*out[-1]))
        seen = -int(by[keys == key].sum())
        ranking.counts.pop(key)
        other = keys != key
        if seen > 0:  # what the other words would change in proportion
            ranking.change(zip(keys[other].tolist(), np.rint(by[other] * (count / seen)).tolist()))
    return out


class _Replay:
    """Guesses and what each changes if those before it are applied, to be taken in the order of the exact counts.

    New symbols have the numbers they were guessed with; ``true`` has those they got. Two merges that share no symbol
    that way, or never meet around it, never overlap, so they make the same of every word in either order; where they are neighbours, the second
    one sees the symbol of the first or, the other way round, its nearer part.
    """

    def __init__(self, guesses: list[tuple[int, int, int]], changes: list[dict[int, int]], n_pieces: int):
        self.guesses, self.changes, self.n_pieces = guesses, changes, n_pieces
        self.left, self.true, self.where = list(range(len(guesses))), {}, {}
        made: set[int] = set()
        self.new = [s >= n_pieces and not (s in made or made.add(s)) for _, _, s in guesses]
        self.using: dict[int, list[int]] = {}
        for i, (a, b, _) in enumerate(guesses):
            for x in {a, b} & made:
                self.using.setdefault(x, []).append(i)
            self._place(i)

    def _place(self, i: int) -> None:
        a, b = map(self.number, self.guesses[i][:2])
        if a is not None and b is not None:
            self.where[a, b] = i

    def number(self, symbol: int) -> int | None:
        return symbol if symbol < self.n_pieces else self.true.get(symbol)

    def _apart(self, i: int, j: int) -> bool:
        """Whether the merges never overlap; ``i`` was tried before ``j``.

        If the left symbol of one is the right symbol of the other, they overlap where three symbols follow each other,
        which the first one makes a pair of its new symbol and the third.
        """
        (a, b, s), (c, d, t) = self.guesses[i], self.guesses[j]
        if not (self.new[i] and self.new[j]) or s in (c, d) or t in (a, b):
            return False
        if d == a:
            return b != c and not self.changes[i].get(_key(c, s))
        return b != c or not self.changes[i].get(_key(s, d))

    def take(self, pair: tuple[int, int]) -> dict[int, int] | None:
        """What the merge of the pair changes if it is next; None if that is not known. :meth:`taken` must follow."""
        j = self.where.get(pair)
        if j is None:
            return None
        ahead = self.left[: self.left.index(j)]
        if not all(self._apart(i, j) for i in ahead):
            return None
        change = self.changes[j]
        seen = {x for key in change for x in _grams_of(key)}
        for i in reversed(ahead):
            a, b, s = self.guesses[i]
            if s not in seen:
                continue
            moved: dict[int, int] = {}
            for key, n in change.items():
                x, y = _grams_of(key)
                to = _key(b if x == s else x, a if y == s else y)
                moved[to] = moved.get(to, 0) + n
                if to != key:
                    of = self.changes[i]
                    of[key], of[to] = of.get(key, 0) + n, of.get(to, 0) - n
            change = moved
            seen |= {a, b}
        return change

    def taken(self, pair: tuple[int, int], symbol: int) -> None:
        j = self.where.pop(pair)
        self.left.remove(j)
        if self.new[j]:
            self.true[self.guesses[j][2]] = symbol
            for i in self.using.get(self.guesses[j][2], ()):
                self._place(i)


def _round_session(spark: SparkSession, tasks: int) -> SparkSession:
    """Settings of its own for the many short rounds: their shuffles are small and even, so re-planning
    each stage costs more than the stage. A task reads one file of blocks, and Python gets a block at a time."""
    session = spark.newSession()
    session.conf.set("spark.sql.adaptive.enabled", "false")
    session.conf.set("spark.sql.shuffle.partitions", str(min(tasks, spark.sparkContext.defaultParallelism)))
    session.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    session.conf.set("spark.sql.files.maxPartitionBytes", "256m")
    session.conf.set("spark.sql.files.openCostInBytes", "256m")
    return session


def train(
    lines: DataFrame,
    vocab_size: int = VOCAB_SIZE,
    min_frequency: int = MIN_FREQUENCY,
    line: str = "line",
    one_by_one: bool = False,
    log: list | None = None,
) -> Vocabulary:
    """Merge the most frequent pair (ties: smaller ids) until the vocabulary is full or pairs are rare.

    ``log`` collects the batch size of every round; ``one_by_one`` makes each a batch of one.
    """
    if vocab_size > MAX_VOCAB:
        raise ValueError(f"vocab_size is at most {MAX_VOCAB}")
    spark = lines.sparkSession
    counted, n_words = stage_counted(word_counts(lines, line).where(F.octet_length("w") >= 2), "bpe-words")
    tasks = max(min(spark.sparkContext.defaultParallelism, n_words // WORDS_PER_TASK + 1), n_words // WORDS_PER_BLOCK + 1)
    rounds = _round_session(spark, tasks)
    words = stage(counted.repartition(tasks, "w").mapInArrow(_to_blocks, BLOCKS), "bpe-words", reader=rounds)
    often = counted.where(F.octet_length("w") <= HEAD_BYTES).orderBy(F.desc("cnt"), "w").limit(HEAD).toArrow()
    found = _changes(words)  # 65,536 at most
    ranking, vocab, head = _Ranking(dict(zip(found["g"].to_pylist(), found["n"].to_pylist()))), _Pieces(), _head(often)
    merges: list[tuple[int, int, int]] = []  # those that are certain, but not yet applied
    held: list[DataFrame] = []
    n_rounds = 0
    while len(vocab.pieces) < vocab_size:
        n_merges, n_pieces = len(vocab.merges), len(vocab.pieces)
        n = 1 if one_by_one else min(GUESSES, 2 * len(merges) + 16)
        guesses = _guess(ranking, head, vocab, n, vocab_size, min_frequency)
        vocab.cut(n_merges, n_pieces)
        if not guesses:
            break
        n_rounds += 1
        applied = _apply(words, merges, guesses).persist()
        found = _changes(applied)
        changes: list[dict[int, int]] = [{} for _ in guesses]
        for g, n in zip(found["g"].to_pylist(), found["n"].to_pylist()):
            changes[(g >> 2 * _BITS) - 1][g & _PAIR] = n
        replay, merges = _Replay(guesses, changes, n_pieces), []
        while len(vocab.pieces) < vocab_size and ranking.best()[1] >= min_frequency:
            pair = _grams_of(ranking.best()[0])
            change = replay.take(pair)
            if change is None:
                break
            merges.append((*pair, vocab.add(*pair)))
            replay.taken(pair, merges[-1][2])
            head.merge(*merges[-1])
            ranking.change([(_key(*map(replay.number, _grams_of(key))), n) for key, n in change.items()])
        if log is not None:
            log.append(len(merges))
        words = applied
        held.append(applied)
        while len(held) > 1:
            held.pop(0).unpersist()
        if n_rounds % RESTAGE == 0:
            words = stage(words.select("symbols", "counts"), "bpe-words", reader=rounds)
            held.pop().unpersist()
    for df in held:
        df.unpersist()
    return Vocabulary(vocab.merges)


assert N_SPECIAL + 256 < MAX_VOCAB

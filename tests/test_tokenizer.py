import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import ByteLevelBPETokenizer

from grainmill.constants import SPECIAL_TOKENS
from grainmill.functions.text import one_line
from grainmill.operators import bpe_train, codec
from grainmill.operators.vocabulary import BYTE_IDS, Vocabulary
from grainmill.sources.vocab_files import learn_once, load_vocabulary, merge_table, save_vocabulary, vocab_table

SF = "/root/testdata/sf0.001"
ODD = [
    "ab cd", "ab cd", "ab cd", "x ", "x ", "x ", "aaaa aaa aa aaaaaaa", "aaaa aaaa bababab", "It's we'll 12 123 1234",
    "  two  spaces\tand tab", "naïve café – 日本語 🙂🙂", "", "­ soft", "  line", "mississippi mississippi", "<|end|>",
]


def library(tmp_path, lines, vocab_size):
    path = tmp_path / "corpus.txt"
    path.write_bytes("".join(line + "\n" for line in lines).encode())
    lib = ByteLevelBPETokenizer()
    lib.train(files=[str(path)], vocab_size=vocab_size, min_frequency=2, special_tokens=SPECIAL_TOKENS, show_progress=False)
    lib.save_model(str(tmp_path))
    text = (tmp_path / "merges.txt").read_text()
    return lib, [tuple(m.split(" ")) for m in text.split("\n")[1:] if m]


def as_lines(spark, lines):
    return spark.createDataFrame([(x,) for x in lines], "line string").repartition(3)


@pytest.fixture(scope="module")
def documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", one_line(F.col("text")).alias("line"))
    return docs, [r["line"] for r in docs.collect()]


@pytest.fixture(scope="module")
def learnt(spark, documents, tmp_path_factory):
    lib, merges = library(tmp_path_factory.mktemp("lib"), documents[1], 420)
    return lib, merges, bpe_train.train(documents[0], 420)


def test_merges_equal_the_library_on_documents(learnt):
    _, merges, vocab = learnt
    assert vocab.merges == merges


@pytest.mark.parametrize("seed", range(3))
def test_merges_equal_the_library_on_odd_lines(spark, tmp_path, seed):
    r = random.Random(seed)
    lines = ODD + ["".join(r.choice("ab c") for _ in range(r.randrange(40))) for _ in range(30 * seed)]
    _, merges = library(tmp_path, lines, 330)
    assert bpe_train.train(as_lines(spark, lines), 330).merges == merges


def test_batches_equal_one_merge_per_round(spark):
    r = random.Random(9)
    lines = [" ".join("".join(r.choice("abcde") for _ in range(r.randrange(1, 9))) for _ in range(12)) for _ in range(30)]
    rounds = []
    batched = bpe_train.train(as_lines(spark, lines), 285, log=rounds)
    single = bpe_train.train(as_lines(spark, lines), 285, one_by_one=True)
    assert batched.merges == single.merges
    assert max(rounds) > 1 and sum(rounds) == len(batched.merges)


def test_few_rounds_and_wrong_guesses_learn_the_same(spark, documents, learnt, monkeypatch):
    good, poor = [], []
    assert bpe_train.train(documents[0], 420, log=good).merges == learnt[2].merges
    assert len(good) <= 8 and sum(good) == 159, good
    monkeypatch.setattr(bpe_train, "HEAD", 40)
    assert bpe_train.train(documents[0], 340, log=poor).merges == learnt[2].merges[: 340 - 261]
    assert len(poor) > 3, poor


@pytest.mark.parametrize("seed", range(4))
def test_a_round_of_a_block_equals_string_merges(seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abcd"[: 2 + seed]) for _ in range(r.randrange(2, 12))) for _ in range(200)]
    counts = [r.randrange(1, 1 << 60 if seed == 3 else 9) // len(words) + 1 for _ in words]
    merges, around = [("a", "a", "x"), ("x", "b", "y"), ("b", "a", "z"), ("c", "d", "w")], ["xx", "ya", "bb", "ad"]
    want, symbols = {}, [bpe_train._END]
    add = lambda g, n: want.update({g: want.get(g, 0) + n})
    for w, n in zip(words, counts):
        symbols += [*map(ord, w), bpe_train._END]
        v = w
        for a, b, symbol in merges:
            v = v.replace(a + b, symbol)
        for i in range(len(w) - 1):
            add(w[i : i + 2], -n)
        for i in range(len(v) - 1):
            add(v[i : i + 2], n)
        for i in range(len(v) - 2):
            if v[i : i + 2] in around or v[i + 1 : i + 3] in around:
                add(v[i : i + 3], n)
    s, left, keys, n = bpe_train._round(
        np.array(symbols, np.int32), np.array(counts, np.int64), np.array([[*map(ord, m)] for m in merges]),
        np.array([[*map(ord, p)] for p in around]))
    got = {"".join(map(chr, bpe_train._grams_of(int(k)))): int(x) for k, x in zip(keys, n)}
    assert got == {g: x for g, x in want.items() if x}
    assert (s == bpe_train._END).sum() == len(left) + 1


def test_blocks_of_any_size_learn_the_same(spark, documents, learnt, monkeypatch):
    monkeypatch.setattr(bpe_train, "WORDS_PER_BLOCK", 100)
    assert bpe_train.train(documents[0], 300).merges == learnt[2].merges[: 300 - 261]


def test_restaging_changes_nothing(spark, learnt, documents, monkeypatch):
    monkeypatch.setattr(bpe_train, "RESTAGE", 2)
    assert bpe_train.train(documents[0], 340).merges == learnt[2].merges[: 340 - 261]


def test_registered_queries_learn_the_default_vocabulary(spark, documents, tmp_path):
    from grainmill.plans import token_queries

    _, merges = library(tmp_path, documents[1], 8004)
    assert len(merges) > 39
    got = token_queries.train_bpe(spark, SF).orderBy("rank").collect()
    assert [(r["left"], r["right"]) for r in got] == merges


def test_symbols_pass_over_the_surrogates(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bpe_train, "_BASE", 0xD800 - 270)
    _, merges = library(tmp_path, ODD, 290)
    assert bpe_train.train(as_lines(spark, ODD), 290).merges == merges


def test_training_stops_at_rare_pairs(spark):
    assert bpe_train.train(as_lines(spark, ["abc"]), 300).merges == []
    assert bpe_train.train(as_lines(spark, ["ab cd"] * 3), 300).merges[:2] == [("a", "b"), ("c", "d")]


def test_vocabulary_layout():
    v = Vocabulary([("a", "b"), ("ab", "c"), ("b", "c"), ("a", "bc")])
    assert v.pieces[:5] == SPECIAL_TOKENS and len(v.pieces) == 261 + 3  # the last merge spells an old piece
    assert v.piece_bytes[BYTE_IDS[0x20]] == b" " and v.piece_bytes[-1] == b"bc"
    assert sorted(BYTE_IDS) == list(range(5, 261))


@pytest.mark.parametrize("special", ["split", "atomic"])
def test_ids_and_text_equal_the_library(spark, learnt, tmp_path, documents, special):
    lib, _, vocab = learnt
    if special == "split":  # a reload from the two files registers no markers
        save_vocabulary(spark, vocab, str(tmp_path))
        lib = ByteLevelBPETokenizer(str(tmp_path / "vocab.json"), str(tmp_path / "merges.txt"))
    texts = [f"<|problem|>{t}<|step|> x <|end|>" for t in documents[1][:60]] + ODD + [
        "<|problem|>x<|end|>", "a<|end|>", " <|end|> ", "<|pad|><|answer|>", "<|en d|>", "a" * 5000, "xy" * 3000,
    ]
    c = codec.BpeCodec(spark, vocab, special)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(4)
    ids = df.select("i", c.encode(F.col("text")).alias("ids"))
    for r in ids.select("i", "ids", c.decode(F.col("ids")).alias("back")).collect():
        want = lib.encode(texts[r["i"]]).ids
        assert r["ids"] == want
        assert r["back"] == lib.decode(want)
    first = ids.where(F.col("i") == 60 + len(ODD)).first()["ids"]
    assert (first[0] == 1 and first[-1] == 4) if special == "atomic" else all(t > 4 for t in first)


def test_null_and_empty_texts(spark, learnt):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "ab")], "i int, text string")
    for c in (codec.ByteCodec(), codec.BpeCodec(spark, learnt[2])):
        got = {r["i"]: r["ids"] for r in df.select("i", c.encode(F.col("text")).alias("ids")).collect()}
        assert got[1] is None and got[2] == [] and len(got[3]) >= 1


def test_invalid_utf8_decodes_like_the_library(spark, learnt, tmp_path):
    vocab = learnt[2]
    save_vocabulary(spark, vocab, str(tmp_path))
    lib = ByteLevelBPETokenizer(str(tmp_path / "vocab.json"), str(tmp_path / "merges.txt"))
    r = random.Random(3)
    rows = [[r.randrange(5, 261) for _ in range(r.randrange(1, 9))] for _ in range(200)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, ids array<int>")
    for got in df.select("i", codec.BpeCodec(spark, vocab).decode(F.col("ids")).alias("t")).collect():
        assert got["t"] == lib.decode(rows[got["i"]])


def test_word_cache_overflow_changes_nothing(spark, learnt, documents, monkeypatch):
    c = codec.BpeCodec(spark, learnt[2])
    want = [r["ids"] for r in documents[0].orderBy("doc_id").select(c.encode(F.col("line")).alias("ids")).collect()]
    monkeypatch.setattr(codec, "CACHE_PIECES", 10)
    small = codec.BpeCodec(spark, learnt[2])
    got = [r["ids"] for r in documents[0].orderBy("doc_id").select(small.encode(F.col("line")).alias("ids")).collect()]
    assert got == want


@pytest.mark.parametrize("frequent", [10_000, 3])
def test_dictionary_encoding_gives_the_same_ids(spark, learnt, documents, monkeypatch, frequent):
    monkeypatch.setattr(codec, "FREQUENT", frequent)
    c = codec.BpeCodec(spark, learnt[2])
    docs = documents[0].unionByName(spark.createDataFrame([(-1, ""), (-2, "the " * 5000)], "doc_id bigint, line string"))
    got = codec.encode_by_dictionary(docs, c, ["doc_id"], "line").collect()
    want = docs.select("doc_id", c.encode(F.col("line")).alias("ids")).collect()
    assert {r["doc_id"]: r["ids"] for r in got} == {r["doc_id"]: r["ids"] for r in want} and len(got) == len(want)


def test_packed_places_sort_and_unpack_as_arrays(spark):
    rows = [(k, a) for k, a in enumerate([[3], [0, 1], [0], [256, 7], [2, 2**31 - 1, 65_536], [255, 9, 0]])]
    packed = spark.createDataFrame(rows, "k int, a array<int>").withColumn("p", codec._packed(F.col("a")))
    got = packed.orderBy("p").select("a", codec._unpacked(F.col("p")).alias("rest"), F.octet_length("p").alias("n")).collect()
    assert [r["a"] for r in got] == sorted(a for _, a in rows)
    assert all(r["rest"] == r["a"][1:] and r["n"] == 4 * len(r["a"]) for r in got)


def test_vocabulary_is_learnt_once_for_a_version_of_a_table(spark, tmp_path):
    calls = []

    def learn():
        calls.append(1)
        return Vocabulary([("a", "b"), ("c", "d")])

    path = str(tmp_path / "t.parquet")
    spark.range(5).write.parquet(path)
    for _ in range(2):
        assert learn_once(spark.read.parquet(path), "x", learn).merges == [("a", "b"), ("c", "d")]
    assert len(calls) == 1
    spark.range(6).write.mode("overwrite").parquet(path)
    learn_once(spark.read.parquet(path), "x", learn)
    assert len(calls) == 2


def test_saved_files_load_back(spark, learnt, tmp_path):
    vocab = learnt[2]
    save_vocabulary(spark, vocab, str(tmp_path))
    assert load_vocabulary(spark, str(tmp_path)).merges == vocab.merges
    assert {(r["piece"], r["id"]) for r in vocab_table(spark, str(tmp_path)).collect()} == set(vocab.ids.items())
    ranked = merge_table(spark, str(tmp_path)).orderBy("rank").collect()
    assert [tuple(r) for r in ranked] == [(i, a, b) for i, (a, b) in enumerate(vocab.merges)]
    assert spark.read.parquet(str(tmp_path / "vocab.parquet")).count() == len(vocab.pieces)


def test_token_list(spark, learnt):
    lib, _, vocab = learnt
    text = "<|problem|>Which town lies north?<|step|>Look at the map, then 12 miles on.<|answer|>Ely<|end|>"
    c = codec.BpeCodec(spark, vocab, "atomic")
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(codec.token_list(c.encode(F.col("t")), vocab).alias("p")).first()["p"]
    assert got == lib.encode(text).tokens


def test_guesses_that_never_meet_are_taken_in_any_order():
    key, size = bpe_train._key, 300

    def first(changes):
        replay = bpe_train._Replay([(1, 2, 300), (3, 1, 301)], changes, size)
        return replay.take((3, 1))

    apart = [{key(1, 2): -5}, {key(3, 1): -4}]
    assert first(apart) == {key(3, 1): -4}
    assert first([{key(1, 2): -5, key(3, 1): -1, key(3, 300): 1}, {key(3, 1): -4}]) is None  # 3, 1, 2 follow each other
    both = bpe_train._Replay([(1, 2, 300), (2, 1, 301)], apart[:1] + [{key(2, 1): -4}], size)
    assert both.take((2, 1)) is None  # of 1, 2, 1, 2 nothing would tell


@pytest.mark.parametrize("head", [30, 2000])
def test_merges_of_short_words_over_few_letters_equal_the_library(spark, tmp_path, monkeypatch, head):
    monkeypatch.setattr(bpe_train, "HEAD", head)
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 9)))
    lines = [" ".join(word() for _ in range(40)) for _ in range(150)]
    assert bpe_train.train(as_lines(spark, lines), 460).merges == library(tmp_path, lines, 460)[1]

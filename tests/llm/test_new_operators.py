"""Hard negatives, the Merkle manifest and phrase fingerprints on edge inputs and against plain restatements."""

import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from grainmill.llm import hard_negatives, merkle, phrase_prints, quality_rules
from grainmill.llm.queries import MANIFEST_FIELDS
from test_operators import LONG, ROWS, SCHEMA

# Quality rules


def _kept_by_force(counted, min_group):
    """Whether each row is kept, from its counts: fences of the group, else of its language, else of all."""
    div = lambda a, b: a // b if b else 0
    down = lambda x: x >> max(0, len(bin(x)) - 2 - 6) << max(0, len(bin(x)) - 2 - 6)
    rates = lambda r: (
        div(r.word_chars * 100, r.n_words), div(r.n_symbols * 1000, r.word_chars), div(r.n_dup_lines * 1000, r.n_lines),
        div(r.n_repeat_words * 1000, r.n_words), div(r.n_stutters * 1000, r.n_words))

    def quarter(values, q):
        values = sorted(map(down, values))
        return next(v for i, v in enumerate(values, 1) if i * 4 >= len(values) * q)

    out = []
    for r in counted:
        inside = not r.base_failed
        wide = [x for x in counted if x.lang == r.lang]
        wide = wide if len(wide) >= min_group else counted
        own = [x for x in counted if (x.lang, x.source) == (r.lang, r.source)]
        own = own if len(own) >= min_group else wide
        for k, (m, (low, high, least)) in enumerate(quality_rules.MEASURES.items()):
            def edge(group, sign, times):
                mid = quarter([rates(x)[k] for x in group], 2)
                return mid + sign * times * quality_rules.SPREAD * max(mid - quarter([rates(x)[k] for x in group], 1), least)

            inside &= not low or rates(r)[k] >= max(edge(own, -1, 1), edge(wide, -1, 2))
            inside &= not high or rates(r)[k] <= min(edge(own, 1, 1), edge(wide, 1, 2))
        out.append(inside)
    return out


def _prose(r, n, alphabet):
    return " ".join("".join(r.choice(alphabet) for _ in range(r.randrange(2, 9))) for _ in range(n))


@pytest.mark.parametrize("min_group", [1, 30, 10**6])
def test_fences_and_verdicts_match_brute_force(spark, min_group):
    r = random.Random(6)
    rows = []
    for i in range(220):
        text = _prose(r, r.choice([5, 40, 60]), "abcdefgh")
        text = r.choice([text, text, text, text.replace("a", "#"), text + "\nsame line\nsame line\nsame line", "a " * 50 + text])
        rows.append((i, text, r.choice(["en", "de", None]), r.choice("xy"), "clash", 1))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, symbol_rate_high string, __word_length_low int")
    for keep_text in (False, True):
        got = sorted(quality_rules.apply_rules(df, keep_text=keep_text, min_group=min_group).collect(), key=lambda g: g.doc_id)
        assert [g.kept for g in got] == _kept_by_force(got, min_group)
        assert {g.symbol_rate_high for g in got} == {"clash"} and 0 < sum(g.kept for g in got) < len(got)


def test_a_source_with_a_third_of_junk_loses_it(spark):
    r = random.Random(7)
    line = lambda: _prose(r, 8, "abcdefghijklmnop")
    rows = []
    for i in range(1000):
        lines = [line() for _ in range(40)]
        if i < 300:  # 19 of 40 lines repeated
            lines[20:39] = lines[:19]
        rows.append((i, "\n".join(lines), "en", "hot"))
    kept = quality_rules.apply_rules(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").repartition(8))
    assert {g.doc_id for g in kept.where("kept").collect()} == set(range(300, 1000))


# Hard negatives

VECTORS = "vec_id bigint, embedding array<float>, label int, id string, row string, score string"


def _vectors(n=400, dims=11, seed=3):
    r = random.Random(seed)
    same = [r.gauss(0, 1) for _ in range(dims)]
    rows = []
    for i in range(n):
        v = list(same) if i % 3 == 0 else [r.gauss(0, 1) for _ in range(dims)]  # a third are copies of one vector
        rows.append([i, v, 4 if i % 4 == 0 else r.randrange(6)])
    rows[5][2], rows[6][1], rows[7][1] = None, None, [1.0, None]
    rows[8][1], rows[9][1], rows[10][1] = [float("nan")] * dims, [float("inf")] * dims, []
    rows[11][1], rows[12][0], rows[13][0] = [0.5], None, 200
    rows += [rows[200], [-100, [-x for x in same], 4], [100, [0.0] * dims, 1], [None, same, 1]]
    return [(*x, "a", "b", "c") for x in rows]


def _mined_by_force(rows, n_pos=5, n_neg=10):
    import struct

    single = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    good = []
    for i, (k, v, label, *_) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        good.append((i, k, (label + 1) % 10 if k is not None and k % 7 == 0 else label, [math.floor(256 * single(x)) for x in v]))
    order = lambda hit: (-hit[0], hit[1] is None, hit[1] or 0)
    out = []
    for i, k, label, v in good:
        if k is None or k % 100:
            continue
        hits = [(sum(a * b for a, b in zip(v, w)), m, other) for j, m, other, w in good if j != i]
        near = sorted((h for h in hits if h[2] == label), key=order)[:n_pos]
        for p, pid, _ in near:
            far = sorted((h for h in hits if h[2] != label and 30 * p <= 100 * h[0] <= 90 * p), key=order)[:n_neg]
            out += [(k, pid, r, m, p, s) for r, (s, m, _) in enumerate(far, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("rows_a_block, round_bytes", [(4096, 4 << 20), (37, 300)])
def test_mined_negatives_match_brute_force(spark, monkeypatch, rows_a_block, round_bytes):
    monkeypatch.setattr(hard_negatives, "ROWS", rows_a_block)
    monkeypatch.setattr(hard_negatives, "ROUND_BYTES", round_bytes)
    rows = _vectors()
    df = spark.createDataFrame(rows, VECTORS)
    label = F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)")
    got = hard_negatives.mine(df, F.col("id") % 100 == 0, label=label).collect()
    want = _mined_by_force(rows)
    assert len(want) > 100 and sorted(map(tuple, got), key=str) == want


def test_mining_without_rows_anchors_or_components(spark):
    empty = spark.createDataFrame([], VECTORS)
    none = spark.createDataFrame([(1, [1.0], 1, "", "", ""), (2, [1.0], 1, "", "", "")], VECTORS)
    bare = spark.createDataFrame([(100, [], 1, "", "", ""), (2, [], 2, "", "", "")], VECTORS)
    alone = spark.createDataFrame([(100, [1.0], 1, "", "", "")], VECTORS)
    for df in (empty, none, bare, alone):
        out = hard_negatives.mine(df, F.col("id") % 100 == 0)
        assert out.collect() == [] and len(out.columns) == 6


# Merkle manifest


def _sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row):
    return _sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def _levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([_sha(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def _manifest_by_force(rows):
    """{(doc_id, leaf): [(subroot, root, siblings)]} of (doc_id, source, lang, n_chars, text) rows."""
    langs = {}
    for row in rows:
        langs.setdefault(row[2], []).append((row[0], _leaf(row)))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: _levels([d for _, d in sorted(langs[x], key=lambda n: (n[0] is not None, n[0] or 0, n[1]))]) for x in order}
    top = _levels([trees[x][-1][0] for x in order])
    siblings = lambda levels, i: [
        level[(i >> h) ^ 1] for h, level in enumerate(levels[:-1]) if (i >> h) ^ 1 < len(level)]
    out = []
    for at, x in enumerate(order):
        ids = sorted(langs[x], key=lambda n: (n[0] is not None, n[0] or 0, n[1]))
        for i, (k, digest) in enumerate(ids):
            out.append((k, digest, trees[x][-1][0], top[-1][0], _sha(*siblings(trees[x], i), *siblings(top, at))))
    return sorted(out, key=str)


def _many(n):
    r = random.Random(8)
    return [(i, r.choice("ab"), "en" if i % 3 else r.choice(["de", None, "ünï"]), i if i % 5 else None, f"text {i % 50}") for i in range(n)]


def _digests(manifest):
    w = merkle.witnesses(manifest)
    return w.select("id", "leaf", "subroot", "root", merkle.proof(F.col("witness")), merkle.fold(F.col("leaf"), F.col("witness")))


@pytest.mark.parametrize("n", [1, 2, 3, 1500, 1601])
def test_manifest_matches_plain_trees(spark, n):
    rows = _many(n)
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string").repartition(3)
    got = [tuple(r) for r in _digests(merkle.build(df, "lang", "doc_id", MANIFEST_FIELDS)).collect()]
    assert sorted((g[:-1] for g in got), key=str) == _manifest_by_force(rows)
    assert all(g[-1] == g[3] for g in got)  # every witness leads to the root


def test_manifest_of_edge_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in ROWS], SCHEMA + ", part string, pos int, digest string")
    m = merkle.build(df, "lang", "doc_id", MANIFEST_FIELDS, extra=F.col("part"))
    rows = [(k, source, lang, n, text) for k, text, lang, source, n in ROWS]
    assert sorted((tuple(r)[:-1] for r in _digests(m).collect()), key=str) == _manifest_by_force(rows)
    assert {r.extra for r in merkle.witnesses(m).collect()} == {"x"}
    empty = merkle.build(spark.createDataFrame([], SCHEMA), "lang", "doc_id", MANIFEST_FIELDS)
    assert merkle.witnesses(empty).collect() == []


def test_appended_batches_equal_one_build(spark):
    rows = _many(1700)
    cuts = [0, 1, 700, 701, 1640, 1700]
    frame = lambda part: spark.createDataFrame(part, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    m = merkle.build(frame(rows[: cuts[1]]), "lang", "doc_id", MANIFEST_FIELDS)
    for a, b in zip(cuts[1:], cuts[2:]):
        m = merkle.append(m, frame(rows[a:b]), "lang", "doc_id", MANIFEST_FIELDS)
    assert sorted((tuple(r)[:-1] for r in _digests(m).collect()), key=str) == _manifest_by_force(rows)


def test_tampered_leaf_does_not_verify(spark):
    df = spark.createDataFrame(_many(40), "doc_id bigint, source string, lang string, n_chars bigint, text string")
    w = merkle.witnesses(merkle.build(df, "lang", "doc_id", MANIFEST_FIELDS))
    folded = w.select("root", merkle.fold(F.sha2(F.concat("leaf", F.lit("x")), 256), F.col("witness")).alias("f"))
    assert folded.where("f = root").count() == 0


# Phrase fingerprints


def _phrases(data):
    seen, start = set(), 0
    for stop in range(1, len(data) + 1):
        if data[start:stop] not in seen:
            seen.add(data[start:stop])
            start = stop
    return seen | ({data[start:]} if start < len(data) else set())


def _alike(a, b):
    return 1.0 if a == b else len(a & b) / len(a | b)


@pytest.mark.parametrize("partitions", [1, 5])
def test_edits_and_likeness_match_plain_parsing(spark, monkeypatch, partitions):
    r = random.Random(2)
    say = lambda n: " ".join(r.choice(["stone", "river", "über", "漢字", "a", "walk", "cloud"]) for _ in range(n))
    rows = [(3 * i, r.choice([None, "", "short", say(5), say(40), say(400)])) for i in range(60)] + [(1000, LONG)]
    monkeypatch.setattr(phrase_prints, "shuffle_partitions", lambda _: 9)
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id bigint, text string, range string, k0 int").repartition(partitions)
    got = {g.id: g for g in phrase_prints.compare_with_edits(df).collect()}
    order = sorted(((k, t or "") for k, t in rows), reverse=True)
    assert len(got) == len(rows)
    for (k, text), (_, after) in zip(order, order[1:] + order[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        g = got[k]
        assert (g.n_chars, g.edited_sha256) == (len(text), _sha(edited))
        own, new, other = (_phrases(x.encode()) for x in (text, edited, after))
        for value, a, b in ((g.near_edited, own, new), (g.near_next, own, other)):
            # exact for small sets, else within four standard errors of 64 hashes
            assert value == pytest.approx(_alike(a, b), abs=1e-9 if len(a | b) <= 64 else 0.25)
        assert len(g.print) == 4 * min(64, len(own)) and len(g.edited_print) == 4 * min(64, len(new))


def test_phrases_of_edge_rows(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = phrase_prints.compare_with_edits(df).collect()
    assert sorted((g.id, g.n_chars) for g in got if g.id is not None) == sorted((k, len(t or "")) for k, t, *_ in ROWS if k is not None)
    assert sum(g.id is None for g in got) == 2
    prints = {g.id: g.print for g in got if g.id in (5, 6)}
    assert prints[5] in {g.print for g in got if g.id == 6}  # equal texts, equal fingerprints
    assert phrase_prints.compare_with_edits(spark.createDataFrame([], SCHEMA)).collect() == []


def test_repeated_rows_follow_each_other(spark):
    rows = [(7, "same words here")] * 500 + [(5, "then other words"), (9, "first of all words")]
    got = phrase_prints.compare_with_edits(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()
    mine = [g for g in got if g.id == 7]
    assert len(mine) == 500
    assert sum(g.near_next == 1.0 for g in mine) == 499 and len({g.edited_sha256 for g in mine}) == 2


def test_dictionary_restarts_on_long_texts(monkeypatch):
    monkeypatch.setattr(phrase_prints, "DICTIONARY", 50)
    data = LONG.encode()[:5000]
    ends = phrase_prints.phrase_ends(data)
    assert ends[-1] == len(data) and ends == sorted(set(ends))
    assert phrase_prints.phrase_ends(b"") == [] and phrase_prints.phrase_ends(b"aaaa") == [1, 3, 4]


def test_crc_of_identifiers(spark):
    got = spark.range(50).select("id", F.crc32(F.col("id").cast("string")).alias("c")).collect()
    assert all(g.c == zlib.crc32(str(g.id).encode()) for g in got)


# Pipeline stages


@pytest.fixture(scope="module")
def stages():
    import corpus_pipeline

    return dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", ["quality_rules", "line_dedup", "near_dedup", "fair_mix", "bpe_codec"])
def test_stages_of_an_empty_table(spark, stages, name):
    empty = spark.createDataFrame([], SCHEMA)
    out = stages[name](spark, empty, "")
    assert out.collect() == []
    assert name == "bpe_codec" or out.columns == empty.columns


def test_stages_of_edge_rows(spark, stages):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    run = lambda name: stages[name](spark, docs, "").collect()
    ids = lambda rows: sorted((r.doc_id for r in rows), key=str)
    every = sorted((r[0] for r in ROWS), key=str)
    assert ids(run("quality_rules")) == [1, 2, 7]  # the others have under 20 words, repeat themselves or hold no text
    lines = run("line_dedup")
    assert ids(lines) == every and all((r.text is None) == (r.n_chars is None) or r.text is not None for r in lines)
    assert {r.text for r in lines if r.doc_id == 1} == {ROWS[0][1]}
    # 2 is nearly 1 and 6 has the text of 5; rows without identifier stay
    assert ids(run("near_dedup")) == sorted([1, 3, 4, 5, 7, 8, 9, 10, None, None], key=str)
    served = {r.doc_id for r in run("fair_mix")}
    assert served <= set(every) and not served & {3, 4, 8}
    coded = run("bpe_codec")
    assert ids(coded) == every and all(r.round_trip for r in coded)
    assert {r.n_tokens for r in coded if r.doc_id in (3, 4)} == {0}

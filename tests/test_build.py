"""Composed builds, plans, and every registered query against its SQL."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import entry, oracle_sql, queries
from grainmill.functions.text import one_line
from grainmill.operators import bpe_train, recipes
from grainmill.operators.codec import BpeCodec, ByteCodec
from grainmill.operators.packing import pack
from grainmill.plans.build import token_build, tokenizer_build, training_windows
from grainmill.plans.catalog import QUERIES
from grainmill.sources import tables
from tools.check_queries import TABLES, _rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vocab(spark):
    lines = spark.read.parquet(f"{SF}/documents.parquet").select(one_line(F.col("text")).alias("line"))
    return bpe_train.train(lines, 320)


def build_by_loop(rows, weights, known, total, encode, end):
    out = []
    for name, weight in weights:
        if name not in known:
            continue
        used = 0
        for text in (t for s, _, t in sorted(rows) if s == name):
            ids = encode(text) + end
            out += ids
            used += len(ids)
            if used >= int(total * weight):
                break
    return out


@pytest.mark.parametrize("recipe, total", [("base", 40_000), ("base", 400_000), ("cpt", 40_000), ("base", 0)])
@pytest.mark.parametrize("kind", ["bytes", "bpe"])
def test_token_stream_equals_a_loop(spark, vocab, recipe, total, kind):
    raw = tables.raw_corpus(spark, SF)
    codec = ByteCodec() if kind == "bytes" else BpeCodec(spark, vocab)
    b = token_build(raw, recipe, total, codec)
    got = [t for r in b.stream().orderBy("doc_no").collect() for t in r["ids"]]
    docs = recipes.prepare(raw, recipe)
    encoded = docs.select("source", "ord", codec.encode(F.col("text")).alias("ids")).collect()
    ids = {(r["source"], r["ord"]): r["ids"] for r in encoded}
    r = recipes.RECIPES[recipe]
    want = build_by_loop(
        [(s, o, (s, o)) for s, o in ids], r.weights, r.rules, total, lambda k: ids[k], [4] if recipe == "base" else []
    )
    assert got == want
    windows = training_windows(b, 64).orderBy("window_id").collect()
    assert [w["ids"] for w in windows] == [want[k * 64 : k * 64 + 65] for k in range(max(len(want) - 1, 0) // 64)]
    report = b.report().agg(F.sum("tokens"), F.sum("samples")).first()
    assert report[0] == len(want)


def test_stream_is_the_same_however_the_input_is_partitioned(spark):
    def windows(tasks):
        raw = tables.raw_corpus(spark, SF).repartition(tasks)
        return sorted(map(str, pack(token_build(raw, "cpt", 60_000).stream(), 100).collect()))

    assert windows(1) == windows(4) == windows(64)


def test_clean_mode_repairs_the_weights_and_the_second_end_token(spark):
    raw = tables.raw_corpus(spark, SF)
    report = {r["source"]: r["status"] for r in token_build(raw, "cpt", 40_000, compat=False).report().collect()}
    assert report["bookcorpus"] == "reached" and report["arc"] == "skipped"
    loose, clean = (token_build(raw, "base", 10**9, compat=c).kept for c in (True, False))
    assert loose.agg(F.sum("n_tokens")).first()[0] == clean.agg(F.sum("n_tokens")).first()[0] + clean.count()


def test_tokenizer_build_uses_the_sampled_corpus(spark):
    assert len(tokenizer_build(tables.raw_corpus(spark, SF), 280).pieces) == 280


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_the_columns_they_need(spark):
    for name in ("prepare_base", "prepare_cpt"):
        schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan_of(queries()[name](spark, SF)))
        assert any("text" in s and "lang" not in s and "n_chars" not in s for s in schemas)


def test_length_filter_runs_in_the_scan_stage_below_encoding(spark):
    docs = recipes.prepare(tables.raw_corpus(spark, SF), "cpt")
    plan = plan_of(docs.select(ByteCodec().encode(F.col("text")).alias("ids")))
    assert plan.index("ArrowEvalPython") < plan.index("Filter")


@pytest.mark.parametrize("name", ["budget_prefix", "first_n_rows", "running_loss", "rank_shards", "top_k_with_ties", "consistency"])
def test_no_window_without_keys_and_no_cross_join(spark, name):
    plan = plan_of(queries()[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # one task may only merge the partial rows of a global aggregate, or the row per source
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            below = lines[i + 1]
            assert "partial_" in below and "keys=[]" in below or re.search(r"keys=\[source#\d+L?, pos", below)


def test_entry(spark):
    assert {r["status"] for r in entry(spark).collect()} <= {"reached", "exhausted", "skipped"}


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = queries()[name](spark, SF)
    rows = _rows(df.columns, df.collect())
    if name in oracle_sql():
        cur = duck.execute(oracle_sql()[name])
        names = [c[0] for c in cur.description]
        assert sorted(df.columns) == sorted(names)
        assert rows == _rows(names, cur.fetchall())
    else:
        assert rows


@pytest.mark.parametrize("recipe", ["base", "cpt"])
def test_totals_observed_while_writing_equal_a_pass_over_the_rows(spark, recipe):
    raw = tables.raw_corpus(spark, SF)
    seen, counted = (token_build(raw, recipe, 200_000, stage_kept=s) for s in (True, False))
    assert seen.totals is not None and counted.totals is None
    assert sorted(map(tuple, seen.report().collect())) == sorted(map(tuple, counted.report().collect()))

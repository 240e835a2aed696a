"""The registered queries on the smallest tables: against SQL, and the pipeline against its operators."""

import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_operators import _near_by_force
from __spark_entry__ import oracle_sql, queries
from grainmill.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


def test_registered():
    assert set(QUERIES) <= set(queries()) and set(SQL) <= set(oracle_sql()) and "pipeline" in queries()
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "embeddings"):
        db.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    cur = db.execute(SQL[name])
    names = [c[0] for c in cur.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert _rows(got.columns, got.collect()) == _rows(names, cur.fetchall())


def test_shards_against_rows(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op6_rendezvous"](spark, SF).collect()
    assert {r.doc_id for r in got} == set(docs)
    for r in got:
        data = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 16, zlib.crc32(data), "key")


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        counts.append(docs.count())
        if name == "near_dedup":
            given = before.orderBy("doc_id").collect()
            least, _ = _near_by_force([r.text for r in given])
            assert {r.doc_id for r in docs.collect()} == {given[i].doc_id for i in set(least)}
    assert counts[1] < counts[0] and counts[2] == counts[1] and counts[3] <= counts[2]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == counts[-1] and last.where(~F.col("round_trip")).count() == 0

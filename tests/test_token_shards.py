import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainmill.sources.token_shards import read_shards, write_shards, shard_stream


def make_docs(spark, seed, n=60):
    r = random.Random(seed)
    docs = [[r.randrange(8004) for _ in range(r.choice([0, 1, 5, 40, 700]))] for _ in range(n)]
    rows, at = [], 0
    for i, ids in enumerate(docs):
        rows.append((i, at, ids))
        at += len(ids)
    df = spark.createDataFrame(rows, "doc_no bigint, start bigint, ids array<int>").repartition(6)
    return df, [t for d in docs for t in d]


@pytest.mark.parametrize("shard, span", [(1000, 300), (64, 1000), (10**6, 77)])
def test_shards_concatenate_to_the_stream(spark, tmp_path, shard, span):
    df, stream = make_docs(spark, shard)
    path = str(tmp_path / "tokens")
    write_shards(df, path, shard)
    listed = json.loads((tmp_path / "tokens" / "manifest.json").read_text())
    joined = np.concatenate([np.fromfile(f"{path}/{s['file']}", dtype="<i4") for s in listed])
    assert joined.tolist() == stream
    assert [s["first_pos"] for s in listed] == np.cumsum([0] + [s["n"] for s in listed])[:-1].tolist()
    back = read_shards(spark, path, span)
    assert [r["id"] for r in back.orderBy("pos").collect()] == stream
    assert back.agg(F.max("pos"), F.countDistinct("pos")).first() == (len(stream) - 1, len(stream))


def test_plain_token_file(spark, tmp_path):
    ids = np.arange(5000, dtype="<i4") % 997
    ids.tofile(tmp_path / "tokens.bin")
    got = read_shards(spark, str(tmp_path / "tokens.bin"), 512)
    assert got.rdd.getNumPartitions() == 10
    assert [r["id"] for r in got.orderBy("pos").collect()] == ids.tolist()


def test_files_a_failed_task_left_are_ignored(spark, tmp_path):
    df, stream = make_docs(spark, 2)
    path = tmp_path / "tokens"
    write_shards(df, str(path), 500)
    np.zeros(10, dtype="<i4").tofile(path / "shard-00000000-deadbeef.bin")
    assert read_shards(spark, str(path)).count() == len(stream)


def test_a_second_write_is_refused_or_replaces(spark, tmp_path):
    first, stream = make_docs(spark, 3)
    second, other = make_docs(spark, 4)
    path = tmp_path / "tokens"
    write_shards(first, str(path), 500)
    with pytest.raises(Exception, match="holds a token stream"):
        write_shards(second, str(path), 500)
    assert [r["id"] for r in read_shards(spark, str(path)).orderBy("pos").collect()] == stream
    write_shards(second, str(path), 500, overwrite=True)
    back = read_shards(spark, str(path))
    assert [r["id"] for r in back.orderBy("pos").collect()] == other
    listed = {s["file"] for s in json.loads((path / "manifest.json").read_text())}
    assert {f.name for f in path.glob("*.bin")} == listed
    assert back.rdd.getNumPartitions() == len(listed)


def test_shards_added_in_batches_equal_the_batch_read(spark, tmp_path):
    path, out, log = (str(tmp_path / x) for x in ("shards", "out", "log"))
    total = 0
    for part in range(3):
        ids = [list(range(total + 10 * k, total + 10 * k + 10)) for k in range(5 + part)]
        docs = spark.createDataFrame([(10 * k, x, k) for k, x in enumerate(ids)], "start bigint, ids array<int>, doc_no bigint")
        write_shards(docs, path, shard_tokens=16, extend=True)
        total += 10 * len(ids)
        shard_stream(spark, path, range_tokens=5).writeStream.format("parquet").option("checkpointLocation", log).trigger(
            availableNow=True).start(out).awaitTermination()
        arrived = spark.read.schema("pos bigint, id int").parquet(out).orderBy("pos").collect()
        assert [tuple(r) for r in arrived] == [(i, i) for i in range(total)]
    assert sorted(map(tuple, read_shards(spark, path, range_tokens=7).collect())) == [(i, i) for i in range(total)]
    with pytest.raises(Exception, match="token stream"):
        write_shards(docs, path)

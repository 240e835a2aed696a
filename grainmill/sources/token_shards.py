"""Flat little-endian int32 token files as a Spark data source.

A written folder holds one ``.bin`` file per shard of ``shard_tokens`` tokens and a ``manifest.json``
that lists them in stream order with their first position; concatenated in that order they are the one
flat file. File names carry a task-unique suffix and only files named in the manifest count, so retried
or speculative tasks leave no duplicates.

    spark.dataSource.register(TokenShards)
    spark.read.format("token_shards").load(path)          # (pos, id)
    spark.readStream.format("token_shards").load(path)    # the same, as shards are added to the manifest
    write_shards(docs, path)                              # docs: (start, ids)
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage,
)

from grainmill.operators.packing import pieces
from grainmill.sources.files import filesystem, read_text, write_text

SHARD_TOKENS = 64 * 1024 * 1024  # 256 MB per file
RANGE_TOKENS = 8 * 1024 * 1024  # tokens one read task covers
BATCH_TOKENS = 1024 * 1024


@dataclass
class TokenRange(InputPartition):
    file: str
    first_token: int
    n: int
    first_pos: int


@dataclass
class WrittenShards(WriterCommitMessage):
    shards: list[tuple[int, str, int]]


class TokenShards(DataSource):
    @classmethod
    def name(cls) -> str:
        return "token_shards"

    def schema(self) -> str:
        return "pos bigint, id int"

    def reader(self, schema) -> "TokenReader":
        return TokenReader(self.options["path"], int(self.options.get("range_tokens", RANGE_TOKENS)))

    def streamReader(self, schema) -> "TokenStreamReader":
        return TokenStreamReader(self.options["path"], int(self.options.get("range_tokens", RANGE_TOKENS)))

    def writer(self, schema, overwrite: bool) -> "TokenWriter":
        return TokenWriter(self.options["path"], overwrite, self.options.get("extend", "false") == "true")


class TokenReader(DataSourceReader):
    """Reads a written folder, or one plain token file."""

    def __init__(self, path: str, range_tokens: int):
        self.path, self.range_tokens = path.rstrip("/"), range_tokens

    def _files(self) -> list[tuple[str, int, int]]:
        if self.path.endswith(".bin"):
            f, p = filesystem(self.path)
            return [(self.path, f.get_file_info(p).size // 4, 0)]
        listed = json.loads(read_text(f"{self.path}/manifest.json"))
        return [(f"{self.path}/{s['file']}", s["n"], s["first_pos"]) for s in listed]

    def partitions(self) -> list[TokenRange]:
        return _ranges(self._files(), self.range_tokens)

    def read(self, partition: TokenRange) -> Iterator[pa.RecordBatch]:
        return _tokens(partition)


class TokenStreamReader(DataSourceStreamReader):
    """Shards in the order of the manifest; the offset is how many of them have been read."""

    def __init__(self, path: str, range_tokens: int):
        self.path, self.range_tokens = path.rstrip("/"), range_tokens

    def initialOffset(self) -> dict:
        return {"shards": 0}

    def latestOffset(self) -> dict:
        f, base = filesystem(self.path)
        if not f.get_file_info(f"{base}/manifest.json").is_file:
            return {"shards": 0}
        return {"shards": len(json.loads(read_text(f"{self.path}/manifest.json")))}

    def partitions(self, start: dict, end: dict) -> list[TokenRange]:
        if start["shards"] == end["shards"]:
            return []
        return _ranges(TokenReader(self.path, 0)._files()[start["shards"] : end["shards"]], self.range_tokens)

    def read(self, partition: TokenRange) -> Iterator[pa.RecordBatch]:
        return _tokens(partition)

    def commit(self, end: dict) -> None:
        """Shards stay where they are."""


def _ranges(files: list[tuple[str, int, int]], range_tokens: int) -> list[TokenRange]:
    return [
        TokenRange(file, at, min(range_tokens, n - at), first + at)
        for file, n, first in files
        for at in range(0, n, range_tokens)
    ]


def _tokens(partition: TokenRange) -> Iterator[pa.RecordBatch]:
    f, p = filesystem(partition.file)
    with f.open_input_file(p) as src:
        for at in range(0, partition.n, BATCH_TOKENS):
            n = min(BATCH_TOKENS, partition.n - at)
            data = src.read_at(n * 4, (partition.first_token + at) * 4)
            pos = partition.first_pos + at
            yield pa.record_batch({
                "pos": pa.array(np.arange(pos, pos + n, dtype=np.int64)),
                "id": pa.array(np.frombuffer(data, dtype="<i4")),
            })


class TokenWriter(DataSourceArrowWriter):
    """Takes ``(shard, s, piece)`` rows, each shard whole in one task and in stream order.

    A folder holds one token stream. Writing to a folder that has a manifest is refused unless overwriting or extending.
    If overwriting, the new manifest replaces the old one in one step and the files of the old stream are deleted after
    it; if extending, it lists the old shards and then the new ones.
    """

    def __init__(self, path: str, overwrite: bool = False, extend: bool = False):
        self.path, self.extend = path.rstrip("/"), extend and not overwrite
        f, base = filesystem(self.path)
        manifest = f.get_file_info(f"{base}/manifest.json")
        self.old = json.loads(read_text(f"{self.path}/manifest.json")) if manifest.is_file else []
        if manifest.is_file and not overwrite and not extend:
            raise ValueError(f"{self.path} holds a token stream; use mode overwrite to replace it")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WrittenShards:
        f, base = filesystem(self.path)
        f.create_dir(base, recursive=True)
        done, out, current = [], None, None
        for batch in iterator:
            shards = batch.column("shard").to_numpy()
            lists = batch.column("piece")
            edges = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                if shards[lo] != current:
                    if out is not None:
                        out.close()
                    current = int(shards[lo])
                    name = f"shard-{current:08d}-{uuid.uuid4().hex}.bin"
                    out = f.open_output_stream(f"{base}/{name}")
                    done.append([current, name, 0])
                values = lists.slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False).astype("<i4")
                out.write(values.tobytes())
                done[-1][2] += len(values)
        if out is not None:
            out.close()
        return WrittenShards([tuple(d) for d in done])

    def commit(self, messages: list[WrittenShards | None]) -> None:
        listed = list(self.old) if self.extend else []
        pos, first = sum(s["n"] for s in listed), len(listed)
        for shard, name, n in sorted(s for m in messages if m for s in m.shards):
            listed.append({"shard": first + shard, "file": name, "n": n, "first_pos": pos})
            pos += n
        write_text(f"{self.path}/manifest.json", json.dumps(listed, indent=0))
        f, base = filesystem(self.path)
        for x in () if self.extend else self.old:
            f.delete_file(f"{base}/{x['file']}")

    def abort(self, messages: list[WrittenShards | None]) -> None:
        f, base = filesystem(self.path)
        for m in messages:
            for _, name, _ in m.shards if m else ():
                f.delete_file(f"{base}/{name}")


def write_shards(
    docs: DataFrame, path: str, shard_tokens: int = SHARD_TOKENS, overwrite: bool = False, extend: bool = False
) -> None:
    """Write documents ``(start, ids, doc_no)`` as int32 shards in stream order, ``extend`` after those already there.

    Every task gets whole shards of a fixed size, however long documents or sources are, and there are
    as many tasks as shards, whatever the session's shuffle setting.
    """
    docs.sparkSession.dataSource.register(TokenShards)
    n_shards = (docs.agg(F.max("start")).first()[0] or 0) // shard_tokens + 1
    (
        pieces(docs, shard_tokens, overlap=0)
        .select(F.col("window_id").alias("shard"), "s", "piece")
        .repartition(n_shards, "shard")
        .sortWithinPartitions("shard", "s")
        .write.format("token_shards").option("extend", str(extend).lower())
        .mode("overwrite" if overwrite else "append")
        .save(path)
    )


def shard_stream(spark: SparkSession, path: str, range_tokens: int = RANGE_TOKENS) -> DataFrame:
    """``(pos, id)`` of the shards as they are added."""
    spark.dataSource.register(TokenShards)
    return spark.readStream.format("token_shards").option("range_tokens", range_tokens).load(path)


def read_shards(spark: SparkSession, path: str, range_tokens: int = RANGE_TOKENS) -> DataFrame:
    spark.dataSource.register(TokenShards)
    return spark.read.format("token_shards").option("range_tokens", range_tokens).load(path)

"""Encoding, packing, epoch plans, tokenizer training and token files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from grainmill.constants import VOCAB_SIZE, WINDOW
from grainmill.functions.arrays import append_token, cut_at_stop, last_n
from grainmill.functions.text import one_line
from grainmill.operators import bpe_train, codec, epochs, mixture, packing, recipes
from grainmill.operators.vocabulary import N_SPECIAL, Vocabulary
from grainmill.plans.build import epoch_plan, training_windows
from grainmill.plans.catalog import BASE, BYTE_ID, PLACED, RAW, bytes_of, kept_sql, query, rounded
from grainmill.plans.corpus_queries import WHOLE, build
from grainmill.session import scratch_path, stage
from grainmill.sources import tables
from grainmill.sources.token_shards import read_shards, shard_stream, write_shards
from grainmill.sources.vocab_files import learn_once, load_vocabulary, merge_table, save_vocabulary, vocab_table

WORLD = 3


def digest(ids: Column) -> Column:
    """MD5 of the ids joined by commas; empty for no ids."""
    return F.md5(F.array_join(ids.cast("array<string>"), ","))


ENCODED = f"""encoded as (
  select source, ord, {BYTE_ID} as id, i from (
    select source, ord, unnest(bytes) as b, generate_subscripts(bytes, 1) as i
    from (select source, ord, {bytes_of('text')} as bytes from base))
)"""


@query(
    "encode_bytes",
    f"""with {RAW}, {BASE}, {ENCODED}
        select source, ord, cast(count(*) as int) as n_tokens, md5(string_agg(cast(id as varchar), ',' order by i)) as digest
        from encoded group by source, ord""",
)
def encode_bytes(spark, d):
    docs = recipes.prepare(tables.raw_corpus(spark, d), "base")
    ids = docs.select("source", "ord", codec.ByteCodec().encode(F.col("text")).alias("ids"))
    return ids.select("source", "ord", F.size("ids").alias("n_tokens"), digest(F.col("ids")).alias("digest"))


@query(
    "append_end_token",
    f"""with {RAW}, {BASE}, {ENCODED}
        select source, ord, cast(count(*) + 1 as int) as n_tokens,
          md5(string_agg(cast(id as varchar), ',' order by i) || ',4') as digest
        from encoded group by source, ord""",
)
def append_end(spark, d):
    docs = recipes.prepare(tables.raw_corpus(spark, d), "base")
    ids = docs.select("source", "ord", append_token(codec.ByteCodec().encode(F.col("text"))).alias("ids"))
    return ids.select("source", "ord", F.size("ids").alias("n_tokens"), digest(F.col("ids")).alias("digest"))


@query("decode_bytes", "select doc_id, text from documents")
def decode_bytes(spark, d):
    c = codec.ByteCodec()
    ids = tables.table(spark, d, "documents").select("doc_id", c.encode(F.col("text")).alias("ids"))
    return ids.select("doc_id", c.decode(F.col("ids")).alias("text"))


@query(
    "context_tail",
    f"""with {RAW}, {BASE}, {ENCODED}, sized as (select *, count(*) over (partition by source, ord) as n from encoded)
        select source, ord, cast(least(n, {WINDOW}) as int) as n_tokens,
          md5(string_agg(cast(id as varchar), ',' order by i)) as digest
        from sized where i > n - {WINDOW} group by source, ord, n""",
)
def context_tail(spark, d):
    docs = recipes.prepare(tables.raw_corpus(spark, d), "base")
    ids = docs.select("source", "ord", last_n(codec.ByteCodec().encode(F.col("text"))).alias("ids"))
    return ids.select("source", "ord", F.size("ids").alias("n_tokens"), digest(F.col("ids")).alias("digest"))


# Cut at the first token of the sentence mark, whose byte id is the same in every vocabulary.
STOP = 5 + ord(".") - 33


@query(
    "cut_at_stop",
    """select doc_id, cast(case when contains(text, '.') then strlen(split_part(text, '.', 1)) + 1
         else strlen(text) end as int) as n_tokens from documents""",
)
def stop_cut(spark, d):
    ids = tables.table(spark, d, "documents").select("doc_id", codec.ByteCodec().encode(F.col("text")).alias("ids"))
    return ids.select("doc_id", F.size(cut_at_stop(F.col("ids"), STOP)).alias("n_tokens"))


@query(
    "tokenizer_audit",
    f"""with {RAW}, {BASE} select source, cast(sum(strlen(text)) as bigint) as tokens,
          cast(sum(length(text)) as bigint) as chars,
          round(cast(sum(length(text)) as double) / sum(strlen(text)) + 1e-9, 6) as chars_per_token
        from base group by source""",
)
def tokenizer_audit(spark, d):
    report = codec.audit(recipes.prepare(tables.raw_corpus(spark, d), "base"), codec.ByteCodec())
    return report.withColumn("chars_per_token", rounded("chars_per_token"))


# Packing

STREAM = f"""stream as (
  select start + i - 1 as pos, {BYTE_ID} as id, doc_no from (
    select start, doc_no, unnest(bytes) as b, generate_subscripts(bytes, 1) as i
    from (select start, doc_no, {bytes_of('text')} as bytes from placed))
  union all
  select start + n_tokens - 1, 4, doc_no from placed
),
size as (select count(*) as n from stream),
windowed as (
  select pos // {WINDOW} as window_id, pos, id, doc_no from stream
  union all
  select pos // {WINDOW} - 1, pos, id, doc_no from stream where pos % {WINDOW} = 0 and pos > 0
),
complete as (
  select * from windowed where window_id < greatest((select n - 1 from size) // {WINDOW}, 0)
)"""
PACKED = f"with {kept_sql('base', WHOLE)}, {PLACED}, {STREAM}"


def windows(spark: SparkSession, d: str) -> DataFrame:
    return training_windows(build(spark, d, "base", share=WHOLE))


@query(
    "pack_windows",
    f"""{PACKED} select cast(window_id as bigint) as window_id, cast(count(*) as int) as n_tokens,
          count(distinct doc_no) as n_docs, min(doc_no) as first_doc, max(doc_no) as last_doc,
          md5(string_agg(cast(id as varchar), ',' order by pos)) as digest
        from complete group by window_id""",
)
def pack_windows(spark, d):
    return windows(spark, d).select(
        "window_id", F.size("ids").alias("n_tokens"), "n_docs", "first_doc", "last_doc",
        digest(F.col("ids")).alias("digest"),
    )


@query(
    "next_token_pairs",
    f"""{PACKED} select cast(window_id as bigint) as window_id,
          md5(string_agg(cast(id as varchar), ',' order by pos) filter (where pos - window_id * {WINDOW} < {WINDOW})) as x_digest,
          md5(string_agg(cast(id as varchar), ',' order by pos) filter (where pos > window_id * {WINDOW})) as y_digest
        from complete group by window_id""",
)
def next_token_pairs(spark, d):
    pairs = packing.training_pairs(windows(spark, d))
    return pairs.select(
        "window_id", digest(F.col("x")).alias("x_digest"), digest(F.col("y")).alias("y_digest")
    )


@query(
    "window_count",
    f"""with {kept_sql('base', WHOLE)} select
          cast(greatest((sum(n_tokens) - 1) // {WINDOW}, 0) as bigint) as n_windows from kept""",
)
def window_count(spark, d):
    kept = build(spark, d, "base", share=WHOLE, stage_kept=False, narrow=True).kept
    return kept.agg(packing.window_count(F.sum("n_tokens"), WINDOW).alias("n_windows"))


@query(
    "token_positions",
    f"""with {kept_sql('base', WHOLE)}, {PLACED}
        select source, ord, cast(start as bigint) as start, cast(start + n_tokens - 1 as bigint) as last from placed""",
)
def token_positions(spark, d):
    placed = mixture.with_positions(build(spark, d, "base", share=WHOLE, narrow=True).kept)
    return placed.select("source", "ord", "start", (F.col("start") + F.col("n_tokens") - 1).alias("last"))


# Token files

FILE_SQL = f"""{PACKED} select cast(pos // 65536 as bigint) as block, count(*) as n_tokens,
      cast(min(pos) as bigint) as first_pos, md5(string_agg(cast(id as varchar), ',' order by pos)) as digest
    from stream group by pos // 65536"""


BLOCK = 65536


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens (pos, id) as slices (block, pos, ids) of one block each, wherever neighbours come one after the other."""
    for batch in batches:
        pos = batch.column("pos").to_numpy()
        cut = np.flatnonzero((np.diff(pos) != 1) | (pos[1:] % BLOCK == 0)) + 1
        edges = np.concatenate([[0], cut, [len(pos)]]) if len(pos) else np.zeros(1, np.int64)
        first = pos[edges[:-1]]
        ids = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), batch.column("id"))
        yield pa.RecordBatch.from_arrays([pa.array(first // BLOCK), pa.array(first), ids], ["block", "pos", "ids"])


def _blocks(tokens: DataFrame) -> DataFrame:
    """Digests of blocks of tokens; what is shuffled are slices, not tokens."""
    parts = F.sort_array(F.collect_list(F.struct("pos", "ids")))
    return (
        tokens.mapInArrow(_slices, "block bigint, pos bigint, ids array<int>")
        .groupBy("block")
        .agg(parts.alias("parts"))
        .select(
            "block",
            F.aggregate("parts", F.lit(0).cast("bigint"), lambda n, p: n + F.size(p["ids"])).alias("n_tokens"),
            F.get(F.col("parts.pos"), F.lit(0)).alias("first_pos"),
            digest(F.flatten(F.col("parts.ids"))).alias("digest"),
        )
    )


@query("token_file", FILE_SQL)
def token_file(spark, d):
    """The token stream written as int32 shards and scanned back in byte ranges."""
    path = scratch_path(spark, "shards")
    write_shards(build(spark, d, "base", share=WHOLE).stream(), path)
    return _blocks(read_shards(spark, path))


@query("token_file_stream", FILE_SQL)
def token_file_stream(spark, d):
    """The token stream added in three parts, each read as it arrives."""
    stream = build(spark, d, "base", share=WHOLE).stream()
    path, out, log = (scratch_path(spark, x) for x in ("shards", "arrived", "arrived-log"))
    n = stream.agg(F.max("doc_no")).first()[0] or 0
    for i in range(3):
        part = stream.where((F.col("doc_no") >= n * i // 3) & ((F.col("doc_no") < n * (i + 1) // 3) | F.lit(i == 2)))
        first = part.agg(F.min("start")).first()[0] or 0
        write_shards(part.withColumn("start", F.col("start") - first), path, extend=True)
        (
            shard_stream(spark, path).writeStream.format("parquet").option("checkpointLocation", log)
            .trigger(availableNow=True).start(out).awaitTermination()
        )
    return _blocks(spark.read.schema("pos bigint, id int").parquet(out))


# Epoch plans. Window ids come from the packed stream's size.

WINDOW_IDS = f"""with {kept_sql('base', WHOLE)},
ids as (
  select cast(unnest(range(cast(greatest((sum(n_tokens) - 1) // {WINDOW}, 0) as bigint))) as bigint) as window_id from kept
),
epochs as (
  select epoch, window_id, row_number() over (partition by epoch order by k, window_id) - 1 as idx,
    count(*) over (partition by epoch) as n
  from (select e.epoch, window_id, md5('7-' || e.epoch || '-' || window_id) as k
        from ids, (select cast(unnest(range(3)) as int) as epoch) e)
),
padded as (
  select epoch, window_id, idx, n, unnest(range(idx, cast((n + {WORLD} - 1) // {WORLD} * {WORLD} as bigint), n)) as pos
  from epochs
),
sharded as (
  select epoch, window_id, idx, cast(pos % {WORLD} as int) as rank, pos // {WORLD} as slot from padded
)"""


def window_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of the complete windows: they follow from the number of tokens, so no text or id is moved."""
    kept = build(spark, d, "base", share=WHOLE, stage_kept=False, narrow=True).kept
    n = kept.agg(packing.window_count(F.sum("n_tokens"), WINDOW).alias("n")).first()["n"]
    return spark.range(n or 0).withColumnRenamed("id", "window_id")


def md5_plan(spark: SparkSession, d: str) -> DataFrame:
    return epoch_plan(window_ids(spark, d), WORLD, seed=7, hash_name="md5")


@query("shuffle_epochs", f"{WINDOW_IDS} select epoch, window_id, idx from epochs")
def shuffle_epochs(spark, d):
    return epochs.shuffle_epochs(window_ids(spark, d), seed=7, hash_name="md5")


@query("shuffle_epochs_xxhash")
def shuffle_epochs_xxhash(spark, d):
    return epochs.shuffle_epochs(window_ids(spark, d), seed=7)


@query(
    "permuted_epochs",
    f"""{WINDOW_IDS.split("epochs as (")[0].rstrip().rstrip(",").replace("with ", "with recursive ", 1)},
        size as (select count(*) as n from ids),
        moving as (
          select cast(e as int) as epoch, window_id, window_id as x, 0 as r from ids, (select unnest(range(3)) as e)
          union all
          select epoch, window_id, case when substr(md5('7-' || epoch || '-' || r || '-' || greatest(x, other)), 32, 1)
              in ('1', '3', '5', '7', '9', 'b', 'd', 'f') then other else x end, r + 1
          from (select *, (cast('0x' || substr(md5('7-' || epoch || '-' || r), 1, 15) as bigint) % n - x + n) % n as other
            from moving, size where r < {epochs.ROUNDS}))
        select epoch, window_id, x as idx from moving where r = {epochs.ROUNDS}""",
)
def permuted_epochs(spark, d):
    """Places by a keyed bijection: arithmetic on the id alone."""
    ids = window_ids(spark, d)
    return epochs.permuted_epochs(ids, ids.count(), seed=7)


@query("rank_shards", f"{WINDOW_IDS} select * from sharded")
def rank_shards(spark, d):
    return md5_plan(spark, d).select("epoch", "window_id", "idx", "rank", "slot")


@query(
    "batches",
    f"{WINDOW_IDS} select epoch, rank, slot // 8 as batch, count(*) as n, cast(sum(window_id * (slot % 8 + 1)) as bigint) as checksum from sharded group by all",
)
def batches(spark, d):
    return (
        md5_plan(spark, d)
        .groupBy("epoch", "rank", "batch")
        .agg(F.count("*").alias("n"), F.sum(F.col("window_id") * (F.col("place") + 1)).alias("checksum"))
    )


@query(
    "accumulation_groups",
    f"""{WINDOW_IDS} select epoch, rank, slot // 8 // 16 as "group", count(*) as n_windows,
          max((slot // 8 + 1) % 16 = 0) as has_step from sharded group by all""",
)
def accumulation_groups(spark, d):
    return (
        md5_plan(spark, d)
        .groupBy("epoch", "rank", "group")
        .agg(F.count("*").alias("n_windows"), F.max("is_boundary").alias("has_step"))
    )


@query(
    "plan_numbers",
    f"""{WINDOW_IDS}, a as (select count(*) as n_windows, (count(*) + {WORLD} - 1) // {WORLD} as per_rank from ids),
        b as (select *, (per_rank + 7) // 8 as n_batches from a)
        select n_windows, per_rank, n_batches, n_batches * 3 // 16 as total_steps,
          n_batches // 16 as steps_per_epoch, 5 // nullif(n_batches // 16, 0) as start_epoch from b""",
)
def plan_numbers(spark, d):
    return epochs.plan_numbers(window_ids(spark, d), WORLD, resume_step=5)


@query(
    "plan_window_lookup",
    f"""{PACKED}, sums as (
          select window_id, md5(string_agg(cast(id as varchar), ',' order by pos)) as digest
          from complete group by window_id),
        shuffled as (
          select cast(epoch as int) as epoch, window_id, digest, row_number() over (
            partition by epoch order by md5('7-' || epoch || '-' || cast(window_id as bigint)), window_id) - 1 as idx
          from sums, (select unnest(range(3)) as epoch))
        select epoch, idx, cast(window_id as bigint) as window_id, digest from shuffled""",
)
def plan_window_lookup(spark, d):
    """Three epochs of windows, which are bucketed once and not shuffled again."""
    packed = packing.bucketed(windows(spark, d).select("window_id", "ids"))
    plan = epochs.shuffle_epochs(packed.select("window_id"), 3, seed=7, hash_name="md5")
    found = epochs.lookup_windows(plan, packed)
    return found.select("epoch", "idx", "window_id", digest(F.col("ids")).alias("digest"))


# Tokenizer

RE2_SPACE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
RE2_WORD = (
    r"''s|''t|''re|''ve|''m|''ll|''d| ?\p{L}+| ?\p{N}+| ?[^\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}"
    r"\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\p{L}\p{N}]+|" + RE2_SPACE + "+"
)


@query(
    "pretoken_counts",
    # No look-ahead in this engine: a run of spaces before a word is cut before its last space instead.
    f"""with lines as (
          select regexp_replace(replace(text, chr(10), ' ') || chr(10),
            '({RE2_SPACE})({RE2_SPACE}[^\\s])', '\\1' || chr(57344) || '\\2', 'g') as line from documents),
        parts as (select unnest(string_split(line, chr(57344))) as part from lines)
        select w, count(*) as cnt from (select unnest(regexp_extract_all(part, '{RE2_WORD}')) as w from parts)
        group by w""",
)
def pretoken_counts(spark, d):
    lines = tables.table(spark, d, "documents").select(one_line(F.col("text")).alias("line"))
    return bpe_train.word_counts(lines)


@query(
    "pair_counts",
    """with words as (
         select w, count(*) as cnt from (select unnest(string_split(replace(text, chr(10), ' '), ' ')) as w from documents)
         where length(w) >= 2 group by w),
       pairs as (
         select substr(w, cast(i as bigint), 2) as pair, cnt
         from (select w, cnt, unnest(range(1, length(w))) as i from words))
       select pair, cast(sum(cnt) as bigint) as cnt from pairs group by pair""",
)
def pair_counts(spark, d):
    words = (
        tables.table(spark, d, "documents")
        .select(F.explode(F.split(one_line(F.col("text")), " ")).alias("w"))
        .where(F.length("w") >= 2)
        .groupBy("w")
        .agg(F.count("*").alias("cnt"))
    )
    return bpe_train.pair_counts(words)


def trained(spark: SparkSession, d: str, size: int = VOCAB_SIZE) -> Vocabulary:
    """The vocabulary learnt from all documents, once for each version of their table."""
    docs = tables.table(spark, d, "documents")
    lines = docs.select(one_line(F.col("text")).alias("line"))
    return learn_once(docs, str(size), lambda: bpe_train.train(lines, size))


@query("train_bpe")
def train_bpe(spark, d):
    return trained(spark, d).merge_table(spark)


@query("saved_merges")
def saved_merges(spark, d):
    path = scratch_path(spark, "vocabulary")
    save_vocabulary(spark, trained(spark, d), path)
    return merge_table(spark, path)


@query("loaded_vocabulary")
def loaded_vocabulary(spark, d):
    path = scratch_path(spark, "vocabulary")
    save_vocabulary(spark, trained(spark, d), path)
    loaded = load_vocabulary(spark, path)
    docs = tables.table(spark, d, "documents")
    used = codec.BpeCodec(spark, loaded).uses(docs)
    return vocab_table(spark, path).join(used, "id", "left").select("id", "piece", F.coalesce("uses", F.lit(0)).alias("uses"))


@query("encode_bpe")
def encode_bpe(spark, d):
    c = codec.BpeCodec(spark, trained(spark, d))
    docs = recipes.prepare(tables.raw_corpus(spark, d), "base")
    return docs.select("source", "ord", c.encode(F.col("text")).alias("ids"))


@query(
    "decode_bpe",
    f"with {RAW}, {BASE} select source, ord, text from base",
)
def decode_bpe(spark, d):
    """Encoding and decoding gives the text back, markers included, as none is registered on reload."""
    c = codec.BpeCodec(spark, trained(spark, d))
    docs = recipes.prepare(tables.raw_corpus(spark, d), "base")
    ids = docs.select("source", "ord", c.encode(F.col("text")).alias("ids"))
    return ids.select("source", "ord", c.decode(F.col("ids")).alias("text"))


@query(
    "decode_bpe_atomic",
    f"""with {RAW}, {BASE} select source, ord,
          replace(replace(replace(text, '<|problem|>', ''), '<|step|>', ''), '<|end|>', '') as text from base""",
)
def decode_bpe_atomic(spark, d):
    """With registered markers, decoding skips them."""
    c = codec.BpeCodec(spark, trained(spark, d), "atomic")
    docs = recipes.prepare(tables.raw_corpus(spark, d), "base")
    ids = docs.select("source", "ord", c.encode(F.col("text")).alias("ids"))
    return ids.select("source", "ord", c.decode(F.col("ids")).alias("text"))


@query("build_report_bpe")
def build_report_bpe(spark, d):
    return build(spark, d, "base", codec.BpeCodec(spark, trained(spark, d)), narrow=True).report()


@query("tokenizer_audit_bpe")
def tokenizer_audit_bpe(spark, d):
    c = codec.BpeCodec(spark, trained(spark, d), "atomic")
    return codec.audit(recipes.prepare(tables.raw_corpus(spark, d), "base"), c)


# The same operators with a vocabulary of SMALL entries, learnt from the same documents: few enough merges for a loop in SQL.

SMALL = 300


def _symbols_sql(w: str) -> str:
    return f"array_to_string(list_transform({bytes_of(w)}, lambda b: chr(256 + {BYTE_ID})), '')"


def _spelled_sql(piece: str) -> str:
    """A piece in stand-in characters; byte pieces are numbered in the order of these."""
    stand_in = """case when c < 355 then c - 228 when c < 367 then c - 194 else c - 193 end"""
    return f"""array_to_string(list_transform(list_transform(string_split({piece}, ''), lambda x: unicode(x)),
      lambda c: chr(cast({stand_in} as int))), '')"""


# Symbols are characters, symbol id + 256. A step merges the most frequent pair in all distinct pre-tokens.
LEARNT = f"""with recursive lines as (
  select doc_id, source, text,
    regexp_replace(replace(text, chr(10), ' ') || chr(10), '({RE2_SPACE})({RE2_SPACE}[^\\s])', '\\1' || chr(57344) || '\\2', 'g') as line
  from documents),
counted as (
  select w, count(*) as cnt
  from (select unnest(regexp_extract_all(part, '{RE2_WORD}')) as w
    from (select unnest(string_split(line, chr(57344))) as part from lines))
  group by w),
learning as (
  select 0 as step, '' as pair, '' as symbol, '' as a, '' as b,
    list_transform(range(256), lambda i: chr(cast(261 + i as int))) as pieces,
    (select list({{'w': s, 'n': cnt}}) from (select {_symbols_sql('w')} as s, cnt from counted) where length(s) >= 2) as words
  union all
  select step + 1, pair, chr(cast(260 + place as int)), a, b, if(place > len(pieces), list_append(pieces, a || b), pieces),
    list_transform(words, lambda x: {{'w': replace(x.w, pair, chr(cast(260 + place as int))), 'n': x.n}})
  from (
    select *, coalesce(nullif(list_position(pieces, a || b), 0), len(pieces) + 1) as place
    from (
      select *, pieces[unicode(pair[1]) - 260] as a, pieces[unicode(pair[2]) - 260] as b
      from (
        select step, pieces, words, (
          select p from (
            select substr(x.w, i, 2) as p, x.n as n from (
              select x, unnest(range(1, length(x.w))) as i from (select unnest(l.words) as x)))
          group by p having sum(n) >= 2 order by sum(n) desc, p limit 1) as pair
        from learning l where len(pieces) < {SMALL - N_SPECIAL}))
    where pair is not null)
),
merges as (select list({{'p': pair, 's': symbol}} order by step) as steps from learning where step > 0),
pieces as (select pieces from learning order by step desc limit 1)"""

# Every pre-token of every document, without the newline a line ends in, with its symbols after all merges.
SMALL_ENCODED = f"""{LEARNT},
cut as (
  select doc_id, source, text,
    regexp_replace(replace(text, chr(10), ' '), '({RE2_SPACE})({RE2_SPACE}[^\\s])', '\\1' || chr(57344) || '\\2', 'g') as line
  from documents),
parts as (select doc_id, unnest(string_split(line, chr(57344))) as part, generate_subscripts(string_split(line, chr(57344)), 1) as i from cut),
places as (
  select doc_id, i, unnest(ws) as w, generate_subscripts(ws, 1) as k
  from (select doc_id, i, regexp_extract_all(part, '{RE2_WORD}') as ws from parts)),
coded as (
  select w, list_reduce(steps, lambda acc, x: replace(acc, x.p, x.s), {_symbols_sql('w')}) as s
  from (select distinct w from places), merges),
encoded as (select doc_id, string_agg(s, '' order by i, k) as s from places join coded using (w) group by doc_id),
docs as (select d.doc_id, d.source, replace(d.text, chr(10), ' ') as text, coalesce(e.s, '') as s
  from documents d left join encoded e using (doc_id) where d.text is not null)"""

SMALL_IDS = f"""{SMALL_ENCODED}
select doc_id, cast(length(s) as int) as n_tokens,
  md5(array_to_string(list_transform(string_split(s, ''), lambda c: if(c = '', '', cast(unicode(c) - 256 as varchar))), ',')) as digest
from docs"""


def small_codec(spark: SparkSession, d: str) -> codec.BpeCodec:
    return codec.BpeCodec(spark, trained(spark, d, SMALL))


def _small_docs(spark: SparkSession, d: str) -> DataFrame:
    docs = tables.table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", "source", one_line(F.col("text")).alias("text"))


@query(
    "bpe_small_merges",
    f"""{LEARNT} select cast(step - 1 as int) as rank, {_spelled_sql('a')} as "left", {_spelled_sql('b')} as "right"
        from learning where step > 0""",
)
def bpe_small_merges(spark, d):
    path = scratch_path(spark, "vocabulary")
    save_vocabulary(spark, trained(spark, d, SMALL), path)
    return merge_table(spark, path)


@query("bpe_small_ids", SMALL_IDS)
def bpe_small_ids(spark, d):
    ids = _small_docs(spark, d).select("doc_id", small_codec(spark, d).encode(F.col("text")).alias("ids"))
    return ids.select("doc_id", F.size("ids").alias("n_tokens"), digest(F.col("ids")).alias("digest"))


@query("bpe_small_ids_joined", SMALL_IDS)
def bpe_small_ids_joined(spark, d):
    """Encoded by a dictionary of all distinct pre-tokens, joined back."""
    ids = codec.encode_by_dictionary(_small_docs(spark, d), small_codec(spark, d), ["doc_id"])
    return ids.select("doc_id", F.size("ids").alias("n_tokens"), digest(F.col("ids")).alias("digest"))


@query(
    "bpe_small_tokens",
    f"""{SMALL_ENCODED}
        select doc_id, md5(array_to_string(list_transform(string_split(s, ''),
          lambda y: if(y = '', '', {_spelled_sql('p.pieces[unicode(y) - 260]')})), ' ')) as tokens
        from docs, pieces p""",
)
def bpe_small_tokens(spark, d):
    """The tokens of each text, spelled out."""
    c = small_codec(spark, d)
    pieces = codec.token_list(c.encode(F.col("text")), c.vocab)
    return _small_docs(spark, d).select("doc_id", F.md5(F.array_join(pieces, " ")).alias("tokens"))


@query(
    "bpe_small_vocabulary",
    f"""{SMALL_ENCODED},
        used as (select c, count(*) as uses from (select unnest(string_split(s, '')) as c from docs) where c <> '' group by c)
        select cast(i + 4 as int) as id, {_spelled_sql('pieces[i]')} as piece, coalesce(uses, 0) as uses
        from (select pieces, unnest(range(1, len(pieces) + 1)) as i from pieces) left join used on unicode(c) = i + 260""",
)
def bpe_small_vocabulary(spark, d):
    """The saved vocabulary, read back, with how often each merged or byte token is used."""
    path = scratch_path(spark, "vocabulary")
    save_vocabulary(spark, trained(spark, d, SMALL), path)
    c = codec.BpeCodec(spark, load_vocabulary(spark, path))
    used = c.uses(_small_docs(spark, d))
    table = vocab_table(spark, path).where(F.col("id") >= N_SPECIAL)
    return table.join(used, "id", "left").select("id", "piece", F.coalesce("uses", F.lit(0)).alias("uses"))


@query(
    "bpe_small_audit",
    f"""{SMALL_ENCODED} select source, cast(sum(length(s)) as bigint) as tokens, cast(sum(length(text)) as bigint) as chars,
          round(sum(length(text)) / nullif(sum(length(s)), 0) + 1e-9, 6) as chars_per_token from docs group by source""",
)
def bpe_small_audit(spark, d):
    return codec.audit(_small_docs(spark, d), small_codec(spark, d)).withColumn("chars_per_token", rounded("chars_per_token"))

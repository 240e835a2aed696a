"""The registered queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from grainmill.llm import (
    bpe_codec, chosen_path, content_sort, fair_mix, hard_negatives, katz, line_dedup, merkle, phrase_prints,
    quality_rules, rendezvous, secret_scan, substring_dedup,
)
from grainmill.llm.common import documents

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "lang", "source", "text")
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return quality_rules.apply_rules(docs).select("doc_id", *counts, "base_failed", "kept")


@query
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == list(secret_scan.KINDS).index(k)))
    return secret_scan.secrets(documents(spark, sf_dir)).select(
        "doc_id", *[count(k).cast("bigint").alias(f"n_{k}") for k in secret_scan.BASE],
        F.sha2(secret_scan.written(F.col("base")), 256).alias("base_sha256"),
        secret_scan.written(F.col("spans")).alias("spans"),
    )


def _secret_sql() -> str:
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    tests = {
        "assign": "length(value) >= 8", "access": "length(m) >= 16",
        "blob": "regexp_matches(m, '[0-9]') and regexp_matches(m, '[a-z]') and regexp_matches(m, '[A-Z]')",
    }
    scans = "\nunion all\n".join(
        f"""select rid, {n} as kind, '{name}' as name, '{role}' as role,
  cast(sum(length(g) + length(m)) over (partition by rid order by i) - length(m) as bigint) as start,
  cast(sum(length(g) + length(m)) over (partition by rid order by i) as bigint) as stop, m, value
from (select rid, unnest(regexp_extract_all(text, {quote(p)})) as m,
  unnest(regexp_extract_all(text, {quote(p)}, {2 if name == 'assign' else 0})) as value,
  unnest(string_split_regex(text, {quote(p)})[:-2]) as g,
  unnest(range(len(regexp_extract_all(text, {quote(p)})))) as i from t)
qualify {tests.get(name, 'true')}"""
        for n, (name, (p, role, _)) in enumerate(secret_scan.KINDS.items())
    )
    completes = " or ".join(
        f"(a.role = '{r}' and b.role in ({', '.join(repr(o) for o in others)}))" for r, others in secret_scan.COMPLETES.items()
    )
    reach, base = secret_scan.REACH, len(secret_scan.BASE)
    return f"""with t as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
parts as ({scans}),
kept as (select * from parts where kind < {base} union all
  select * from parts a where kind >= {base} and exists (select 1 from parts b where a.rid = b.rid and ({completes})
    and (b.start between a.stop and a.stop + {reach} or b.stop between a.start - {reach} and a.start))),
per as (select rid, count(*) filter (where kind = 0) as n_assign, count(*) filter (where kind = 1) as n_access,
  count(*) filter (where kind = 2) as n_hex,
  string_agg(name || ':' || start || ':' || stop, ',' order by start, kind) filter (where kind < {base}) as base,
  string_agg(name || ':' || start || ':' || stop, ',' order by start, kind) as spans from kept group by rid)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from t left join per using (rid)"""


SQL["op2_secret_scan"] = _secret_sql()


@query
def op3_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_documents(documents(spark, sf_dir))


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@query
def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe_codec.encode_documents(documents(spark, sf_dir).select("doc_id", "text"), ranks_path())
    return bpe_codec.decode_documents(encoded, ranks_path(), digests=True)


@query
def op5_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fair_mix.mix(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )


SQL["op5_fair_mix"] = f"""with sized as (
  select doc_id, source, cast(len({WORDS_SQL}) as bigint) as size,
    md5('mix:' || coalesce(cast(doc_id as varchar), '')) as k, md5(coalesce(text, '')) as d
  from documents
),
sources as (
  select source, cast(sum(size) as bigint) as source_size,
    cast(1 + (row_number() over (order by source nulls last) - 1) % 3 as double) as w
  from sized group by source
),
levels as (
  select *, 3.0::double * source_size as cap,
    (sum(source_size) over () - coalesce(sum(3 * source_size) over (o rows between unbounded preceding and 1 preceding), 0))
      / sum(w) over (o rows between current row and unbounded following) as level
  from sources window o as (order by source_size / w, source nulls last)
),
targets as (
  select source, source_size, least(cap, w * coalesce(
    (select level from levels where cap > level * w order by source_size / w, source nulls last limit 1), cap / w)) as target
  from levels
),
served as (
  select s.*, t.source_size, t.target,
    sum(size) over (partition by s.source order by k, doc_id nulls last, d rows unbounded preceding) as served
  from sized s join targets t on s.source is not distinct from t.source
),
queue as (
  select *, (r * source_size + served)::double / target as finish
  from served, (values (0), (1), (2)) rounds(r) where size > 0 and target > 0
),
cut as (
  select coalesce(max(finish), -1) as last from (
    select finish, sum(size) over (order by finish range unbounded preceding) as upto from queue)
  where upto <= (select round(sum(target)) from targets)
)
select doc_id, size, source_size, target, cast(copies * size as bigint) as taken, cast(copies as bigint) as copies
from (
  select s.doc_id, s.size, s.source_size, s.target,
    (select count(*) from (values (0), (1), (2)) rounds(r)
     where s.size > 0 and s.target > 0 and (r * s.source_size + s.served)::double / s.target <= cut.last) as copies
  from served s, cut)"""


@query
def op6_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = documents(spark, sf_dir).select(
        "doc_id", (F.octet_length(text) + F.lit(16)).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    return rendezvous.shard(docs).select(
        "doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("bigint").alias("slot"), "grown_shard"
    )


@query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return substring_dedup.remove_repeats(docs, keep_text=False).withColumnRenamed("kept", "kept_sha256")


SQL["op7_substring_dedup"] = f"""with w as (select doc_id, {WORDS_SQL} as w from documents),
grams as (select doc_id, i, w[i:i + {substring_dedup.SPAN - 1}] as g
  from (select doc_id, w, unnest(range(1, len(w) - {substring_dedup.SPAN - 2})) as i from w)),
firsts as (select g, min(doc_id) as least from grams group by g),
gone as (select distinct doc_id, unnest(range(i, i + {substring_dedup.SPAN})) as i
  from grams join firsts using (g) where least < doc_id),
each as (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as i from w),
rest as (select doc_id, count(*) as n, string_agg(x, ' ' order by i) as kept
  from each anti join gone using (doc_id, i) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed,
  sha256(coalesce(kept, '')) as kept_sha256
from w left join rest using (doc_id)"""


@query
def op8_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.exact_groups(documents(spark, sf_dir), keep="largest")


SQL["op8_content_sort"] = """with t as (select doc_id, coalesce(text, '') as text from documents),
g as (select *, max(doc_id) over (partition by text) as keep_id, count(*) over (partition by text) as group_size,
  row_number() over (partition by text order by doc_id desc nulls last) as place from t)
select doc_id, keep_id, cast(group_size as bigint) as group_size, place = 1 as kept, sha256(text) as text_sha256 from g"""


@query
def op9_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_groups(documents(spark, sf_dir))


@query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


def _line_sql() -> str:
    edits, least = line_dedup.EDITS, line_dedup.MIN_CHARS
    # Some third of the shorter line occurs in the longer one, moved by at most the number of edits.
    thirds = " or ".join(
        f"substr(b.line, a.chars // 3 * {i} + 1 + {move}, a.chars // 3) = substr(a.line, a.chars // 3 * {i} + 1, a.chars // 3)"
        for i in range(3) for move in range(-edits, edits + 1)
    )
    return f"""with each as (
  select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos
  from documents where text is not null
),
worded as (select * from each where regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
lines as (select line, min((doc_id, pos)) as first, length(line) as chars from worded group by line),
sized as (select * from lines where chars >= {least}),
close as (
  select greatest(a.first, b.first) as first
  from sized a join (select *, unnest(range(chars - {edits}, chars + 1)) as other from sized) b on a.chars = b.other
  where (a.chars < b.chars or a.line < b.line) and ({thirds}) and levenshtein(a.line, b.line) <= {edits}
),
gone as (
  select doc_id, pos from worded join lines using (line)
  where (doc_id, pos) <> first or first in (select first from close)
),
kept as (
  select doc_id, count(*) as n, string_agg(line, chr(10) order by pos) as kept
  from each anti join gone using (doc_id, pos) group by doc_id
)
select d.doc_id, cast(coalesce(len(string_split(text, chr(10))), 0) as bigint) as n_lines,
  cast(coalesce(len(string_split(text, chr(10))) - coalesce(n, 0), 0) as bigint) as n_removed,
  sha256(coalesce(kept, '')) as kept_sha256
from documents d left join kept using (doc_id)"""


SQL["op10_line_dedup"] = _line_sql()


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.expr("if(vec_id % 7 = 0, (cast(label as bigint) + 1) % 10, label)")
    return hard_negatives.mine(rows, F.col("id") % 100 == 0, label=label)


SQL["op11_hard_negatives"] = """with t as (
  select row_number() over () as rid, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
scored as (
  select a.rid, a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, cast(list_dot_product(a.v, b.v) as bigint) as score
  from t a join t b on a.rid <> b.rid where a.vec_id % 100 = 0
),
positives as (
  select * from scored where same
  qualify row_number() over (partition by rid order by score desc, vec_id nulls last) <= 5
)
select p.anchor_id, p.vec_id as positive_id,
  cast(row_number() over (partition by p.rid, p.vec_id, p.score order by n.score desc, n.vec_id nulls last) as int) as rank,
  n.vec_id as negative_id, p.score as positive_score, n.score as negative_score
from positives p join scored n on n.rid = p.rid and not n.same and 30 * p.score <= 100 * n.score and 100 * n.score <= 90 * p.score
qualify rank <= 10"""


MANIFEST_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


@query
def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(*MANIFEST_FIELDS)
    altered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    other = merkle.leaf([more if c == "n_chars" else F.col(c) for c in MANIFEST_FIELDS])
    manifest = merkle.build(docs, "lang", "doc_id", MANIFEST_FIELDS, extra=F.when(altered, other))
    return merkle.witnesses(manifest).select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", merkle.proof(F.col("witness")).alias("proof_sha256"),
        merkle.fold(F.coalesce("extra", "leaf"), F.col("witness")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def _merkle_sql() -> str:
    field = lambda x: f"coalesce(strlen(cast({x} as varchar)) || ':' || cast({x} as varchar), '-')"
    leaf = lambda more: "sha256(" + " || ".join(field(c if c != "n_chars" else c + more) for c in MANIFEST_FIELDS) + ")"
    # crc32 by its polynomial, over at most 20 decimal digits
    crc = """list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(cast(doc_id as varchar), ''), lambda c: ascii(c)::ubigint)),
      lambda crc, c: list_reduce(list_prepend(xor(crc, c), range(8)::ubigint[]),
        lambda v, i: xor(v >> 1, if(v & 1 = 1, 3988292384::ubigint, 0::ubigint))))"""
    return f"""with recursive leaves as (
  select row_number() over () as rid, doc_id, lang, {leaf('')} as leaf,
    case when xor({crc}, 4294967295::ubigint) % 7 = 0 then {leaf(' + 1')} end as altered from documents),
placed as (
  select *, row_number() over (partition by lang order by doc_id nulls first, leaf, rid) - 1 as pos,
    count(*) over (partition by lang) as n from leaves),
tree as (
  select lang, 0 as level, pos, n, leaf as digest from placed
  union all
  select lang, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' order by pos))
  from tree where n > 1 group by lang, level, pos // 2, n),
subs as (
  select lang, digest as subroot, level as height, row_number() over (order by lang nulls first) - 1 as pos, count(*) over () as n
  from tree where n = 1),
tops as (
  select 0 as level, pos, n, subroot as digest from subs
  union all
  select level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' order by pos))
  from tops where n > 1 group by level, pos // 2, n),
top as (select digest as root, level as height from tops where n = 1),
paths as (
  select p.rid, l.level, xor(p.pos >> l.level, 1) as sib, (p.pos >> l.level) & 1 = 1 as leftward, p.lang
  from placed p join subs s on p.lang is not distinct from s.lang, lateral (select unnest(range(s.height)) as level) l),
lower as (
  select a.rid, a.level, a.leftward, coalesce(t.digest, '') as digest from paths a
  left join tree t on t.lang is not distinct from a.lang and t.level = a.level and t.pos = a.sib),
upper as (
  select s.lang, s.height + l.level as level, (s.pos >> l.level) & 1 = 1 as leftward, coalesce(t.digest, '') as digest
  from subs s, top, lateral (select unnest(range(top.height)) as level) l
  left join tops t on t.level = l.level and t.pos = xor(s.pos >> l.level, 1)),
witness as (
  select rid, level, leftward, digest from lower
  union all
  select p.rid, u.level, u.leftward, u.digest from placed p join upper u on p.lang is not distinct from u.lang),
proofs as (select rid, sha256(string_agg(digest, '' order by level)) as proof, max(level) as last from witness group by rid),
fold as (
  select rid, 0::bigint as level, coalesce(altered, leaf) as acc from placed
  union all
  select f.rid, f.level + 1, sha256(case when w.leftward then w.digest || f.acc else f.acc || w.digest end)
  from fold f join witness w on w.rid = f.rid and w.level = f.level),
folded as (select rid, arg_max(acc, level) as folded_root from fold group by rid)
select p.doc_id, p.leaf, s.subroot, top.root, coalesce(proof, sha256('')) as proof_sha256, folded_root,
  folded_root = top.root as verified
from placed p join subs s on p.lang is not distinct from s.lang join folded using (rid) left join proofs using (rid), top"""


SQL["op12_merkle"] = _merkle_sql()


@query
def op13_phrase_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrase_prints.compare_with_edits(documents(spark, sf_dir).select("doc_id", "text"))
    written = lambda c: F.lower(F.hex(c))
    return found.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", written("print").alias("fingerprint"),
        written("edited_print").alias("edited_fingerprint"), "near_edited", "near_next")

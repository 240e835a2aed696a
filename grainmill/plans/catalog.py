"""Registry of the queries and the SQL they are checked against, and shared SQL fragments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from grainmill.constants import BASE_WEIGHTS, CPT_WEIGHTS, WHITESPACE
from grainmill.sources.tables import DOMAINS, EVENT_TYPES, PLAIN_SOURCES, SLOTS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def rounded(c: str) -> Column:
    """Six decimals for comparison; the nudge decides exact halves alike in both engines."""
    return F.round(F.col(c) + 1e-9, 6).alias(c)


def sql_strip(x: str) -> str:
    return f"trim({x}, '{WHITESPACE}')"


def _list(items: list[str]) -> str:
    return "[" + ", ".join(f"'{i}'" for i in items) + "]"


CONFIG_STEP = 1 << 40

RAW = f"""raw as (
  select {_list(PLAIN_SOURCES)}[cast(substr(source, 4) as int) % 4 + 1] as source,
         doc_id as ord, text as head, cast(null as varchar) as tail
  from documents
  union all
  select case when u.conv_id % 2 = 0 then 'metamathqa' else 'gsm8k' end,
         u.conv_id * 1000 + u.turn, u.text, a.text
  from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1
  where u.role = 'user' and a.role = 'assistant'
  union all
  select 'arc', (item_id % 2) * {CONFIG_STEP} + item_id, string_split(text, '. ')[1],
         array_to_string(string_split(text, '. ')[2:], ' ')
  from benchmark
)"""

BASE = f"""base as (
  select source, ord, case source
    when 'tinystories' then '<|problem|>Continue the story:<|step|>' || head || '<|end|>'
    when 'openwebmath' then '<|problem|>Reason through this:<|step|>' || {sql_strip('head')} || '<|end|>'
    else '<|problem|>' || head || '<|step|>' || tail || '<|end|>' end as text
  from raw
  where source in ('tinystories', 'metamathqa', 'gsm8k', 'arc')
     or (source = 'openwebmath' and length({sql_strip('head')}) > 100)
)"""

CPT = f"""cpt as (
  select source, ord, case
    when source in ('metamathqa', 'gsm8k') then {sql_strip('head')} || chr(10) || {sql_strip('tail')} || '<|end|>'
    else {sql_strip('head')} || '<|end|>' end as text
  from raw
  where source in ('metamathqa', 'gsm8k')
     or (source = 'wikipedia' and length({sql_strip('head')}) >= 200)
     or (source = 'bookcorpus' and length({sql_strip('head')}) >= 100)
     or (source = 'tinystories' and length({sql_strip('head')}) >= 50)
)"""


def weights_sql(recipe: str) -> str:
    pairs = BASE_WEIGHTS if recipe == "base" else CPT_WEIGHTS
    rows = ", ".join(f"({i}, '{n}', cast({w} as double))" for i, (n, w) in enumerate(pairs))
    return f"weights(pos, name, weight) as (values {rows})"


def kept_sql(recipe: str, share: str) -> str:
    """CTEs ending in ``kept``: the budget prefix of every source, budget total = share of all tokens."""
    extra = 1 if recipe == "base" else 0
    return f"""{RAW}, {BASE if recipe == 'base' else CPT}, {weights_sql(recipe)},
total as (
  select cast(floor(sum(strlen(text) + {extra}) * cast({share} as double)) as bigint) as total from {recipe}
),
budgets as (
  select pos, name, cast(floor(cast(total as double) * weight) as bigint) as budget from weights, total
),
counted as (
  select d.source, b.pos, b.budget, d.ord, d.text, strlen(d.text) + {extra} as n_tokens,
    coalesce(sum(strlen(d.text) + {extra}) over w, 0) as cum_before,
    coalesce(count(*) over w, 0) as docs_before
  from {recipe} d join budgets b on b.name = d.source
  window w as (partition by d.source order by d.ord rows between unbounded preceding and 1 preceding)
),
kept as (select * from counted where cum_before < budget or docs_before = 0)"""


PLACED = """placed as (
  select *, coalesce(sum(n_tokens) over w, 0) as start, coalesce(count(*) over w, 0) as doc_no
  from kept window w as (order by pos, ord rows between unbounded preceding and 1 preceding)
)"""

# Token id of byte b: printable bytes first, then the others, after five reserved ids.
BYTE_ID = """(5 + case when b between 33 and 126 then b - 33 when b between 161 and 172 then b - 67
  when b between 174 and 255 then b - 68 when b <= 32 then 188 + b
  when b between 127 and 160 then b + 94 else 255 end)"""


def bytes_of(text: str) -> str:
    """List of the UTF-8 byte values of a text expression."""
    return f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: cast('0x' || x as integer))"


LOG = """numbered as (
  select user_id % 2 as run, value, event_type, ts,
    row_number() over (partition by user_id % 2 order by event_id) - 1 as rn
  from events
),
log as (
  select run, rn // 1024 as epoch, rn % 1024 as batch, value as loss, event_type = 'error' as skipped, ts
  from numbered
),
running as (
  select *, count(*) over w as seen, count(*) filter (where not skipped) over w as counted,
    sum(case when skipped then 0 else loss end) over w as total,
    (batch + 1) % 16 = 0 and not skipped as stepped
  from log window w as (partition by run, epoch order by batch)
),
stepping as (
  select *, sum(stepped::int) over (partition by run order by epoch, batch) as step,
    sum(stepped::int) over (partition by run, epoch order by batch) as epoch_steps
  from running
)"""

GENERATIONS = f"""generations as (
  select event_id // {SLOTS} as problem_id, cast(event_id % {SLOTS} as int) as sample_idx,
    case when event_id % {SLOTS} = 0 then 'greedy' else 'sample' end as mode,
    {_list(DOMAINS)}[(event_id // {SLOTS}) % 5 + 1] as domain,
    '<|problem|>q<|step|>s' || case when event_id % 5 = 0 then ''
      else '<|answer|> ' || event_type || ' <|end|>' end as output
  from events
),
cases as (
  select event_id // {SLOTS} as problem_id,
    'Which event closes case ' || (event_id // {SLOTS}) || '?' as problem,
    {_list(EVENT_TYPES)}[(event_id // {SLOTS}) % 5 + 1] as expected
  from events where event_id % {SLOTS} = 0
),
marked as (
  select *, contains(output, '<|step|>') as has_step, contains(output, '<|answer|>') as has_answer,
    contains(output, '<|end|>') as has_end,
    contains(output, '<|step|>') and contains(output, '<|answer|>') as ok
  from generations
),
answered as (
  select *, case when has_answer then nullif({sql_strip("split_part(split_part(output, '<|answer|>', -1), '<|end|>', 1)")}, '') end as answer
  from marked
),
votes as (
  select problem_id, answer, count(*) as c, min(sample_idx) as f
  from answered where mode = 'sample' and answer is not null group by all
),
voted as (
  select problem_id, answer as voted, c as votes from votes
  qualify row_number() over (partition by problem_id order by c desc, f) = 1
),
scored as (
  select c.problem_id, c.problem, c.expected, g.answer as greedy, v.voted,
    coalesce(contains(lower(g.answer), lower(c.expected)), false) as greedy_ok,
    coalesce(contains(lower(v.voted), lower(c.expected)), false) as voted_ok
  from cases c
  left join (select problem_id, answer from answered where mode = 'greedy') g using (problem_id)
  left join voted v using (problem_id)
)"""

CANDIDATES = """candidates as (
  select user_id as grp, event_id as item, cast(floor(value) as double) as score from events
)"""

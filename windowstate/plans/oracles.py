"""DuckDB SQL equivalents of the registered queries (independent set formulation; SURVEY Appendix A).

Times: `epoch_us(ts) // 1000` (DuckDB's epoch_ms rounds, Spark floors). Counts are cast to BIGINT."""

from __future__ import annotations

from windowstate.plans.stream_catalog import INGEST_WINDOW_MS, RESUME_SPLIT
from windowstate.plans.params import (CLEANUP_MS, DAY_MS, EPOCH_2024_MS, HOUR_MS, MISROUTED_PARTITIONS, MISSING_KEY_OFFSET,
                                      N_PARTITIONS, NOW_MS, REPLAY_AT_MS, REPLAY_BATCH, SEQ_PARALLELISM,
                                      SHORT_AT_MS, SHORT_CLEANUP_MS)

S = HOUR_MS
MS = "(epoch_us(ts) // 1000)"
M32 = 4294967295


def _mul(x: str, c: int) -> str:
    return f"((({x} * {c & 0xFFFF}) + ((({x} * {c >> 16}) & 65535) << 16)) & {M32})"


def _rotl(x: str, r: int) -> str:
    return f"((({x} << {r}) | ({x} >> {32 - r})) & {M32})"


def _xs(x: str, s: int) -> str:
    return f"xor({x}, {x} >> {s})"


def partition_sql(src: str, n: int, out: str = "partition", hash_out: str | None = None) -> str:
    """Wrap relation `src` (must have `key`) adding the routing partition (and optionally the hash). The hash's
    constants are written out here, apart from the code under test."""
    steps = [
        lambda x: _mul(x, 0xcc9e2d51), lambda x: _rotl(x, 15), lambda x: _mul(x, 0x1b873593), lambda x: _rotl(x, 13),
        lambda x: _mul(x, 0xe6546b64), lambda x: f"xor({x}, 4)", lambda x: _xs(x, 16),
        lambda x: _mul(x, 0x85ebca6b), lambda x: _xs(x, 13), lambda x: _mul(x, 0xc2b2ae35),
        lambda x: _xs(x, 16),
    ]
    rel = f"(select *, xor(key & {M32}, (key >> 32) & {M32}) as __h from ({src}) __s0)"
    for i, st in enumerate(steps):
        rel = f"(select * replace ({st('__h')} as __h) from {rel} __s{i + 1})"
    signed = f"(case when __h >= 2147483648 then __h - 4294967296 else __h end)"
    rel = f"(select * replace ({signed} as __h) from {rel} __sg)"
    pos = "(case when __h >= 0 then __h when __h <> -2147483648 then -__h else 0 end)"
    hash_col = f", {pos} as {hash_out}" if hash_out else ""
    return f"select * exclude (__h){hash_col}, cast({pos} % {n} as integer) as {out} from {rel} __sp"


COUNTS = f"""select {MS} - {MS} % {S} + {S} as window_end_ms, user_id as key, count(*) as n
from events group by all"""
WM = f"(select max({MS}) from events)"


ARRIVAL = "(event_id + (event_id*7919) % 500)"
ARRIVAL_B = f"({ARRIVAL} // ((select max({ARRIVAL}) from events) // 10 + 1))"


def _replay_ctes(batch: int, at_ms: int, delay: int, b_expr: str = ARRIVAL_B, drop: bool = False) -> str:
    # drop mode: a window fires once, in the streaming batch after the one whose watermark passes it, which still
    # counts its own rows
    log0 = ("select raw as fb, e, key, cast(sum(n) as bigint) as n from f where raw is not null and b <= raw + 1 "
            "group by 1,2,3") if drop else \
        "select fb, e, key, cast(sum(n) as bigint) as n from f where raw is not null group by 1,2,3"
    return f"""with ev as (select {MS} as ts_ms, user_id as key, {b_expr} as b from events),
bt as (select b, 1000*b as t, max(max(ts_ms)) over (order by b) as wm from ev group by b),
pre as (select b, ts_ms - ts_ms % {S} + {S} as e, key, count(*) as n from ev group by 1,2,3),
fe as (select e, min(bt.b) as fb from (select distinct e from pre) x join bt on bt.wm > x.e group by e),
f as (select pre.*, greatest(pre.b, fe.fb) as fb, fe.fb as raw from pre left join fe on pre.e = fe.e),
log0 as ({log0}),
log as ({partition_sql('select * from log0', N_PARTITIONS, 'p')}),
lf as (select * from log where fb <= {batch}),
ft as (select distinct p, lf.fb, bt.t from lf join bt on bt.b = lf.fb),
mk as (select *, case when t - lag(t) over (partition by p order by t, fb) > {delay} then 1 else 0 end as nw from ft),
se as (select *, sum(nw) over (partition by p order by t, fb rows between unbounded preceding and current row) as sid,
              max(t) over (partition by p) as lt from mk),
cu as (select p, fb, lt, sid, max(sid) over (partition by p) as msid from se),
cur as (select p, fb from cu where sid = msid and {at_ms} <= lt + {delay}),
lastf as (select lf.p, lf.e, max(lf.fb) as fb from lf join cur on lf.p = cur.p and lf.fb = cur.fb group by 1,2),
ret as (select lf.p, lf.e, lf.key, lf.n, lf.fb from lf join lastf on lf.p = lastf.p and lf.e = lastf.e and lf.fb = lastf.fb),
live as (select e, key, cast(sum(n) as bigint) as n from f where b <= {batch} and (raw is null or fb > {batch}) group by 1,2)
"""


def _ret_select(batch, at_ms, delay):
    return _replay_ctes(batch, at_ms, delay) + """select p as partition, e as window_end_ms, key, n, fb as fire_b from ret"""


REQUESTS = f"""select event_id as req_id, {MS} + (event_id % 3 - 1) * {S} as ts_ms,
  case when event_type = 'signup' then user_id + {MISSING_KEY_OFFSET} else user_id end as key from events"""


def _answers(state: str, extra: str = "") -> str:
    return f"""rq as (select *, ts_ms - ts_ms % {S} + {S} as window_end_ms from ({REQUESTS}) r0),
st as ({state})
select rq.req_id, rq.key, rq.window_end_ms, cast(coalesce(st.n, 0) as bigint) as n, st.n is not null as found{extra}
from rq left join st on rq.window_end_ms = st.window_end_ms and rq.key = st.key"""


def _strict(x: str) -> str:
    return f"(case when regexp_full_match({x}, '[+-]?[0-9]+') then try_cast({x} as bigint) end)"


def _parse(x: str) -> str:
    return f"coalesce({_strict(x)}, -1)"


PAIR = "'(' || cast(key as varchar) || ',' || cast(n as varchar) || ')'"

_Q14_LINE = f"""case event_id % 6
  when 0 then cast(user_id as varchar)
  when 1 then cast({MS} as varchar) || ',' || cast(user_id as varchar)
  when 2 then cast({MS} as varchar) || ',' || cast(user_id as varchar) || ',' || cast(event_id as varchar)
  when 3 then upper(event_type)
  when 4 then cast(user_id as varchar) || ','
  else ',' || cast(user_id as varchar) end"""

ORACLES: dict[str, str] = {
    "q01_tumbling_count": COUNTS,
    "q02_with_one": "select event_id, user_id as key, cast(1 as bigint) as one from events",
    "q03_emitted_pairs": f"select *, {PAIR} as pair from ({COUNTS}) c where window_end_ms < {WM}",
    "q04_open_windows": f"select * from ({COUNTS}) c where window_end_ms >= {WM}",
    "q05_close_boundary": f"select *, window_end_ms < ({WM} - {WM} % {S}) as closed from ({COUNTS}) c",
    "q06_fire_log": _replay_ctes(10**9, 0, 0) + "select fb as fire_b, p as partition, e as window_end_ms, key, n from log",
    "q07_fire_totals": _replay_ctes(10**9, 0, 0) + f"""
, fired as (select e, key, sum(n) as n from log group by 1,2),
lv as (select e, key, n from f where raw is null)
select coalesce(fired.e, lv2.e) as window_end_ms, coalesce(fired.key, lv2.key) as key,
  cast(coalesce(fired.n, 0) as bigint) as n_fired, cast(coalesce(lv2.n, 0) as bigint) as n_live,
  cast(coalesce(fired.n, 0) + coalesce(lv2.n, 0) as bigint) as n
from fired full join (select e, key, sum(n) as n from lv group by 1,2) lv2 on fired.e = lv2.e and fired.key = lv2.key""",
    "q08_retained_view": _ret_select(REPLAY_BATCH, REPLAY_AT_MS, CLEANUP_MS),
    "q09_lookup_join": "with " + _answers(COUNTS, """, case when st.n is not null
  then 'StateFound(key: ' || cast(rq.key as varchar) || ', value: ' || cast(st.n as varchar) || ')'
  else 'StateNotFound(key: ' || cast(rq.key as varchar) || ')' end as answer"""),
    "q10_lookup_now": f"""with c as ({COUNTS}),
rq as (select event_id as req_id, user_id as key, {WM} - {WM} % {S} + {S} as window_end_ms from events)
select rq.req_id, rq.key, rq.window_end_ms, cast(coalesce(c.n, 0) as bigint) as n, c.n is not null as found
from rq left join c on rq.window_end_ms = c.window_end_ms and rq.key = c.key""",
    "q11_lookup_live_retained": _replay_ctes(REPLAY_BATCH, REPLAY_AT_MS, CLEANUP_MS) + ", " + _answers(
        """select coalesce(l.e, r.e) as window_end_ms, coalesce(l.key, r.key) as key, coalesce(l.n, r.n) as n
           from live l full join (select e, key, n from ret) r on l.e = r.e and l.key = r.key"""),
    "q12_parse_long": f"""with t as (
  select 'props' as src, event_id as id, props as text from events
  union all select 'props_value', event_id, substring(props, 7, length(props) - 7) from events
  union all select 'props_spaced', event_id, substring(props, 6, length(props) - 6) from events
  union all select 'user', event_id, cast(user_id as varchar) from events
  union all select 'user_plus', event_id, '+' || cast(user_id as varchar) from events
  union all select 'user_frac', event_id, cast(user_id as varchar) || '.5' from events
  union all select 'neg_id', event_id, '-' || cast(event_id as varchar) from events
  union all select 'event_type', event_id, event_type from events
  union all select 'empty', event_id, '' from events
  union all select 'c_name', c_custkey, c_name from customer
  union all select 'c_overflow', c_custkey, cast(c_custkey as varchar) || '0000000000000000000' from customer)
select src, id, text, {_parse('text')} as key from t""",
    "q13_text_roundtrip": f"""with v as (
  select event_id, 0 as variant, user_id as v from events
  union all select event_id, 1, -event_id from events
  union all select event_id, 2, event_id * 1000000000000 from events
  union all select event_id, 3, -(event_id * 1000000000000) - 1 from events)
select event_id, variant, v, cast(v as varchar) as text, {_parse('cast(v as varchar)')} as back from v""",
    "q14_request_parse": f"""with r as (select event_id as req_id, {_Q14_LINE} as line from events),
t as (select *, lower(line) as tok, regexp_replace(lower(line), ',+$', '') as tr from r),
p as (select *, string_split(tr, ',') as parts,
        case when tok = '' then 1 when tr = '' then 0 else len(string_split(tr, ',')) end as np from t),
q as (select *, {_strict('parts[1]')} as p0, {_strict('parts[2]')} as p1 from p),
c as (select *, case when tok in ('stop', 'quit') then 'stop'
   when (np = 1 and p0 is null) or (np = 2 and (p0 is null or p1 is null)) then 'invalid' else 'lookup' end as command from q)
select req_id, line, command,
  case when command = 'lookup' then (case when np = 1 then {NOW_MS} when np = 2 then p0 else -1 end) end as ts_ms,
  case when command = 'lookup' then (case when np = 1 then p0 when np = 2 then p1 else -1 end) end as key
from c""",
    "q15_align_negative": f"""with s as (select event_id, {MS} - {EPOCH_2024_MS + 5 * S} as shifted_ms from events)
select event_id, shifted_ms, shifted_ms - shifted_ms % {S} as window_start_ms,
  shifted_ms - shifted_ms % {S} + {S} as window_end_ms from s""",
    "q16_key_partition": partition_sql(
        """select distinct key from (select user_id as key from events
           union all select -user_id - 1 from events
           union all select event_id * 2654435761 - 4611686018427387904 from events)""",
        N_PARTITIONS, "partition", "hash"),
    "q17_partition_skew": f"""select partition, count(*) as rows, count(distinct key) as keys from
  ({partition_sql('select user_id as key from events', N_PARTITIONS)}) x group by partition""",
    "q18_partition_audit": f"""with s as ({partition_sql(COUNTS, MISROUTED_PARTITIONS)}),
a as ({partition_sql('select * from s', N_PARTITIONS, 'expected_partition')})
select * from a where partition <> expected_partition""",
    "q19_key_sequence": f"""with k as (select count(distinct user_id) as n from events)
select cast(event_id % {SEQ_PARALLELISM} as integer) as subtask, event_id // {SEQ_PARALLELISM} as idx,
  ((event_id % {SEQ_PARALLELISM}) * (k.n // {SEQ_PARALLELISM}) + event_id // {SEQ_PARALLELISM}) % k.n as key from events, k""",
    "q20_stream_count": _replay_ctes(10**9, 0, 0) + """select e as window_end_ms, key, cast(sum(n) as bigint) as n
from f where raw is not null and b <= raw + 1 group by 1, 2""",
    "q21_state_read": _replay_ctes(10**9, 0, 0) + """select e as window_end_ms, key, cast(sum(n) as bigint) as n
from f where raw is null group by 1, 2""",
    "q22_state_history": _replay_ctes(REPLAY_BATCH, 0, 0) + f"""select e as window_end_ms, key, cast(sum(n) as bigint) as n
from f where b <= {REPLAY_BATCH} and (raw is null or raw >= {REPLAY_BATCH}) group by 1, 2""",
    "q23_resume": _replay_ctes(10**9, 0, 0) + f"""select e as window_end_ms, key, cast(sum(n) as bigint) as n
from f where raw is not null and b <= raw + (case when raw = {RESUME_SPLIT} then 0 else 1 end) group by 1, 2""",
    "q25_ingestion_time": f"""with a as (select user_id as key, 1000 * {ARRIVAL_B} as t from events)
select t - t % {INGEST_WINDOW_MS} + {INGEST_WINDOW_MS} as window_end_ms, key, count(*) as n from a group by 1, 2""",
    "q26_state_size": f"""select window_end_ms, count(*) as num_keys from ({COUNTS}) c
where window_end_ms >= {WM} group by window_end_ms""",
    "q27_retention_short": _ret_select(REPLAY_BATCH, SHORT_AT_MS, SHORT_CLEANUP_MS),
}

ORACLES["q24_stream_refire"] = ORACLES["q06_fire_log"]

_LAST_B = "(select max(b) from ev)"
ORACLES["q28_lookup_stream"] = _replay_ctes(_LAST_B, f"1000 * {_LAST_B}", CLEANUP_MS) + ", " + _answers(
    """select coalesce(l.e, r.e) as window_end_ms, coalesce(l.key, r.key) as key, coalesce(l.n, r.n) as n
       from live l full join (select e, key, n from ret) r on l.e = r.e and l.key = r.key""")

ORACLES["q29_stream_lookup_drop"] = _replay_ctes(_LAST_B, f"1000 * {_LAST_B}", CLEANUP_MS, drop=True) + ", " + _answers(
    """select coalesce(l.e, r.e) as window_end_ms, coalesce(l.key, r.key) as key, coalesce(l.n, r.n) as n
       from (select e, key, cast(sum(n) as bigint) as n from f where raw is null group by 1, 2) l
       full join (select e, key, n from ret) r on l.e = r.e and l.key = r.key""")

_SHIPPED = f"(epoch_us(l_shipdate) // 1000) - (epoch_us(l_shipdate) // 1000) % {DAY_MS} + {DAY_MS}"
ORACLES["q31_lineitem_count"] = f"""select {_SHIPPED} as window_end_ms, l_partkey % 1000 as key, count(*) as n
from lineitem group by all"""
ORACLES["q32_lineitem_lookup"] = f"""with c as (select {_SHIPPED} as e, l_partkey as key, count(*) as n from lineitem group by all),
r as (select l_orderkey * 8 + l_linenumber as req_id, l_partkey as key, {_SHIPPED} + {7} * {DAY_MS} as e from lineitem)
select r.req_id, r.key, r.e as window_end_ms, coalesce(c.n, 0) as n, c.n is not null as found
from r left join c on r.e = c.e and r.key = c.key"""

ORACLES["q30_state_view"] = _replay_ctes(REPLAY_BATCH, REPLAY_AT_MS, CLEANUP_MS) + """
select e as window_end_ms, key, n, 'live' as origin from live
union all
select r.e, r.key, r.n, 'retained' from ret r
where not exists (select 1 from live l where l.e = r.e and l.key = r.key)"""

_ALL = _replay_ctes(10**9, 0, 0)
# the keyed operator fires a window in the micro-batch after the one whose watermark passes it, a late row in its own
ORACLES["q33_keyed_refire"] = _ALL + """
select e as window_end_ms, key, cast(coalesce(sum(n) filter (raw is not null), 0) as bigint) as n_fired,
  count(distinct case when raw is not null then greatest(b, raw + 1) end) as n_fires, cast(coalesce(sum(n) filter (raw is null), 0) as bigint) as n_live,
  cast(sum(n) as bigint) as n from f group by 1, 2"""
ORACLES["q34_keyed_seed"] = _ALL + f"""
select e as window_end_ms, key, case when raw is null then 'live' else 'fired' end as origin, cast(sum(n) as bigint) as n
from f where b > {RESUME_SPLIT} or raw is null or fb > {RESUME_SPLIT} group by 1, 2, 3"""
ORACLES["q35_state_changes"] = ORACLES["q22_state_history"]
ORACLES["q36_lookup_static"] = ORACLES["q28_lookup_stream"]
ORACLES["q37_bucketed_lookup"] = ORACLES["q09_lookup_join"]
ORACLES["q38_progress"] = _ALL + """, up as (select b, wm > lag(wm) over (order by b) as up from bt),
nb as (select b from bt union all select b + 1 from up where up and b = (select max(b) from bt))
select b as batch_id, (select count(*) from ev where ev.b = nb.b) as rows, (select max(ts_ms) from ev where ev.b = nb.b) as last_ms,
  (select count(*) from f where f.b = nb.b and f.b > raw + 1) as late_groups,
  (select count(distinct (e, key)) from f where f.b <= nb.b and (raw is null or raw >= nb.b)) as state_rows from nb"""
ORACLES["q39_pair_sink"] = f"select {PAIR} as pair from ({COUNTS}) c where window_end_ms < {WM}"
ORACLES["q40_key_sink"] = "select user_id as key from events"

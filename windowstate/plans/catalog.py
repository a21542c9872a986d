"""Registered queries: each is `(spark, sf_dir) -> DataFrame` over the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windowstate.functions.align import window_end, window_start
from windowstate.functions.codec import long_text, parse_long, with_one
from windowstate.functions.keyhash import key_partition
from windowstate.functions.requests import parse_request
from windowstate.functions.timecols import epoch_ms
from windowstate.operators import counts, firelog, lookups, retention, statetable
from windowstate.operators.scale import write_table
from windowstate.plans.params import (CLEANUP_MS, DAY_MS, EPOCH_2024_MS, HOUR_MS, MISROUTED_PARTITIONS, MISSING_KEY_OFFSET,
                                      N_BUCKETS, N_PARTITIONS, NOW_MS, REPLAY_AT_MS, REPLAY_BATCH, SEQ_PARALLELISM,
                                      SHORT_AT_MS, SHORT_CLEANUP_MS)
from windowstate.sources.keys import sequence_keys
from windowstate.sources.tables import arrival_rows, read_table, timed_keys

Query = Callable[[SparkSession, str], DataFrame]


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "events")


def _event_rows(spark: SparkSession, sf: str) -> DataFrame:
    return timed_keys(_events(spark, sf), "user_id", "ts")


def _replay(spark: SparkSession, sf: str):
    ev = _events(spark, sf)
    rows = arrival_rows(ev, "user_id", "ts", "event_id")
    return firelog.replay(rows, HOUR_MS)


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    """Every event asks for its own key in the previous, same or next hour; signups ask for a missing key."""
    ev = _events(spark, sf)
    shift = (F.col("event_id") % 3 - 1) * F.lit(HOUR_MS)
    key = F.when(F.col("event_type") == "signup", F.col("user_id") + MISSING_KEY_OFFSET).otherwise(F.col("user_id"))
    return ev.select(F.col("event_id").alias("req_id"), (epoch_ms(ev, "ts") + shift).alias("ts_ms"),
                     key.alias("key"))


# ---- queries --------------------------------------------------------------------------------------------------

def q01_tumbling_count(spark, sf):
    return counts.tumbling_count(_event_rows(spark, sf), HOUR_MS)


def q02_with_one(spark, sf):
    ev = _events(spark, sf)
    return ev.select("event_id", *with_one(F.col("user_id")))


def q03_emitted_pairs(spark, sf):
    rows = _event_rows(spark, sf)
    closed = counts.closed_windows(counts.tumbling_count(rows, HOUR_MS), counts.max_time(rows))
    return counts.emitted_pairs(closed)


def q04_open_windows(spark, sf):
    rows = _event_rows(spark, sf)
    return counts.open_windows(counts.tumbling_count(rows, HOUR_MS), counts.max_time(rows))


def q05_close_boundary(spark, sf):
    rows = _event_rows(spark, sf)
    wm = window_start(counts.max_time(rows), HOUR_MS)  # exactly the end of the previous window
    return counts.with_closed_flag(counts.tumbling_count(rows, HOUR_MS), wm)


def q06_fire_log(spark, sf):
    return firelog.fire_log(_replay(spark, sf).fired, N_PARTITIONS)


def q07_fire_totals(spark, sf):
    rp = _replay(spark, sf)
    fired = rp.fired
    last_b = rp.log.select(F.max("b")).scalar()
    emitted = (firelog.fire_log(fired).groupBy("window_end_ms", "key")
               .agg(F.sum("n").cast("bigint").alias("n_fired")))
    live = firelog.live_at(fired, last_b).withColumnRenamed("n", "n_live")
    both = emitted.join(live, ["window_end_ms", "key"], "full")
    return both.select("window_end_ms", "key", F.coalesce("n_fired", F.lit(0)).alias("n_fired"),
                       F.coalesce("n_live", F.lit(0)).alias("n_live"),
                       (F.coalesce("n_fired", F.lit(0)) + F.coalesce("n_live", F.lit(0))).alias("n"))


def _retained(spark, sf, batch, at_ms, delay_ms):
    rp = _replay(spark, sf)
    # read three times by the retention view (fire sessions, last fire per window, final rows)
    flog = write_table(firelog.fire_log(rp.fired, N_PARTITIONS), "fires")
    return retention.retained_view(flog, rp.log, batch, at_ms, delay_ms), rp.fired


def q08_retained_view(spark, sf):
    return _retained(spark, sf, REPLAY_BATCH, REPLAY_AT_MS, CLEANUP_MS)[0]


def q09_lookup_join(spark, sf):
    state = counts.tumbling_count(_event_rows(spark, sf), HOUR_MS)
    return lookups.lookup(_requests(spark, sf), state, HOUR_MS, with_text=True)


def q10_lookup_now(spark, sf):
    rows = _event_rows(spark, sf)
    state = counts.tumbling_count(rows, HOUR_MS)
    ev = _events(spark, sf)
    req = ev.select(F.col("event_id").alias("req_id"), F.lit(None).cast("bigint").alias("ts_ms"),
                    F.col("user_id").alias("key"))
    return lookups.lookup(req, state, HOUR_MS, now_ms=counts.max_time(rows))


def q11_lookup_live_retained(spark, sf):
    ret, fired = _retained(spark, sf, REPLAY_BATCH, REPLAY_AT_MS, CLEANUP_MS)
    live = firelog.live_at(fired, REPLAY_BATCH)
    return lookups.lookup(_requests(spark, sf), live, HOUR_MS, retained=ret)


def _variants(df: DataFrame, *variants) -> DataFrame:
    """One scan: each row of `df` gives a row per struct of `variants`."""
    return df.select(F.inline(F.array(*variants)))


def q12_parse_long(spark, sf):
    eid = F.col("event_id")
    ident = lambda src, i, text: F.struct(F.lit(src).alias("src"), i.alias("id"), text.alias("text"))
    ev = _variants(
        _events(spark, sf),
        ident("props", eid, F.col("props")),
        ident("props_value", eid, F.substring("props", 7, F.length("props") - 7)),
        ident("props_spaced", eid, F.substring("props", 6, F.length("props") - 6)),
        ident("user", eid, F.col("user_id").cast("string")),
        ident("user_plus", eid, F.concat(F.lit("+"), F.col("user_id").cast("string"))),
        ident("user_frac", eid, F.concat(F.col("user_id").cast("string"), F.lit(".5"))),
        ident("neg_id", eid, F.concat(F.lit("-"), eid.cast("string"))),
        ident("event_type", eid, F.col("event_type")),
        ident("empty", eid, F.substring("event_type", 100, 1)))
    key = F.col("c_custkey")
    cu = _variants(
        read_table(spark, sf, "customer"), ident("c_name", key, F.col("c_name")),
        ident("c_overflow", key, F.concat(key.cast("string"), F.lit("0000000000000000000"))))
    return ev.unionByName(cu).withColumn("key", parse_long("text"))


def q13_text_roundtrip(spark, sf):
    big = F.lit(1_000_000_000_000)
    vals = [F.col("user_id"), -F.col("event_id"), F.col("event_id") * big, -(F.col("event_id") * big) - 1]
    u = _variants(_events(spark, sf), *[F.struct("event_id", F.lit(i).alias("variant"), v.cast("bigint").alias("v"))
                                        for i, v in enumerate(vals)])
    u = u.withColumn("text", long_text("v"))
    return u.withColumn("back", parse_long("text"))


def q14_request_parse(spark, sf):
    ev = _events(spark, sf)
    ms = epoch_ms(ev, "ts").cast("string")
    uid = F.col("user_id").cast("string")
    kind = F.col("event_id") % 6
    line = (F.when(kind == 0, uid)
            .when(kind == 1, F.concat(ms, F.lit(","), uid))
            .when(kind == 2, F.concat(ms, F.lit(","), uid, F.lit(","), F.col("event_id").cast("string")))
            .when(kind == 3, F.upper(F.col("event_type")))
            .when(kind == 4, F.concat(uid, F.lit(",")))
            .otherwise(F.concat(F.lit(","), uid)))
    req = ev.select(F.col("event_id").alias("req_id"), line.alias("line"))
    return req.select("req_id", "line", parse_request("line", NOW_MS).alias("r")).select("req_id", "line", "r.*")


def q15_align_negative(spark, sf):
    ev = _events(spark, sf)
    shifted = epoch_ms(ev, "ts") - F.lit(EPOCH_2024_MS + 5 * HOUR_MS)
    return ev.select("event_id", shifted.alias("shifted_ms")).select(
        "event_id", "shifted_ms", window_start("shifted_ms", HOUR_MS).alias("window_start_ms"),
        window_end("shifted_ms", HOUR_MS).alias("window_end_ms"))


def q16_key_partition(spark, sf):
    keys = _variants(_events(spark, sf), *[F.struct(v.alias("key")) for v in (
        F.col("user_id"), -F.col("user_id") - 1, F.col("event_id") * F.lit(2654435761) - F.lit(1 << 62))]).distinct()
    return key_partition(keys, "key", N_PARTITIONS, hash_col="hash")


def q17_partition_skew(spark, sf):
    rows = key_partition(_event_rows(spark, sf), "key", N_PARTITIONS)
    return rows.groupBy("partition").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("key").alias("keys"))


def q18_partition_audit(spark, sf):
    state = counts.tumbling_count(_event_rows(spark, sf), HOUR_MS)
    stored = key_partition(state, "key", MISROUTED_PARTITIONS)
    return lookups.partition_audit(stored, "partition", N_PARTITIONS)


def q19_key_sequence(spark, sf):
    """S2 over the table: events are dealt to the generators in turn, and each gives its generator's next key."""
    ev = _events(spark, sf)
    num_keys = ev.agg(F.countDistinct("user_id")).first()[0]
    return sequence_keys(ev.select("event_id"), "event_id", max(num_keys, 1), SEQ_PARALLELISM)


def q30_state_view(spark, sf):
    """The queryable state at batch 6 as one table: live rows, then retained rows not shadowed by live ones."""
    ret, fired = _retained(spark, sf, REPLAY_BATCH, REPLAY_AT_MS, CLEANUP_MS)
    return lookups.state_view(firelog.live_at(fired, REPLAY_BATCH), ret)


def q26_state_size(spark, sf):
    return counts.state_size(q04_open_windows(spark, sf))


def q27_retention_short(spark, sf):
    return _retained(spark, sf, REPLAY_BATCH, SHORT_AT_MS, SHORT_CLEANUP_MS)[0]


def _shipped(spark, sf):
    """Line items as a keyed series: parts, counted per day shipped."""
    return timed_keys(read_table(spark, sf, "lineitem"), "l_partkey", "l_shipdate", extra=["l_orderkey", "l_linenumber"])


def q31_lineitem_count(spark, sf):
    """A1 on the volume table, keyed by a Column expression."""
    return counts.tumbling_count(_shipped(spark, sf), DAY_MS, key=F.col("key") % 1000)


def q32_lineitem_lookup(spark, sf):
    """L2 on the volume table: each line item asks for its part's count a week after it was shipped."""
    rows = _shipped(spark, sf)
    requests = rows.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("req_id"),
                           (F.col("ts_ms") + F.lit(7 * DAY_MS)).alias("ts_ms"), "key")
    return lookups.lookup(requests, counts.tumbling_count(rows, DAY_MS), DAY_MS)


def q37_bucketed_lookup(spark, sf):
    """A2 + L2: q09's lookups against a bucketed state table, in two halves that reuse its partitioning."""
    state = counts.tumbling_count(_event_rows(spark, sf), HOUR_MS)
    name = statetable.write_state_table(state, N_BUCKETS)
    req = _requests(spark, sf)
    halves = [statetable.lookup_table(req.where(F.col("req_id") % 2 == i), name, HOUR_MS, with_text=True) for i in (0, 1)]
    return halves[0].unionByName(halves[1])


BATCH_QUERIES: dict[str, Query] = {
    name: fn for name, fn in sorted(globals().items()) if name[:1] == "q" and name[1:3].isdigit() and callable(fn)
}

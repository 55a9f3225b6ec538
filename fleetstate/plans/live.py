"""Registered queries of streams that reorder, start from records and wait, of monitors that take
commands, and of what they write: beside ``catalog``, with the same kind of oracles."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetstate.functions.rules import rule_report
from fleetstate.model import DEFAULT_PARAMS as P
from fleetstate.model import EDGE_SCHEMA, edges_df, literal_rows
from fleetstate.operators import calendar, commands, layers, leases, registry, replay
from fleetstate.plans import oracle as O
from fleetstate.plans.catalog import _REPLAY_REC, _TRIGGERS, ORACLE, query
from fleetstate.session import remove_path
from fleetstate.sources import fixtures as X
from fleetstate.sources import ingest
from fleetstate.streaming import lifecycle as S
from fleetstate.streaming import waits as W

# ---------------------------------------------------------------- out-of-order arrivals

JITTER_S = 21_600  # a row arrives up to six hours after its time
ARRIVALS = 4  # stretches of arrival time, written one after the other
FILE_ROWS = 500_000  # rows of a file, about


class Arrival(NamedTuple):
    """Files in the order of arrival, and how a stream reads them."""

    delay: str  # of the watermark
    per_trigger: int  # files of a micro-batch
    rows: int


def _arrive(rows: DataFrame, path: str, salt: str) -> Arrival:
    """Write ``rows`` (ts, ...) as files in the order of a late and shuffled arrival; returns the
    watermark delay that covers it. The last file has a row far in the future, which lets the
    watermark pass everything before it. The rows are made once; the number of a stretch's files grows
    with them, and that of the micro-batches stays."""
    spark = rows.sparkSession
    rows.write.parquet(f"{path}-made")
    rows = spark.read.schema(rows.schema).parquet(f"{path}-made")
    second = F.unix_seconds("ts")
    arrival = second + F.pmod(F.xxhash64(salt), F.lit(JITTER_S))
    lo, hi, n = rows.agg(F.min(second), F.max(second), F.count("*")).first()
    lo, hi = lo or 0, hi or 0
    width = (hi - lo + JITTER_S) // ARRIVALS + 1
    stretch = F.floor((arrival - lo) / width).cast("int")
    files = max(2, n // ARRIVALS // FILE_ROWS)
    for i in range(ARRIVALS):
        rows.where(stretch == i).repartition(files).write.mode("append").parquet(path)
    delay = width + JITTER_S
    blank = [F.timestamp_seconds(F.lit(hi + 40 * 86_400 + delay)).alias(f.name) if f.name in ("ts", "deadline") else F.lit("~end").alias("id") if f.name == "id"
             else F.array(F.lit("")).alias(f.name) if f.name == "allowed" else F.lit("0").cast(f.dataType).alias(f.name) for f in rows.schema.fields]
    spark.range(1).coalesce(1).select(*blank).write.mode("append").parquet(path)
    remove_path(spark, f"{path}-made")
    return Arrival(f"{delay} seconds", files * 3 // 2, n)


def _arriving(spark: SparkSession, rows: DataFrame, path: str, how: Arrival) -> DataFrame:
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", how.per_trigger).parquet(path)


@query("stream_reordered", ORACLE["replay_state"])
def q_stream_reordered(spark: SparkSession, sf: str) -> DataFrame:
    """G1: signals that arrive late and shuffled over several micro-batches; the reorder buffer makes
    the result that of the ordered batch replay."""
    root = S.scratch_dir(spark, "stream-reordered")
    signals = X.signals(spark, sf)
    how = _arrive(signals, f"{root}/in", "seq")
    src = _arriving(spark, signals, f"{root}/in", how)
    stream = S.lifecycle_stream(src, P, watermark=how.delay, reorder=True, groups=S.groups_for(how.rows))
    S.run_available_now(stream, f"{root}/out", f"{root}/ck")
    cur = S.latest_per_id(spark.read.schema(S.OUTPUT_SCHEMA).parquet(f"{root}/out"))
    return cur.select("id", "state_kind", "state_message", "next_update_time", "n_signals", "n_applied")


@query("stream_apply_commands", ORACLE["apply_commands"])
def q_stream_apply_commands(spark: SparkSession, sf: str) -> DataFrame:
    """G1 from existing records: routed commands as a stream on a state seeded with the registry."""
    root = S.scratch_dir(spark, "stream-commands")
    routed = commands.route_requests(X.access_log(spark, sf)).where(F.col("operation").isin("stop", "restart", "delete"))
    asked = routed.select("id", "ts", F.col("event_id").alias("seq"), F.upper("operation").alias("signal"), F.lit(None).cast("string").alias("msg"))
    how = _arrive(asked, f"{root}/in", "seq")
    src = _arriving(spark, asked, f"{root}/in", how)
    records = X.registry(spark, sf)
    stream = S.lifecycle_stream(src, P, watermark=how.delay, reorder=True, initial=records, groups=S.groups_for(how.rows + records.count()))
    S.run_available_now(stream, f"{root}/out", f"{root}/ck")
    cur = S.latest_per_id(spark.read.schema(S.OUTPUT_SCHEMA).parquet(f"{root}/out"))
    return cur.select("id", "state_kind", "state_message", "next_update_time", "n_signals", "n_applied")


@query("stream_waits", O.with_views(["signals", "edges", "waits"], _REPLAY_REC + """
, lg as (select r.id, s.ts, s.seq, r.state_kind as kind from rec r join s on s.id = r.id and s.rn = r.rn where r.rn > 0 and r.outcome = 'Applied'),
w0 as (select w.*, coalesce((select arg_max(l.kind, struct_pack(t := l.ts, q := l.seq)) from lg l where l.id = w.id and l.ts <= w.ts), 'WaitToStart') as kind0 from waits w),
nx as (select w.wait_id, arg_min(l.kind, struct_pack(t := l.ts, q := l.seq)) as kind, min(l.ts) as ts
       from w0 w join lg l on l.id = w.id and l.ts > w.ts and l.ts <= w.deadline and (l.kind = w.target or not list_contains(w.allowed, l.kind)) group by w.wait_id),
o as (
  select w.*, nx.kind as kind1, nx.ts as ts1, kind0 = target as hit0, not list_contains(allowed, kind0) as bad0,
    coalesce((select arg_max(l.kind, struct_pack(t := l.ts, q := l.seq)) from lg l where l.id = w.id and l.ts <= w.deadline), 'WaitToStart') as kind2
  from w0 w left join nx on nx.wait_id = w.wait_id)
select id, wait_id, target,
  case when hit0 then 'reached' when bad0 then 'failed' when kind1 = target then 'reached' when kind1 is not null then 'failed' else 'timed_out' end as status,
  epoch_us(case when hit0 or bad0 then ts when kind1 is not null then ts1 else deadline end) as at_us,
  epoch_us(case when hit0 or bad0 then ts when kind1 is not null then ts1 else deadline end) - epoch_us(ts) as waited_us,
  case when hit0 or bad0 then kind0 when kind1 is not null then kind1 else kind2 end as state_kind
from o"""))
def q_stream_waits(spark: SparkSession, sf: str) -> DataFrame:
    """waits against transitions, two streams that both arrive late and shuffled."""
    root = S.scratch_dir(spark, "stream-waits")
    log = replay.replay_log(X.signals(spark, sf), P).where("outcome = 'Applied'").select("id", "ts", "seq", "to_kind")
    asked = X.waits(spark, sf)
    hows = [_arrive(log, f"{root}/transitions", "seq"), _arrive(asked, f"{root}/waits", "wait_id")]
    streams = [_arriving(spark, x, f"{root}/{n}", how) for x, n, how in zip((log, asked), ("transitions", "waits"), hows)]
    waits = W.wait_stream(*streams, watermarks=tuple(h.delay for h in hows), groups=S.groups_for(sum(h.rows for h in hows)))
    S.run_available_now(waits, f"{root}/out", f"{root}/ck")
    return spark.read.schema(W.OUTPUT).parquet(f"{root}/out")


# ---------------------------------------------------------------- a monitor that takes commands (G3 with D3-D5, A4 layered)

def _epoch_sql(e: int) -> str:
    """Epoch ``e`` as CTEs: commands of its third folded onto q<e>, then the round on the result, give q<e+1>."""
    now = f"({O.NOW} + {100 * e})"
    return f"""
, s{e} as (select id, ts, seq, signal, t, row_number() over (partition by id order by ts, seq) as rn from asked where seq % 3 = {e}),
f{e} as (
  select ids.id, cast(0 as bigint) as rn, coalesce(r.state_kind, 'Removed') as state_kind, r.state_message, r.next_update_time,
    cast(null as varchar) as from_kind, cast(null as varchar) as signal, cast(null as bigint) as seq, false as applied
  from (select distinct id from s{e}) ids left join q{e} r on r.id = ids.id
  union all
  select r.id, s.rn, coalesce(e.to_kind, r.state_kind),
    case when e.to_kind is null then r.state_message else {O.msg_sql('r.state_message', 'e.msg_rule', 'cast(null as varchar)', 'e.const_message')} end,
    case when e.to_kind is null then r.next_update_time else {O.next_sql('e.next_rule', 's.t')} end, r.state_kind, s.signal, s.seq, e.to_kind is not null
  from f{e} r join s{e} s on s.id = r.id and s.rn = r.rn + 1 left join edges e on e.from_kind = r.state_kind and e.signal = s.signal),
l{e} as (select id, arg_max(state_kind, rn) as state_kind, arg_max(coalesce(state_message, chr(1)), rn) as m, arg_max(coalesce(next_update_time, -1), rn) as n
  from f{e} where applied group by id),
p{e} as (select q.id, coalesce(l.state_kind, q.state_kind) as state_kind, case when l.id is null then q.state_message else nullif(l.m, chr(1)) end as state_message,
    case when l.id is null then q.next_update_time else nullif(l.n, -1) end as next_update_time
  from q{e} q left join l{e} l on l.id = q.id where coalesce(l.state_kind, '') <> 'Removed'),
last{e} as (select id, phase from (select id, phase, row_number() over (partition by id
    order by ts desc, l_linenumber desc, l_partkey desc, l_suppkey desc) as rn from observations where l_partkey % 3 <= {e}) x where rn = 1),
j{e} as (select d.id, d.state_kind, d.state_message, o.err_msg,
    case when d.state_kind in ('WaitToStart', 'WaitToTerminate', 'ErrorWaitToClean') then
           case when o.id is null then 'CRASH' when o.err_msg is null then 'RELEASE_OK' else 'RELEASE_ERR' end
         when d.state_kind in {_TRIGGERS} then 'TIMEOUT' else 'PHASE_' || coalesce(l.phase, 'Unknown') end as action
  from p{e} d left join last{e} l on l.id = d.id left join outcomes o on o.id = d.id
  where d.next_update_time is not null and d.next_update_time < {now}),
c{e} as (select j.id, j.state_kind as from_kind, j.action, e.to_kind, {O.msg_sql('j.state_message', 'e.msg_rule', 'j.err_msg', 'e.const_message')} as m,
    {O.next_sql('e.next_rule', now)} as n
  from j{e} j join rules e on e.from_kind = j.state_kind and e.signal = j.action),
q{e + 1} as (select p.id, coalesce(c.to_kind, p.state_kind) as state_kind,
    case when c.id is null then p.state_message else c.m end as state_message,
    case when c.id is null then p.next_update_time else c.n end as next_update_time
  from p{e} p left join c{e} c on c.id = p.id)"""


_EPOCHS = """
, acq as (select from_kind, to_kind as mid, msg_rule as a_msg, next_rule as a_next from edges where signal = 'ACQUIRE'),
rules as (
  select a.from_kind, r.signal, r.to_kind, case when r.msg_rule = 'keep' then a.a_msg else r.msg_rule end as msg_rule,
    r.next_rule, r.const_message
  from acq a join edges r on r.from_kind = a.mid and r.signal in ('RELEASE_OK', 'RELEASE_ERR')
  union all select from_kind, 'CRASH', mid, a_msg, a_next, cast(null as varchar) from acq
  union all select from_kind, signal, to_kind, msg_rule, next_rule, const_message from edges
    where signal = 'TIMEOUT' or signal like 'PHASE_%'),
asked as (select id, ts, event_id as seq, upper(operation) as signal, cast(floor(epoch(ts)) as bigint) as t from routed where operation in ('stop', 'restart', 'delete')),
rec as (select 1 as one),
q0 as (select id, state_kind, state_message, next_update_time from registry)""" + "".join(map(_epoch_sql, range(3)))
_MONITOR_VIEWS = ["registry", "observations", "outcomes", "edges", "routed"]


def _run_monitor(spark: SparkSession, sf: str) -> str:
    """Three epochs, 100 seconds apart: a third of the observations and of the commands comes before
    each. Every second version is whole, the others are change sets."""
    root = S.scratch_dir(spark, "monitor-commands")
    registry.write_registry(X.registry(spark, sf), f"{root}/registry/v=0")
    obs = X.observations(spark, sf)
    routed = commands.route_requests(X.access_log(spark, sf)).where(F.col("operation").isin("stop", "restart", "delete"))
    asked = routed.select("id", "ts", F.col("event_id").alias("seq"), F.upper("operation").alias("signal"), F.lit(None).cast("string").alias("msg"))
    for third in range(3):
        obs.where(F.col("l_partkey") % 3 == third).write.parquet(f"{root}/obs/{third}")
        asked.where(F.col("seq") % 3 == third).write.parquet(f"{root}/asked/{third}")
        both = [spark.readStream.schema(d.schema).option("recursiveFileLookup", "true").parquet(f"{root}/{n}") for d, n in ((obs, "obs"), (asked, "asked"))]
        S.monitor_rounds(both[0], f"{root}/registry", X.outcomes(spark, sf), f"{root}/ck", P, now_fn=lambda e: P.now + 100 * e, commands=both[1], compact_every=2)
    return f"{root}/registry"


@query("monitor_with_commands", O.with_views(_MONITOR_VIEWS, _EPOCHS + "select * from q3"))
def q_monitor_with_commands(spark: SparkSession, sf: str) -> DataFrame:
    """G3 with D3-D5: the registry after three epochs of commands and rounds."""
    return layers.read_version(spark, _run_monitor(spark, sf), 3).select("id", "state_kind", "state_message", "next_update_time")


@query("monitor_command_log", O.with_views(_MONITOR_VIEWS, _EPOCHS + " union all ".join(f"""
select {e} as epoch, id, from_kind, signal, state_kind, state_message, next_update_time, seq from f{e} where applied
union all select {e}, id, from_kind, action, to_kind, m, n, cast(null as bigint) from c{e}""" for e in range(3))))
def q_monitor_command_log(spark: SparkSession, sf: str) -> DataFrame:
    """A5: the log of the same three epochs, commands and rounds."""
    log = spark.read.parquet(f"{_run_monitor(spark, sf)}/log")
    return log.select(F.col("batch").cast("int").alias("epoch"), "id", "from_kind", "signal", "state_kind", "state_message", "next_update_time", "seq")


# ---------------------------------------------------------------- requests that come again

@query("stream_ingest_retried", O.with_views(["created"], """
select c.id, c.name, c.version, case when v.request_id % 4 = 0 then 'Running' else c.state_kind end as state_kind, c.next_update_time
from created c join valid v on sha256(cast(v.request_id as varchar)) = c.id"""))
def q_stream_ingest_retried(spark: SparkSession, sf: str) -> DataFrame:
    """Every request comes at least twice: within a micro-batch, in the next one, and again when
    the stream has forgotten it. One engine in four runs by then, and must not be reset."""
    root = S.scratch_dir(spark, "ingest-retried")
    hour = 3600
    req = X.requests(spark, sf)
    at = lambda df, h: df.withColumn("ts", F.timestamp_seconds(F.lit(P.now + h * hour)))
    early, late = req.where("request_id % 2 = 0"), req.where("request_id % 2 = 1")
    sets = [at(early, 0).unionByName(at(early, 0)), at(late, 3).unionByName(at(req, 3)), at(early, 6)]
    runs = req.where("request_id % 4 = 0").select(F.sha2(F.col("request_id").cast("string"), 256).alias("id"), F.lit(True).alias("runs"))
    registry.write_registry(X.registry(spark, sf).limit(0), f"{root}/v=0")
    for i, rows in enumerate(sets):
        rows.write.parquet(f"{root}/in/{i}")
        src = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{root}/in")
        now = registry.read_registry(spark, f"{root}/v={i}")
        S.ingest_stream(src, f"{root}/out", f"{root}/ck", P, retry_window="1 hour", registry=now)
        good = spark.read.parquet(f"{root}/out/good").drop("batch")
        now = registry.apply_changes(now, good.select("*", F.lit(False).alias("removed"), F.lit(True).alias("created")))
        kind = F.when(F.col("runs"), "Running").otherwise(F.col("state_kind"))
        registry.write_registry(now.join(runs, "id", "left").withColumn("state_kind", kind), f"{root}/v={i + 1}")
    return registry.read_registry(spark, f"{root}/v=3").select("id", "name", "version", "state_kind", "next_update_time")


# ---------------------------------------------------------------- calendar layout

@query("due_records_calendar", ORACLE["due_records"])
def q_due_records_calendar(spark: SparkSession, sf: str) -> DataFrame:
    """B3 on a snapshot in calendar layout, written a day before."""
    path = f"{S.scratch_dir(spark, 'calendar')}/v=0"
    day = 86_400
    calendar.write_calendar(X.registry(spark, sf), path, type(P)(now=P.now - 30 * day, interval=P.interval, timeout=P.timeout), slot_seconds=day, slots=60)
    return registry.due_records(calendar.read_calendar(spark, path), P).select("id", "name", "version", "state_kind", "state_message", "next_update_time")


# ---------------------------------------------------------------- leases over time (D6 with D8)

LEASE_S = 30 * 86_400


@query("lease_history", O.with_views(["claims"], f"""
, s as (select *, cast(floor(epoch(ts)) as bigint) as t, row_number() over (partition by id order by ts, claimant, seq, tiebreak) as rn from claims),
rec as (
  select id, rn, t as lease_t, ts as lease_ts, claimant as holder, true as won from s where rn = 1
  union all
  select r.id, s.rn, case when s.t > r.lease_t + {LEASE_S} then s.t else r.lease_t end, case when s.t > r.lease_t + {LEASE_S} then s.ts else r.lease_ts end,
    case when s.t > r.lease_t + {LEASE_S} then s.claimant else r.holder end, s.t > r.lease_t + {LEASE_S}
  from rec r join s on s.id = r.id and s.rn = r.rn + 1)
select s.id, epoch_us(s.ts) as ts_us, s.claimant, s.seq, s.tiebreak, case when r.won then 'Success' else 'Fail' end as outcome, r.holder,
  epoch_us(r.lease_ts) as lease_us, r.lease_t + {LEASE_S} as expires
from rec r join s on s.id = r.id and s.rn = r.rn"""))
def q_lease_history(spark: SparkSession, sf: str) -> DataFrame:
    """All claims in order; a claim after the lease's timeout wins again."""
    out = leases.lease_history(X.claims(spark, sf), LEASE_S)
    return out.select("id", F.unix_micros("ts").alias("ts_us"), "claimant", "seq", "tiebreak", "outcome", "holder", F.unix_micros("lease_ts").alias("lease_us"), "expires")


# ---------------------------------------------------------------- callers' rules in folds

_CUSTOM = [
    ("WaitToStart", "ACQUIRE", "TriggerStart", "clear", "timeout", "custom", None), ("TriggerStart", "RELEASE_OK", "Running", "clear", "interval", "custom", None),
    ("TriggerStart", "RELEASE_ERR", "Parked", "set", "now", "custom", None), ("Parked", "RESTART", "WaitToStart", "keep", "now", "custom", None),
    ("Parked", "RELEASE_ERR", "Parked", "append", "none", "custom", None), ("Running", "STOP", "WaitToStart", "clear", "now", "custom", None),
    ("Running", "PHASE_Failed", "Parked", "const", "interval", "custom", "parked: failed"), ("Parked", "DELETE", "Removed", "clear", "none", "custom", None)]
_CUSTOM_SQL = "select * from (values " + ", ".join("(" + ", ".join(O._q(v) for v in (a, s, b, m, n, c)) + ")" for a, s, b, m, n, _, c in _CUSTOM) + ") t(from_kind, signal, to_kind, msg_rule, next_rule, const_message)"


def _custom(spark: SparkSession) -> DataFrame:
    return literal_rows(spark, _CUSTOM, EDGE_SCHEMA)


@query("custom_replay", O.with_views(["signals"], f", edges as ({_CUSTOM_SQL})" + _REPLAY_REC + """
select r.id, r.state_kind, r.state_message, r.next_update_time, m.n as n_signals, r.n_applied
from rec r join (select id, count(*) as n from s group by id) m on m.id = r.id and r.rn = m.n"""))
def q_custom_replay(spark: SparkSession, sf: str) -> DataFrame:
    """The replay by a caller's rules, with a state that the built-in table doesn't have."""
    return replay.replay_state(X.signals(spark, sf), P, edges=_custom(spark))


@query("rule_check", O.with_views(["registry", "edges"], """
, st as (select from_kind as state from edges union select to_kind from edges),
o as (select from_kind, count(*) as n_out, count(*) - count(distinct signal) as n_conflicts from edges group by from_kind),
rec as (select 'WaitToStart' as state, 0 as distance
  union select e.to_kind, r.distance + 1 from rec r join edges e on e.from_kind = r.state where r.distance < 20),
d as (select state, min(distance) as distance from rec group by state),
n as (select state_kind, count(*) as n_records from registry group by state_kind)
select st.state, coalesce(n_out, 0) as n_out, coalesce(n_conflicts, 0) as n_conflicts, d.state is not null as reachable, cast(d.distance as bigint) as distance,
  n_out is null and st.state <> 'Removed' as dead_end, coalesce(n_records, 0) as n_records
from st left join o on o.from_kind = st.state left join d on d.state = st.state left join n on n.state_kind = st.state"""))
def q_rule_check(spark: SparkSession, sf: str) -> DataFrame:
    """The rule table as a graph, and how many records are in each state."""
    records = X.registry(spark, sf).groupBy(F.col("state_kind").alias("state")).agg(F.count("*").alias("n_records"))
    return rule_report(edges_df(spark)).join(records, "state", "left").withColumn("n_records", F.coalesce("n_records", F.lit(0)))

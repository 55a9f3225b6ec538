"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame over the whole tables.

Every query has an oracle in ``ORACLE`` (DuckDB SQL over the same parquet) unless it is a
streaming query, which is checked on rows only and by the tests against its batch twin.
Computed columns carry the same names in both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetstate.functions import columns as C
from fleetstate.functions import launch
from fleetstate.model import DEFAULT_PARAMS as P
from fleetstate.model import EDGE_SCHEMA, IN_PROGRESS, literal_rows, state_dimension_rows
from fleetstate.operators import cas_chain, commands, observe, planning, registry, replay
from fleetstate.plans import oracle as O
from fleetstate.sources import fixtures as X
from fleetstate.sources import ingest
from fleetstate.streaming import lifecycle as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------- registry

@query("registry_scan", O.with_views(["registry"], """
select id, name, engine_type, version, state_kind, state_message, next_update_time,
  strftime(create_time, '%Y-%m-%d %H:%M:%S') || ' +00:00:00' as create_time
from registry"""))
def q_registry_scan(spark, sf):
    r = X.registry(spark, sf)
    return r.select("id", "name", "engine_type", "version", "state_kind", "state_message", "next_update_time",
                    C.format_time("create_time").alias("create_time"))


@query("point_lookup", O.with_views(["registry"], """
select id, name, version, state_kind, state_message, next_update_time from registry where id = 'eng-42'"""))
def q_point_lookup(spark, sf):
    return registry.point_lookup(X.registry(spark, sf), "eng-42").select(
        "id", "name", "version", "state_kind", "state_message", "next_update_time")


@query("due_records", O.with_views(["due"], """
select id, name, version, state_kind, state_message, next_update_time from due"""))
def q_due_records(spark, sf):
    return registry.due_records(X.registry(spark, sf), P).select(
        "id", "name", "version", "state_kind", "state_message", "next_update_time")


@query("due_counts", O.with_views(["due"], """
select state_kind, count(*) as n_due from due group by state_kind"""))
def q_due_counts(spark, sf):
    return registry.due_counts(X.registry(spark, sf), P)


@query("list_ids", O.with_views(["registry"], """
select id, row_number() over (order by id) as pos from registry"""))
def q_list_ids(spark, sf):
    return registry.list_ids(X.registry(spark, sf))


# ---------------------------------------------------------------- observations

@query("latest_observation", O.with_views(["observations"], """
select id, phase, ts_text, n_obs from (
  select id, phase, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts_text, count(*) over (partition by id) as n_obs,
    row_number() over (partition by id order by ts desc, l_linenumber desc, l_partkey desc, l_suppkey desc) as rn
  from observations) x where rn = 1"""))
def q_latest_observation(spark, sf):
    return observe.latest_observation(X.observations(spark, sf)).select(
        "id", "phase", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts_text"), "n_obs")


@query("reconcile", O.with_views(["registry", "last_obs", "edges"], f"""
, j as (select r.id, r.state_kind, r.state_message,
    case when l.id is null then 'NotExisted' when l.phase is null then 'Unknown'
         when l.phase in ('Pending', 'Running', 'Succeeded', 'Failed', 'Unknown') then l.phase end as phase
  from registry r left join last_obs l on l.id = r.id
  where r.state_kind in ('StartInProgress', 'Running', 'TerminateInProgress', 'ErrorCleanInProgress'))
select j.id, j.state_kind as from_kind, j.phase, coalesce(e.to_kind, j.state_kind) as state_kind,
  case when e.to_kind is null then j.state_message
       else {O.msg_sql('j.state_message', 'e.msg_rule', 'cast(null as varchar)', 'e.const_message')} end as state_message,
  {O.next_sql('e.next_rule')} as next_update_time,
  case when e.to_kind is null then 'illegal' when e.to_kind = j.state_kind then 'unchanged' else 'changed' end as status
from j left join edges e on e.from_kind = j.state_kind and e.signal = 'PHASE_' || j.phase"""))
def q_reconcile(spark, sf):
    return observe.reconcile(X.registry(spark, sf), X.observations(spark, sf), P)


# ---------------------------------------------------------------- monitor round

def _sync_sql(launch_check: bool) -> str:
    versions = "('3.5.3', '3.5.4')"
    launch_err = (f"case when d.state_kind = 'WaitToStart' and d.version not in {versions} then 'Not allowed: Spark version ' "
                  "|| d.version || ' is not supported. Supported versions: [\"3.5.3\", \"3.5.4\"]' "
                  "when d.state_kind = 'WaitToStart' and d.o_orderkey % 24 = 0 then 'Not allowed: The config spark.app.id is not allowed as it is reserved.' end"
                  if launch_check else "cast(null as varchar)")
    return O.with_views(["due", "last_obs", "outcomes", "edges"], f"""
, j0 as (
  select d.id, d.state_kind, d.state_message, o.err_msg, o.id as oid, l.id as lid, l.phase, {launch_err} as launch_err
  from due d left join last_obs l on l.id = d.id left join outcomes o on o.id = d.id),
j as (
  select id, state_kind, state_message, coalesce(launch_err, err_msg) as err_msg,
    case when state_kind in ('WaitToStart', 'WaitToTerminate', 'ErrorWaitToClean') then
           case when launch_err is not null then 'RELEASE_ERR'
                when oid is null then 'CRASH' when err_msg is null then 'RELEASE_OK' else 'RELEASE_ERR' end
         when state_kind in ('TriggerStart', 'TriggerTermination', 'ErrorTriggerClean') then 'TIMEOUT'
         when state_kind in ('StartInProgress', 'Running', 'TerminateInProgress', 'ErrorCleanInProgress') then
           'PHASE_' || case when lid is null then 'NotExisted' when phase is null then 'Unknown' else phase end
    end as action
  from j0),
acq as (select from_kind, to_kind as mid, msg_rule as a_msg, next_rule as a_next from edges where signal = 'ACQUIRE'),
rules as (
  select a.from_kind, r.signal, r.to_kind, case when r.msg_rule = 'keep' then a.a_msg else r.msg_rule end as msg_rule,
    r.next_rule, r.const_message
  from acq a join edges r on r.from_kind = a.mid and r.signal in ('RELEASE_OK', 'RELEASE_ERR')
  union all select from_kind, 'CRASH', mid, a_msg, a_next, cast(null as varchar) from acq
  union all select from_kind, signal, to_kind, msg_rule, next_rule, const_message from edges
    where signal = 'TIMEOUT' or signal like 'PHASE_%')
select j.id, j.state_kind as from_kind, j.action, coalesce(e.to_kind, j.state_kind) as state_kind,
  case when e.to_kind is null then j.state_message else {O.msg_sql('j.state_message', 'e.msg_rule', 'j.err_msg', 'e.const_message')} end as state_message,
  {O.next_sql('e.next_rule')} as next_update_time,
  case when e.to_kind is null then 'illegal' else 'ok' end as status
from j left join rules e on e.from_kind = j.state_kind and e.signal = j.action""")


@query("sync_round", _sync_sql(False))
def q_sync_round(spark, sf):
    return planning.sync_round(X.registry(spark, sf), X.observations(spark, sf), X.outcomes(spark, sf), P)


@query("sync_round_checked", _sync_sql(True))
def q_sync_round_checked(spark, sf):
    """D10 with C5/C3 wired in: a WaitToStart record's launch checks decide before its outcome."""
    return planning.sync_round(X.registry(spark, sf), X.observations(spark, sf), X.outcomes(spark, sf), P,
                               launch_check=True)


@query("retry_timeouts", O.with_views(["due", "edges"], f"""
select d.id, d.state_kind as from_kind, e.to_kind as state_kind,
  {O.msg_sql('d.state_message', 'e.msg_rule', 'cast(null as varchar)', 'e.const_message')} as state_message,
  {O.next_sql('e.next_rule')} as next_update_time
from due d join edges e on e.from_kind = d.state_kind and e.signal = 'TIMEOUT'"""))
def q_retry_timeouts(spark, sf):
    return planning.retry_timeouts(X.registry(spark, sf), P)


@query("release", O.with_views(["registry", "outcomes", "edges"], f"""
, j as (select r.id, r.state_kind, r.state_message, o.err_msg,
    case when o.id is null then 'CRASH' when o.err_msg is null then 'RELEASE_OK' else 'RELEASE_ERR' end as signal
  from registry r left join outcomes o on o.id = r.id
  where r.state_kind in ('TriggerStart', 'TriggerTermination', 'ErrorTriggerClean'))
select j.id, j.state_kind as from_kind, j.signal,
  case when j.signal = 'CRASH' then j.state_kind else e.to_kind end as state_kind,
  case when j.signal = 'CRASH' then j.state_message else {O.msg_sql('j.state_message', 'e.msg_rule', 'j.err_msg', 'e.const_message')} end as state_message,
  case when j.signal = 'CRASH' then cast(null as bigint) else {O.next_sql('e.next_rule')} end as next_update_time,
  j.signal <> 'CRASH' as written
from j left join edges e on e.from_kind = j.state_kind and e.signal = j.signal"""))
def q_release(spark, sf):
    return planning.release(X.registry(spark, sf), X.outcomes(spark, sf), P)


# ---------------------------------------------------------------- replay

_REPLAY_REC = f"""
, s as (select id, ts, seq, signal, msg, cast(floor(epoch(ts)) as bigint) as t,
    row_number() over (partition by id order by ts, seq) as rn from signals),
rec as (
  select id, cast(0 as bigint) as rn, 'WaitToStart' as state_kind, cast(null as varchar) as state_message,
    cast(null as bigint) as next_update_time, cast(0 as bigint) as n_applied,
    cast(null as varchar) as from_kind, cast(null as varchar) as outcome
  from (select distinct id from s) ids
  union all
  select r.id, s.rn, coalesce(e.to_kind, r.state_kind),
    case when e.to_kind is null then r.state_message
         else {O.msg_sql('r.state_message', 'e.msg_rule', 's.msg', 'e.const_message')} end,
    case when e.to_kind is null then r.next_update_time else {O.next_sql('e.next_rule', 's.t')} end,
    r.n_applied + case when e.to_kind is null then 0 else 1 end,
    r.state_kind,
    case when e.to_kind is not null then 'Applied' when r.state_kind = 'Removed' then 'NotFound' else 'NotAllowed' end
  from rec r join s on s.id = r.id and s.rn = r.rn + 1
  left join edges e on e.from_kind = r.state_kind and e.signal = s.signal)"""


@query("replay_state", O.with_views(["signals", "edges"], _REPLAY_REC + """
select r.id, r.state_kind, r.state_message, r.next_update_time, m.n as n_signals, r.n_applied
from rec r join (select id, count(*) as n from s group by id) m on m.id = r.id and r.rn = m.n"""))
def q_replay_state(spark, sf):
    return replay.replay_state(X.signals(spark, sf), P)


@query("replay_log", O.with_views(["signals", "edges"], _REPLAY_REC + """
select r.id, epoch_us(s.ts) as ts_us, s.seq, s.signal, r.from_kind, r.state_kind as to_kind, r.outcome,
  r.state_message, r.next_update_time
from rec r join s on s.id = r.id and s.rn = r.rn where r.rn > 0"""))
def q_replay_log(spark, sf):
    log = replay.replay_log(X.signals(spark, sf), P)
    return log.select("id", F.unix_micros("ts").alias("ts_us"), "seq", "signal", "from_kind", "to_kind", "outcome",
                      "state_message", "next_update_time")


@query("apply_commands", O.with_views(["routed", "registry", "edges"], f"""
, s as (select id, ts, event_id as seq,
    case operation when 'stop' then 'STOP' when 'restart' then 'RESTART' else 'DELETE' end as signal,
    cast(null as varchar) as msg, cast(floor(epoch(ts)) as bigint) as t,
    row_number() over (partition by id order by ts, event_id) as rn
  from routed where operation in ('stop', 'restart', 'delete')),
rec as (
  select ids.id, cast(0 as bigint) as rn, coalesce(r.state_kind, 'Removed') as state_kind, r.state_message,
    r.next_update_time, cast(0 as bigint) as n_applied
  from (select distinct id from s) ids left join registry r on r.id = ids.id
  union all
  select r.id, s.rn, coalesce(e.to_kind, r.state_kind),
    case when e.to_kind is null then r.state_message
         else {O.msg_sql('r.state_message', 'e.msg_rule', 's.msg', 'e.const_message')} end,
    case when e.to_kind is null then r.next_update_time else {O.next_sql('e.next_rule', 's.t')} end,
    r.n_applied + case when e.to_kind is null then 0 else 1 end
  from rec r join s on s.id = r.id and s.rn = r.rn + 1
  left join edges e on e.from_kind = r.state_kind and e.signal = s.signal)
select r.id, r.state_kind, r.state_message, r.next_update_time, m.n as n_signals, r.n_applied
from rec r join (select id, count(*) as n from s group by id) m on m.id = r.id and r.rn = m.n"""))
def q_apply_commands(spark, sf):
    """D3-D5 in order: every routed stop / restart / delete applied to the record's current state,
    so a command that would lose a race is judged on the state the earlier ones left."""
    routed = commands.route_requests(X.access_log(spark, sf)).where(
        F.col("operation").isin("stop", "restart", "delete"))
    sig = routed.select("id", "ts", F.col("event_id").alias("seq"), F.upper("operation").alias("signal"),
                        F.lit(None).cast("string").alias("msg"))
    return replay.replay_state(sig, P, initial=X.registry(spark, sf))


@query("error_history", O.with_views(["signals"], """
select id, string_agg(msg, chr(10) || chr(10) order by ts, seq) as history, count(*) as n_errors
from signals where signal = 'RELEASE_ERR' and msg is not null group by id"""))
def q_error_history(spark, sf):
    return replay.error_history(X.signals(spark, sf))


@query("time_to_running", O.with_views(["signals", "edges"], _REPLAY_REC + """
, lg as (select r.id, s.ts, s.seq, r.state_kind as to_kind from rec r join s on s.id = r.id and s.rn = r.rn
         where r.rn > 0 and r.outcome = 'Applied'),
h as (select id, min(seq) filter (where rk = 1) as seq from (
        select id, seq, row_number() over (partition by id order by ts, seq) as rk from lg where to_kind = 'Running') x group by id),
b as (select id, seq, to_kind from (
        select id, seq, to_kind, row_number() over (partition by id order by ts, seq) as rk from lg
        where to_kind not in ('Running', 'WaitToStart', 'TriggerStart', 'StartInProgress')) x where rk = 1),
ids as (select distinct id from lg),
hb as (select ids.id, h.seq as h_seq, hs.ts as h_ts, b.seq as b_seq, bs.ts as b_ts, b.to_kind as b_kind
       from ids left join h on h.id = ids.id left join b on b.id = ids.id
       left join s hs on hs.id = ids.id and hs.seq = h.seq left join s bs on bs.id = ids.id and bs.seq = b.seq)
select id,
  case when h_seq is not null and (b_seq is null or h_ts < b_ts or (h_ts = b_ts and h_seq < b_seq)) then 'reached'
       when b_seq is not null then 'failed' else 'pending' end as status,
  epoch_us(h_ts) as reached_us, epoch_us(b_ts) as failed_us, b_kind as failed_kind
from hb"""))
def q_time_to_running(spark, sf):
    log = replay.replay_log(X.signals(spark, sf), P)
    t = replay.time_to_state(log, "Running", ["WaitToStart", "TriggerStart", "StartInProgress"])
    return t.select("id", "status", F.unix_micros("reached_ts").alias("reached_us"),
                    F.unix_micros("failed_ts").alias("failed_us"), "failed_kind")


@query("illegal_transitions", O.with_views(["registry", "updates", "edges"], """
select u.id, r.state_kind as from_kind, u.after_kind as to_kind
from updates u join registry r on r.id = u.id
where not exists (select 1 from edges e where e.from_kind = r.state_kind and e.to_kind = u.after_kind)"""))
def q_illegal_transitions(spark, sf):
    """Audit requested writes: which (current state -> requested state) pairs no edge allows."""
    r = X.registry(spark, sf).select("id", F.col("state_kind").alias("from_kind"))
    u = X.updates(spark, sf).select("id", F.col("after_kind").alias("to_kind"))
    return planning.illegal_transitions(u.join(r, "id").select("id", "from_kind", "to_kind"))


@query("illegal_log", O.with_views(["signals", "edges"], _REPLAY_REC + """
, lg as (select r.id, s.seq, r.from_kind, s.signal, case when s.seq % 50 = 0 then 'Running' else r.state_kind end as to_kind
  from rec r join s on s.id = r.id and s.rn = r.rn where r.rn > 0 and r.outcome = 'Applied')
select * from lg where not exists (select 1 from edges e
  where e.from_kind = lg.from_kind and e.signal = lg.signal and e.to_kind = lg.to_kind)"""))
def q_illegal_log(spark, sf):
    """D11 on the transition log, signal included: every fiftieth row has a wrong target."""
    log = replay.replay_log(X.signals(spark, sf), P).where("outcome = 'Applied'")
    wrong = F.when(F.col("seq") % 50 == 0, F.lit("Running")).otherwise(F.col("to_kind")).alias("to_kind")
    return planning.illegal_transitions(log.select("id", "seq", "from_kind", "signal", wrong), with_signal=True)


# ---------------------------------------------------------------- keyed state changes

_CAS_SQL = """
select u.id, u.before_kind, u.before_message, u.after_kind, u.after_message,
  case when r.id is null then 'NotFound'
       when u.before_kind = r.state_kind and u.before_message is not distinct from r.state_message then 'Success'
       else 'Fail' end as outcome,
  r.state_kind as current_kind, r.state_message as current_message,
  case when r.id is null then null
       when u.before_kind = r.state_kind and u.before_message is not distinct from r.state_message then u.after_kind
       else r.state_kind end as state_kind,
  case when r.id is null then null
       when u.before_kind = r.state_kind and u.before_message is not distinct from r.state_message then u.after_message
       else r.state_message end as state_message,
  case when r.id is null then null
       when u.before_kind = r.state_kind and u.before_message is not distinct from r.state_message then u.next_update_time
       else r.next_update_time end as next_update_time
from updates u left join registry r on r.id = u.id"""


@query("cas_update", O.with_views(["registry", "updates"], _CAS_SQL))
def q_cas_update(spark, sf):
    return registry.cas_update(X.updates(spark, sf), X.registry(spark, sf))


@query("conditional_delete", O.with_views(["registry", "updates"], """
select u.id, u.before_kind, u.before_message,
  case when r.id is null then 'NotFound'
       when u.before_kind = r.state_kind and u.before_message is not distinct from r.state_message then 'Success'
       else 'Fail' end as outcome,
  r.state_kind as current_kind, r.state_message as current_message
from updates u left join registry r on r.id = u.id"""))
def q_conditional_delete(spark, sf):
    """Expected-state deletes (the CAS requests' expected states) against the snapshot."""
    out, _ = registry.conditional_delete(X.updates(spark, sf), X.registry(spark, sf))
    return out


@query("apply_changes", O.with_views(["registry", "updates"], f"""
, c as ({_CAS_SQL})
select r.id, case when c.outcome = 'Success' then c.after_kind else r.state_kind end as state_kind,
  case when c.outcome = 'Success' then c.after_message else r.state_message end as state_message,
  case when c.outcome = 'Success' then c.next_update_time else r.next_update_time end as next_update_time
from registry r left join (select * from c where outcome = 'Success') c on c.id = r.id"""))
def q_apply_changes(spark, sf):
    """A4: write the successful CAS updates back into the next registry snapshot."""
    reg = X.registry(spark, sf)
    won = registry.cas_update(X.updates(spark, sf), reg).where(F.col("outcome") == "Success").select(
        "id", "state_kind", "state_message", "next_update_time", F.lit(False).alias("removed"))
    return registry.apply_changes(reg, won).select("id", "state_kind", "state_message", "next_update_time")


@query("delete_survivors", O.with_views(["registry", "updates"], """
select r.id, r.state_kind, r.state_message, r.next_update_time from registry r
where not exists (select 1 from updates u where u.id = r.id and u.before_kind = r.state_kind
  and u.before_message is not distinct from r.state_message)"""))
def q_delete_survivors(spark, sf):
    """The registry that conditional deletes leave."""
    _, left = registry.conditional_delete(X.updates(spark, sf), X.registry(spark, sf))
    return left.select("id", "state_kind", "state_message", "next_update_time")


@query("write_back", O.with_views(["routed", "registry", "edges", "created"], """
, gone as (select distinct r.id from routed c join registry r on r.id = c.id
  join edges e on e.from_kind = r.state_kind and e.signal = 'DELETE' where c.operation = 'delete')
select id, name, version, state_kind, state_message, next_update_time from registry where id not in (select id from gone)
union all select id, name, version, state_kind, cast(null as varchar), next_update_time from created"""))
def q_write_back(spark, sf):
    """A4: one write-back with inserts (bulk creates) and removals (allowed delete commands)."""
    reg = X.registry(spark, sf)
    good, _ = ingest.split_requests(X.requests(spark, sf))
    new = ingest.bulk_create(good, P).select("id", "name", "version", "state_kind", "state_message", "next_update_time", F.lit(False).alias("removed"), F.lit(True).alias("created"))
    asked = commands.route_requests(X.access_log(spark, sf)).where(F.col("operation") == "delete").select("id").distinct()
    gone = planning.plan_command(asked, reg, "DELETE", P).where("removed").select(
        "id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("version"), F.col("new_kind").alias("state_kind"),
        F.col("new_message").alias("state_message"), F.col("new_next_update_time").alias("next_update_time"), "removed", F.lit(False).alias("created"))
    return registry.apply_changes(reg, new.unionByName(gone)).select("id", "name", "version", "state_kind", "state_message", "next_update_time")


@query("custom_rules", O.with_views(["registry"], f"""
select id, state_kind as from_kind, case state_kind when 'TriggerStart' then 'ErrorClean' when 'TriggerTermination' then 'WaitToTerminate' end as state_kind,
  case state_kind when 'TriggerStart' then 'gave up' end as state_message,
  cast(case state_kind when 'TriggerTermination' then {O.NOW} + {O.INTERVAL} end as bigint) as next_update_time
from registry where next_update_time is not null and next_update_time < {O.NOW}
  and state_kind in ('TriggerStart', 'TriggerTermination', 'ErrorTriggerClean')"""))
def q_custom_rules(spark, sf):
    """A caller's rule table: a start that times out fails for good, a clean-up has no timeout edge."""
    rules = literal_rows(spark, [
        ("TriggerStart", "TIMEOUT", "ErrorClean", "const", "none", "custom", "gave up"),
        ("TriggerTermination", "TIMEOUT", "WaitToTerminate", "clear", "interval", "custom", None)], EDGE_SCHEMA)
    return planning.retry_timeouts(X.registry(spark, sf), P, edges=rules)


@query("cas_sequence", O.with_views(["registry", "cas_requests"], """
, u as (select *, row_number() over (partition by id order by ts, seq) as rn from cas_requests),
rec as (
  select ids.id, cast(0 as bigint) as rn, r.state_kind as k, r.state_message as m, r.next_update_time as n,
    r.id is not null as f, cast(null as varchar) as outcome, cast(null as varchar) as ck, cast(null as varchar) as cm
  from (select distinct id from u) ids left join registry r on r.id = ids.id
  union all
  select r.id, u.rn,
    case when r.f and u.before_kind = r.k and u.before_message is not distinct from r.m then u.after_kind else r.k end,
    case when r.f and u.before_kind = r.k and u.before_message is not distinct from r.m then u.after_message else r.m end,
    case when r.f and u.before_kind = r.k and u.before_message is not distinct from r.m then u.next_update_time else r.n end,
    r.f,
    case when not r.f then 'NotFound'
         when u.before_kind = r.k and u.before_message is not distinct from r.m then 'Success' else 'Fail' end,
    case when r.f then r.k end, case when r.f then r.m end
  from rec r join u on u.id = r.id and u.rn = r.rn + 1)
select u.id, epoch_us(u.ts) as ts_us, u.seq, u.before_kind, u.before_message, u.after_kind, u.after_message,
  r.outcome, r.ck as current_kind, r.cm as current_message,
  case when r.f then r.k end as state_kind, case when r.f then r.m end as state_message,
  case when r.f then r.n end as next_update_time
from rec r join u on u.id = r.id and u.rn = r.rn where r.rn > 0"""))
def q_cas_sequence(spark, sf):
    """D1 for same-id batches: attempts applied in (ts, seq) order, each on the state the last left."""
    out = cas_chain.cas_sequence(X.cas_requests(spark, sf), X.registry(spark, sf))
    return out.select("id", F.unix_micros("ts").alias("ts_us"), *[c for c in out.columns if c not in ("id", "ts")])


# ---------------------------------------------------------------- requests and commands

@query("route_requests", O.with_views(["routed"], """
select event_id, method, path, template, id, operation, route_status from routed"""))
def q_route_requests(spark, sf):
    return commands.route_requests(X.access_log(spark, sf)).select(
        "event_id", "method", "path", "template", "id", "operation", "route_status")


def _plan_sql(op: str, signal: str, verb: str) -> str:
    return O.with_views(["routed", "registry", "edges"], f"""
select c.event_id, c.id, case when r.id is null then 'NotFound' when e.to_kind is null then 'NotAllowed' else 'Success' end as outcome,
  r.state_kind as current_kind, e.to_kind as new_kind,
  case when e.to_kind is not null then {O.msg_sql('r.state_message', 'e.msg_rule', 'cast(null as varchar)', 'e.const_message')} end as new_message,
  case when e.to_kind is not null then {O.next_sql('e.next_rule')} end as new_next_update_time,
  case when r.id is null then 'Not found: Engine ' || c.id || ' not found'
       when e.to_kind is null then 'Not allowed: Engine ' || c.id || ' is in ' || {O.debug_sql('r.state_kind', 'r.state_message')}
         || ' state, cannot be {verb}' end as error
from (select * from routed where operation = '{op}') c left join registry r on r.id = c.id
left join edges e on e.from_kind = r.state_kind and e.signal = '{signal}'""")


def _plan_query(op: str, signal: str):
    def run(spark, sf):
        c = commands.route_requests(X.access_log(spark, sf)).where(F.col("operation") == op).select("event_id", "id")
        return planning.plan_command(c, X.registry(spark, sf), signal, P).select(
            "event_id", "id", "outcome", "current_kind", "new_kind", "new_message", "new_next_update_time", "error")
    return run


for _op, _sig, _verb in [("stop", "STOP", "stopped"), ("restart", "RESTART", "restarted"), ("delete", "DELETE", "deleted")]:
    query(f"plan_{_op}", _plan_sql(_op, _sig, _verb))(_plan_query(_op, _sig))


@query("bulk_lookup", O.with_views(["routed", "registry"], """
select c.event_id, c.id, case when r.id is null then 'NotFound' else 'Found' end as status, r.state_kind, r.state_message,
  case when r.id is null then 'Not found: Engine ' || c.id || ' not found' end as error
from (select * from routed where operation = 'get') c left join registry r on r.id = c.id"""))
def q_bulk_lookup(spark, sf):
    c = commands.route_requests(X.access_log(spark, sf)).where(F.col("operation") == "get").select("event_id", "id")
    return registry.bulk_lookup(c, X.registry(spark, sf))


@query("outcome_status", O.with_views(["routed", "registry", "edges"], f"""
, c as (select event_id, id, operation, case operation when 'stop' then 'STOP' when 'restart' then 'RESTART'
          when 'delete' then 'DELETE' else 'GET' end as signal
        from routed where operation in ('get', 'stop', 'restart', 'delete')),
j as (select c.*, r.id as rid, r.state_kind, r.state_message, e.to_kind
      from c left join registry r on r.id = c.id left join edges e on e.from_kind = r.state_kind and e.signal = c.signal),
k as (select *, case when rid is null then 'NotFound' when signal = 'GET' then 'Ok' when to_kind is not null then 'Ok'
        else 'NotAllowed' end as kind from j)
select event_id, id, operation, kind,
  case kind when 'Ok' then 200 when 'NotFound' then 404 when 'NotAllowed' then 403 end as http_status,
  case kind when 'NotFound' then 'Not found: Engine ' || id || ' not found'
    when 'NotAllowed' then 'Not allowed: Engine ' || id || ' is in ' || {O.debug_sql('state_kind', 'state_message')}
      || ' state, cannot be ' || case signal when 'STOP' then 'stopped' when 'RESTART' then 'restarted' else 'deleted' end
  end as message,
  case kind when 'NotFound' then 'Not found' when 'NotAllowed' then 'Not allowed' end as kind_display,
  case when signal = 'GET' then state_kind else to_kind end as state_kind
from k"""))
def q_outcome_status(spark, sf):
    return commands.command_responses(commands.route_requests(X.access_log(spark, sf)), X.registry(spark, sf), P)


# ---------------------------------------------------------------- competing claims

@query("acquire", O.with_views(["claims", "registry", "due", "edges"], f"""
, w as (select id, ts, claimant, seq, tiebreak from (
    select *, row_number() over (partition by id order by ts, claimant, seq, tiebreak) as rk from claims) x where rk = 1),
t as (select d.id, e.to_kind, {O.msg_sql('d.state_message', 'e.msg_rule', 'cast(null as varchar)', 'e.const_message')} as to_msg,
        {O.next_sql('e.next_rule')} as to_next
      from due d join edges e on e.from_kind = d.state_kind and e.signal = 'ACQUIRE'
      where d.state_kind in ('WaitToStart', 'WaitToTerminate', 'ErrorWaitToClean'))
select c.id, epoch_us(c.ts) as ts_us, c.claimant, c.seq, c.tiebreak,
  case when r.id is null then 'NotFound' when t.id is null then 'Fail'
       when c.ts = w.ts and c.claimant = w.claimant and c.seq = w.seq and c.tiebreak = w.tiebreak then 'Success' else 'Fail' end as outcome,
  case when t.id is not null then t.to_kind else r.state_kind end as state_kind,
  case when t.id is not null then t.to_msg else r.state_message end as state_message,
  case when r.id is not null and t.id is not null and c.ts = w.ts and c.claimant = w.claimant and c.seq = w.seq
       and c.tiebreak = w.tiebreak then t.to_next end as next_update_time
from claims c join w on w.id = c.id left join registry r on r.id = c.id left join t on t.id = c.id"""))
def q_acquire(spark, sf):
    a = planning.acquire(X.claims(spark, sf), X.registry(spark, sf), P)
    return a.select("id", F.unix_micros("ts").alias("ts_us"), "claimant", "seq", "tiebreak", "outcome",
                    "state_kind", "state_message", "next_update_time")


# ---------------------------------------------------------------- strict ingest

def _config_kv(c):
    return F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))


@query("ingest_valid", O.with_views(["valid"], """
select request_id, name, engine_type, version, array_to_string(config_kv, ',') as config_text,
  len(config_kv) as n_config from valid"""))
def q_ingest_valid(spark, sf):
    good, _ = ingest.split_requests(X.requests(spark, sf))
    return good.select("request_id", "name", "engine_type", "version",
                       F.array_join(_config_kv(F.col("config")), ",").alias("config_text"),
                       F.size("config").cast("bigint").alias("n_config"))


@query("ingest_rejects", O.with_views(["checked"], """
select request_id, body, reason, detail from checked where reason is not null"""))
def q_ingest_rejects(spark, sf):
    _, bad = ingest.split_requests(X.requests(spark, sf))
    return bad


@query("bulk_create", O.with_views(["created"], f"""
select id, name, engine_type, version, state_kind, next_update_time, array_to_string(config_kv, ',') as config_text,
  strftime(to_timestamp({O.NOW}), '%Y-%m-%d %H:%M:%S') || ' +00:00:00' as create_time
from created"""))
def q_bulk_create(spark, sf):
    good, _ = ingest.split_requests(X.requests(spark, sf))
    c = ingest.bulk_create(good, P)
    return c.select("id", "name", "engine_type", "version", "state_kind", "next_update_time",
                    F.array_join(_config_kv(F.col("config")), ",").alias("config_text"),
                    C.format_time("create_time").alias("create_time"))


@query("state_decode", O.with_views(["state_wire"], """
, d as (select id, wire, wire0,
  case when wire is null then 'malformed'
       when json_type(wire) = 'VARCHAR' then case when json_extract_string(wire, '$') not in
         ('WaitToStart', 'TriggerStart', 'StartInProgress', 'Running', 'WaitToTerminate', 'TriggerTermination',
          'TerminateInProgress', 'Terminated') then 'unknown_variant' end
       when json_type(wire) = 'OBJECT' then case when len(json_keys(wire)) <> 1 then 'not_one_key'
         when json_keys(wire)[1] not in ('ErrorWaitToClean', 'ErrorTriggerClean', 'ErrorCleanInProgress', 'ErrorClean')
           then 'unknown_variant'
         when json_type(wire, '$."' || json_keys(wire)[1] || '"') <> 'VARCHAR' then 'bad_type' end
       else 'bad_type' end as reason
  from (select id, case when json_valid(wire0) then wire0 end as wire, wire0 from (select id, wire as wire0 from state_wire) a) b)
select id, wire0 as wire, reason,
  case when reason is null then case when json_type(wire) = 'VARCHAR' then json_extract_string(wire, '$')
                                     else json_keys(wire)[1] end end as kind,
  case when reason is null and json_type(wire) = 'OBJECT' then json_extract_string(wire, '$."' || json_keys(wire)[1] || '"') end as message
from d"""))
def q_state_decode(spark, sf):
    w = X.state_wire(spark, sf)
    d = ingest.decode_state(F.col("wire"))
    return w.select("id", "wire", d["reason"].alias("reason"), d["kind"].alias("kind"), d["message"].alias("message"))


@query("state_encode", O.with_views(["registry"], f"""
select id, case when state_kind like 'Error%' then json_object(state_kind, state_message)::varchar
                else '"' || state_kind || '"' end as wire,
  {O.debug_sql('state_kind', 'state_message')} as debug_text
from registry"""))
def q_state_encode(spark, sf):
    r = X.registry(spark, sf)
    return r.select("id", C.encode_state("state_kind", "state_message").alias("wire"),
                    C.debug_text("state_kind", "state_message").alias("debug_text"))


@query("id_validation", O.with_views(["id_wire"], """
, v as (select request_id, wire,
  coalesce(json_type(wire) = 'OBJECT' and len(json_keys(wire)) = 1 and json_keys(wire)[1] = 'id'
           and json_type(wire, '$.id') = 'VARCHAR', false) as ok_shape, wire0
  from (select request_id, wire as wire0, case when json_valid(wire) then wire end as wire from id_wire) a)
select request_id, wire0 as wire,
  case when ok_shape and json_extract_string(wire, '$.id') <> '' then json_extract_string(wire, '$.id') end as id,
  case when not ok_shape then 'bad_shape' when json_extract_string(wire, '$.id') = '' then 'empty' end as reason,
  case when not ok_shape then 'Failed to deserialize EngineId, expect a map `{"id": <non empty string>}`'
       when json_extract_string(wire, '$.id') = '' then 'Not allowed: Engine id cannot be empty.' end as detail
from v"""))
def q_id_validation(spark, sf):
    w = X.id_wire(spark, sf)
    v = ingest.validate_id(F.col("wire"))
    return w.select("request_id", "wire", v["id"].alias("id"), v["reason"].alias("reason"), v["detail"].alias("detail"))


# ---------------------------------------------------------------- launch configuration

_PREFIX = launch.DEFAULT_APP_PREFIX


@query("derived_names", O.with_views(["registry"], f"""
select id, '{_PREFIX}' || id as app_id, '{_PREFIX}' || id || '-driver' as driver_name, '{_PREFIX}' || id as service_name,
  'apache/spark:' || version as image, 'org.apache.spark:spark-connect_2.12:' || version as package
from registry"""))
def q_derived_names(spark, sf):
    r = X.registry(spark, sf)
    n = launch.derived_names(F.col("id"), F.col("version"))
    return r.select("id", *[c.alias(k) for k, c in n.items()])


_RESERVED_SQL = "[" + ", ".join(f"'{k}'" for k in launch.RESERVED_KEYS) + "]"


@query("reserved_keys", O.with_views(["created"], f"""
select id, list_min(list_filter({_RESERVED_SQL}, lambda rk: list_contains(list_transform(config_kv, lambda kv: split_part(kv, '=', 1)), rk))) as reserved_key
from created"""))
def q_reserved_keys(spark, sf):
    good, _ = ingest.split_requests(X.requests(spark, sf))
    c = ingest.bulk_create(good, P)
    return c.select("id", launch.reserved_key(F.col("config")).alias("reserved_key"))


@query("version_check", O.with_views(["registry"], """
select id, version, version in ('3.5.3', '3.5.4') as supported,
  case when version not in ('3.5.3', '3.5.4') then 'Not allowed: Spark version ' || version
    || ' is not supported. Supported versions: ["3.5.3", "3.5.4"]' end as error
from registry"""))
def q_version_check(spark, sf):
    r = X.registry(spark, sf)
    plan = launch.launch_plan(F.col("id"), F.col("version"), F.col("config"))
    return r.select("id", "version", launch.version_supported(F.col("version")).alias("supported"),
                    F.when(plan["status"] == "bad_version", plan["error"]).alias("error"))


@query("launch_args", O.with_views(["created"], f"""
, k as (select *, list_min(list_filter({_RESERVED_SQL}, lambda rk: list_contains(list_transform(config_kv, lambda kv: split_part(kv, '=', 1)), rk))) as rk
        from created),
a as (select id, version, rk,
  case when version not in ('3.5.3', '3.5.4') then 'bad_version' when rk is not null then 'reserved_key' else 'ok' end as status,
  ['--master', 'k8s://https://kubernetes:443', '--deploy-mode', 'client', '--packages', 'org.apache.spark:spark-connect_2.12:' || version,
   '--conf', 'spark.app.id={_PREFIX}' || id, '--conf', 'spark.driver.extraJavaOptions=-Divy.cache.dir=/tmp -Divy.home=/tmp',
   '--conf', 'spark.driver.host={_PREFIX}' || id, '--conf', 'spark.kubernetes.container.image=apache/spark:' || version,
   '--conf', 'spark.kubernetes.driver.pod.name={_PREFIX}' || id || '-driver',
   '--conf', 'spark.kubernetes.executor.podNamePrefix={_PREFIX}' || id]
  || flatten(list_transform(config_kv, lambda kv: ['--conf', kv])) as args
  from k)
select id, status,
  case status when 'bad_version' then 'Not allowed: Spark version ' || version || ' is not supported. Supported versions: ["3.5.3", "3.5.4"]'
    when 'reserved_key' then 'Not allowed: The config ' || rk || ' is not allowed as it is reserved.' end as error,
  case when status = 'ok' then len(args) end as n_args,
  case when status = 'ok' then to_json(args)::varchar end as args_json
from a"""))
def q_launch_args(spark, sf):
    good, _ = ingest.split_requests(X.requests(spark, sf))
    c = ingest.bulk_create(good, P)
    plan = launch.with_launch_plan(c)
    return plan.select("id", "status", "error", F.when(F.col("status") == "ok", F.size("args").cast("bigint")).alias("n_args"), F.to_json("args").alias("args_json"))


# ---------------------------------------------------------------- projections

@query("state_classes", O.with_views(["registry"], """
select r.id, r.state_kind, d.state_class, d.flow, d.has_message from registry r join (values
  ('WaitToStart', 'waiting', 'start', false), ('TriggerStart', 'trigger', 'start', false),
  ('StartInProgress', 'in_progress', 'start', false), ('Running', 'in_progress', 'start', false),
  ('WaitToTerminate', 'waiting', 'terminate', false), ('TriggerTermination', 'trigger', 'terminate', false),
  ('TerminateInProgress', 'in_progress', 'terminate', false), ('Terminated', 'stable', 'terminate', false),
  ('ErrorWaitToClean', 'waiting', 'error_clean', true), ('ErrorTriggerClean', 'trigger', 'error_clean', true),
  ('ErrorCleanInProgress', 'in_progress', 'error_clean', true), ('ErrorClean', 'stable', 'error_clean', true))
  d(state_kind, state_class, flow, has_message) on d.state_kind = r.state_kind"""))
def q_state_classes(spark, sf):
    text = [(s, i, c, f, int(m)) for s, i, c, f, m in state_dimension_rows()]
    schema = T._parse_datatype_string("state_kind string, state_index int, state_class string, flow string, has_message boolean")
    dim = F.broadcast(literal_rows(spark, text, schema))
    return X.registry(spark, sf).join(dim, "state_kind").select("id", "state_kind", "state_class", "flow", "has_message")


@query("next_update", O.with_views(["registry"], f"""
select id, state_kind, cast(case when state_kind in ('WaitToStart', 'WaitToTerminate', 'ErrorWaitToClean') then {O.NOW}
  when state_kind in ('TriggerStart', 'TriggerTermination', 'ErrorTriggerClean') then {O.NOW} + {O.TIMEOUT}
  when state_kind in ('StartInProgress', 'Running', 'TerminateInProgress', 'ErrorCleanInProgress') then {O.NOW} + {O.INTERVAL}
  end as bigint) as next_update from registry"""))
def q_next_update(spark, sf):
    r = X.registry(spark, sf)
    return r.select("id", "state_kind", C.next_update_time("state_kind", P.now, P.interval, P.timeout).alias("next_update"))


@query("time_format", O.with_views(["registry"], """
select id, strftime(create_time, '%Y-%m-%d %H:%M:%S') || ' +00:00:00' as created_text from registry"""))
def q_time_format(spark, sf):
    return X.registry(spark, sf).select("id", C.format_time("create_time").alias("created_text"))


@query("time_parse", O.with_views(["time_text"], """
select request_id, text,
  case when regexp_matches(text, '^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2} [+-][0-9]{2}:[0-9]{2}:[0-9]{2}$') then
    cast(epoch(try_strptime(substr(text, 1, 19), '%Y-%m-%d %H:%M:%S')) as bigint)
    - (case when substr(text, 21, 1) = '-' then -1 else 1 end)
      * (cast(substr(text, 22, 2) as bigint) * 3600 + cast(substr(text, 25, 2) as bigint) * 60 + cast(substr(text, 28, 2) as bigint))
  end as epoch_seconds
from time_text"""))
def q_time_parse(spark, sf):
    t = X.time_text(spark, sf)
    return t.select("request_id", "text", F.unix_seconds(C.parse_time("text")).alias("epoch_seconds"))


@query("elapsed", O.with_views(["registry"], f"""
select id, {O.NOW} - cast(floor(epoch(create_time)) as bigint) as elapsed_seconds from registry"""))
def q_elapsed(spark, sf):
    return X.registry(spark, sf).select("id", C.elapsed_seconds("create_time", P.now).alias("elapsed_seconds"))


@query("phase_normalize", O.with_views(["registry", "last_obs"], """
select r.id, r.state_kind, l.phase as raw_phase,
  case when l.id is null then 'NotExisted' when l.phase is null then 'Unknown'
       when l.phase in ('Pending', 'Running', 'Succeeded', 'Failed', 'Unknown') then l.phase end as phase,
  not (l.id is null or l.phase is null or l.phase in ('Pending', 'Running', 'Succeeded', 'Failed', 'Unknown')) as illegal
from registry r left join last_obs l on l.id = r.id
where r.state_kind in ('StartInProgress', 'Running', 'TerminateInProgress', 'ErrorCleanInProgress')"""))
def q_phase_normalize(spark, sf):
    recs = X.registry(spark, sf).where(F.col("state_kind").isin(*IN_PROGRESS)).select("id", "state_kind")
    return observe.phase_normalize(recs, X.observations(spark, sf))


# ---------------------------------------------------------------- streaming

@query("stream_replay", ORACLE["replay_state"])
def q_stream_replay(spark, sf):
    """G1: the lifecycle stream over the events file stream equals the batch replay."""
    out_root = S.scratch_dir(spark, "stream-replay")
    stream = S.lifecycle_stream(X.signals_from(X.stream_table(spark, sf, "events")), P)
    S.run_available_now(stream, f"{out_root}/out", f"{out_root}/ck")
    cur = S.latest_per_id(spark.read.parquet(f"{out_root}/out"))
    return cur.select("id", "state_kind", "state_message", "next_update_time", "n_signals", "n_applied")


_TRIGGERS = "('TriggerStart', 'TriggerTermination', 'ErrorTriggerClean')"
_BACK = ("case {0} when 'TriggerStart' then 'WaitToStart' when 'TriggerTermination' then 'WaitToTerminate' "
         "else 'ErrorWaitToClean' end")
# the fold with deadlines: before a signal, a trigger state whose deadline is past is back to waiting
_TIMED_REC = f"""
, s as (select id, ts, seq, signal, msg, cast(floor(epoch(ts)) as bigint) as t,
    row_number() over (partition by id order by ts, seq) as rn from signals),
rec as (
  select id, cast(0 as bigint) as rn, 'WaitToStart' as state_kind, cast(null as varchar) as state_message,
    cast(null as bigint) as next_update_time, cast(0 as bigint) as n_applied
  from (select distinct id from s) ids
  union all
  select x.id, x.rn, coalesce(e.to_kind, x.kind),
    case when e.to_kind is null then x.state_message
         else {O.msg_sql('x.state_message', 'e.msg_rule', 'x.msg', 'e.const_message')} end,
    case when e.to_kind is null then x.n else {O.next_sql('e.next_rule', 'x.t')} end,
    x.n_applied + case when e.to_kind is null then 0 else 1 end
  from (select r.id, s.rn, s.t, s.signal, s.msg, r.state_message, r.n_applied,
          case when r.state_kind in {_TRIGGERS} and r.next_update_time < s.t then {_BACK.format('r.state_kind')} else r.state_kind end as kind,
          case when r.state_kind in {_TRIGGERS} and r.next_update_time < s.t then r.next_update_time + 1 else r.next_update_time end as n
        from rec r join s on s.id = r.id and s.rn = r.rn + 1) x
  left join edges e on e.from_kind = x.kind and e.signal = x.signal)"""


@query("stream_timeouts", O.with_views(["signals", "edges"], _TIMED_REC + """
, fin as (select r.id, r.state_kind, r.state_message, r.next_update_time, m.n as n_signals, r.n_applied
          from rec r join (select id, count(*) as n from s group by id) m on m.id = r.id and r.rn = m.n),
wm as (select max(epoch_ms(ts)) as w from signals),
fired as (select fin.*, state_kind in ('TriggerStart', 'TriggerTermination', 'ErrorTriggerClean')
            and (next_update_time + 1) * 1000 <= w as timed_out from fin, wm)
select id,
  case when timed_out then case state_kind when 'TriggerStart' then 'WaitToStart'
    when 'TriggerTermination' then 'WaitToTerminate' else 'ErrorWaitToClean' end else state_kind end as state_kind,
  state_message, case when timed_out then next_update_time + 1 else next_update_time end as next_update_time, n_signals, n_applied,
  case when timed_out then 'timer' else 'signals' end as via
from fired"""))
def q_stream_timeouts(spark, sf):
    """As G1, plus event-time timers that time out records left in a trigger state.

    The events file drains in one micro-batch, so the watermark ends at the newest event time and
    every record still in a trigger state whose deadline is past by then times out (in the first
    second after it: back to waiting, message kept, next update = that second). So does a record
    whose next signal comes after its deadline, before that signal.
    """
    out_root = S.scratch_dir(spark, "stream-timeouts")
    stream = S.lifecycle_stream(X.signals_from(X.stream_table(spark, sf, "events")), P, auto_timeout=True)
    S.run_available_now(stream, f"{out_root}/out", f"{out_root}/ck")
    cur = S.latest_per_id(spark.read.parquet(f"{out_root}/out"))
    return cur.select("id", "state_kind", "state_message", "next_update_time", "n_signals", "n_applied", "via")


@query("stream_ingest", ORACLE["bulk_create"])
def q_stream_ingest(spark, sf):
    """Strict ingest of the orders file stream; the good sink equals the batch bulk create."""
    out_root = S.scratch_dir(spark, "stream-ingest")
    S.ingest_stream(X.stream_table(spark, sf, "orders"), f"{out_root}/out", f"{out_root}/ck", P,
                    to_requests=X.requests_from)
    c = spark.read.parquet(f"{out_root}/out/good").drop("batch")
    return c.select("id", "name", "engine_type", "version", "state_kind", "next_update_time",
                    F.array_join(_config_kv(F.col("config")), ",").alias("config_text"),
                    C.format_time("create_time").alias("create_time"))


def _round_sql(e: int) -> str:
    """Round ``e`` as CTEs: the registry r<e> and the observations so far give r<e+1>."""
    now = f"({O.NOW} + {100 * e})"
    return f"""
, last{e} as (select id, phase from (select id, phase, row_number() over (partition by id
    order by ts desc, l_linenumber desc, l_partkey desc, l_suppkey desc) as rn from observations where l_partkey % 3 <= {e}) x where rn = 1),
j{e} as (select d.id, d.state_kind, d.state_message, o.err_msg,
    case when d.state_kind in ('WaitToStart', 'WaitToTerminate', 'ErrorWaitToClean') then
           case when o.id is null then 'CRASH' when o.err_msg is null then 'RELEASE_OK' else 'RELEASE_ERR' end
         when d.state_kind in {_TRIGGERS} then 'TIMEOUT' else 'PHASE_' || coalesce(l.phase, 'Unknown') end as action
  from r{e} d left join last{e} l on l.id = d.id left join outcomes o on o.id = d.id
  where d.next_update_time is not null and d.next_update_time < {now}),
c{e} as (select j.id, e.to_kind, {O.msg_sql('j.state_message', 'e.msg_rule', 'j.err_msg', 'e.const_message')} as m,
    {O.next_sql('e.next_rule', now)} as n
  from j{e} j join rules e on e.from_kind = j.state_kind and e.signal = j.action),
r{e + 1} as (select r.id, coalesce(c.to_kind, r.state_kind) as state_kind,
    case when c.id is null then r.state_message else c.m end as state_message,
    case when c.id is null then r.next_update_time else c.n end as next_update_time
  from r{e} r left join c{e} c on c.id = r.id)"""


@query("monitor_rounds", O.with_views(["registry", "observations", "outcomes", "edges"], """
, acq as (select from_kind, to_kind as mid, msg_rule as a_msg, next_rule as a_next from edges where signal = 'ACQUIRE'),
rules as (
  select a.from_kind, r.signal, r.to_kind, case when r.msg_rule = 'keep' then a.a_msg else r.msg_rule end as msg_rule,
    r.next_rule, r.const_message
  from acq a join edges r on r.from_kind = a.mid and r.signal in ('RELEASE_OK', 'RELEASE_ERR')
  union all select from_kind, 'CRASH', mid, a_msg, a_next, cast(null as varchar) from acq
  union all select from_kind, signal, to_kind, msg_rule, next_rule, const_message from edges
    where signal = 'TIMEOUT' or signal like 'PHASE_%'),
r0 as (select id, state_kind, state_message, next_update_time from registry)""" + "".join(map(_round_sql, range(3))) + """
select * from r3"""))
def q_monitor_rounds(spark, sf):
    """Three rounds, 100 seconds apart; a third of the observations arrives before each."""
    root = S.scratch_dir(spark, "monitor-rounds")
    registry.write_registry(X.registry(spark, sf), f"{root}/registry/v=0")
    obs = X.observations(spark, sf)
    for third in range(3):
        obs.where(F.col("l_partkey") % 3 == third).write.parquet(f"{root}/obs/{third}")
        stream = spark.readStream.schema(obs.schema).option("recursiveFileLookup", "true").parquet(f"{root}/obs")
        S.monitor_rounds(stream, f"{root}/registry", X.outcomes(spark, sf), f"{root}/ck", P, now_fn=lambda e: P.now + 100 * e)
    return registry.read_registry(spark, f"{root}/registry/v=3").select("id", "state_kind", "state_message", "next_update_time")


from fleetstate.plans import live  # noqa: E402, F401 - registers the queries of running streams and monitors

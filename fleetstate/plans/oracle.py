"""Oracle SQL (DuckDB dialect) for every registered query, over the raw test tables.

The driver's DuckDB has only the raw tables, so each query carries the bridge views it
needs as CTEs. The rule table is a VALUES list of its own.
"""

from __future__ import annotations

from fleetstate.model import DEFAULT_PARAMS, FOLD_STATES, SIGNALS

P = DEFAULT_PARAMS
NOW, INTERVAL, TIMEOUT = P.now, P.interval, P.timeout


def _epoch(x: str) -> str:
    return f"cast(floor(epoch({x})) as bigint)"


PROPS_K = "cast(json_extract_string(props,'$.k') as int)"


def _q(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return str(v)
    return "'" + str(v).replace("'", "''") + "'"


VIEWS: dict[str, str] = {}

VIEWS["registry"] = f"""
select concat('eng-', cast(o_orderkey as varchar)) as id,
  concat('job-', cast(o_custkey as varchar)) as name, 'Spark' as engine_type,
  case cast(floor(o_orderkey/12) as bigint) % 4 when 0 then '3.5.2' when 1 then '3.5.3' when 2 then '3.5.4' else '3.5.5' end as version,
  case o_orderkey % 12 when 0 then 'WaitToStart' when 1 then 'TriggerStart' when 2 then 'StartInProgress' when 3 then 'Running'
    when 4 then 'WaitToTerminate' when 5 then 'TriggerTermination' when 6 then 'TerminateInProgress' when 7 then 'Terminated'
    when 8 then 'ErrorWaitToClean' when 9 then 'ErrorTriggerClean' when 10 then 'ErrorCleanInProgress' else 'ErrorClean' end as state_kind,
  case when o_orderkey % 12 >= 8 then o_orderpriority end as state_message,
  o_orderdate as create_time,
  case when o_orderkey % 12 in (7, 11) then null else {_epoch('o_orderdate')} + o_custkey % 3600 end as next_update_time,
  o_orderkey, o_custkey
from orders"""

VIEWS["observations"] = """
select concat('eng-', cast(l_orderkey as varchar)) as id, l_shipdate as ts, l_linenumber, l_partkey, l_suppkey,
  case l_partkey % 6 when 0 then 'Pending' when 1 then 'Running' when 2 then 'Succeeded' when 3 then 'Failed' when 4 then 'Unknown' end as phase
from lineitem"""

VIEWS["signals"] = f"""
select concat('eng-', cast(user_id as varchar)) as id, ts, event_id as seq,
  case when k = 0 then 'DELETE' else case k % 12 when 0 then 'STOP' when 1 then 'RESTART' when 2 then 'ACQUIRE' when 3 then 'RELEASE_OK'
    when 4 then 'RELEASE_ERR' when 5 then 'TIMEOUT' when 6 then 'PHASE_Pending' when 7 then 'PHASE_Running' when 8 then 'PHASE_Succeeded'
    when 9 then 'PHASE_Failed' when 10 then 'PHASE_Unknown' else 'PHASE_NotExisted' end end as signal,
  case when k <> 0 and k % 12 = 4 then concat('err-', cast(event_id as varchar)) end as msg
from (select *, {PROPS_K} as k from events) x"""

VIEWS["outcomes"] = """
select concat('eng-', cast(o_orderkey as varchar)) as id, case when o_orderkey % 5 = 0 then 'boom' end as err_msg
from orders where o_orderkey % 7 <> 0"""

VIEWS["updates"] = """
select case when o_orderkey % 11 = 0 then concat('none-', cast(o_orderkey as varchar)) else id end as id,
  case when o_custkey % 2 = 0 then state_kind else 'Running' end as before_kind,
  case when o_orderkey % 3 = 1 then 'an older message' else state_message end as before_message, 'Terminated' as after_kind,
  cast(null as varchar) as after_message, cast(null as bigint) as next_update_time
from registry"""

VIEWS["requests"] = """
select o_orderkey as request_id,
  case o_orderkey % 10
    when 4 then concat('{"name":"job-', cast(o_custkey as varchar), '","engine_type":"Spark","version":"3.5.3","config":null}')
    when 5 then '{"engine_type":"Spark","version":"3.5.3","config":{}}'
    when 6 then concat('{"name":"job-', cast(o_custkey as varchar), '","invalid":"invalid"}')
    when 7 then concat('{"name":"job-', cast(o_custkey as varchar), '","engine_type":"foo","config":{}}')
    when 8 then concat('{"name":"job-', cast(o_custkey as varchar), '","engine_type":"Spark","version":"3.5.4","config":{"spark.executor.instances":1}}')
    when 9 then concat('{"name":"job-', cast(o_custkey as varchar), '"')
    when 3 then concat('{"name":"job-', cast(o_custkey as varchar), '","engine_type":"Spark","version":"3.5.4","config":{"spark.app.id":"x"}}')
    else concat('{"name":"job-', cast(o_custkey as varchar), '","engine_type":"Spark","version":"3.5.4","config":{"spark.executor.instances":"', cast(o_custkey % 9 as varchar), '"}}') end as body
from orders"""

VIEWS["access_log"] = f"""
select event_id, ts,
  case event_type when 'error' then 'DELETE' when 'click' then 'POST' when 'signup' then 'POST' else 'GET' end as method,
  case event_type when 'view' then concat('/engine/eng-', cast(user_id as varchar)) when 'error' then concat('/engine/eng-', cast(user_id as varchar))
    when 'click' then concat('/engine/eng-', cast(user_id as varchar), '/stop') when 'signup' then concat('/engine/eng-', cast(user_id as varchar), '/restart')
    else case when k % 2 = 0 then '/engine' else '/any' end end as path
from (select *, {PROPS_K} as k from events) x"""

VIEWS["claims"] = """
select concat('eng-', cast(l_orderkey as varchar)) as id, l_shipdate as ts,
  concat('monitor-', cast(l_suppkey % 3 as varchar)) as claimant, cast(l_linenumber as bigint) as seq, l_partkey as tiebreak
from lineitem"""

# fixed values: the 44 transitions, written out here so that the oracles don't share the model's table
VIEWS["edges"] = """
select * from (values
  ('WaitToStart', 'STOP', 'Terminated', 'clear', 'none', NULL),
  ('StartInProgress', 'STOP', 'WaitToTerminate', 'clear', 'now', NULL),
  ('Running', 'STOP', 'WaitToTerminate', 'clear', 'now', NULL),
  ('WaitToTerminate', 'RESTART', 'Running', 'clear', 'now', NULL),
  ('Terminated', 'RESTART', 'WaitToStart', 'clear', 'now', NULL),
  ('WaitToStart', 'DELETE', 'Removed', 'clear', 'none', NULL),
  ('Terminated', 'DELETE', 'Removed', 'clear', 'none', NULL),
  ('ErrorClean', 'DELETE', 'Removed', 'clear', 'none', NULL),
  ('WaitToStart', 'ACQUIRE', 'TriggerStart', 'clear', 'timeout', NULL),
  ('WaitToTerminate', 'ACQUIRE', 'TriggerTermination', 'clear', 'timeout', NULL),
  ('ErrorWaitToClean', 'ACQUIRE', 'ErrorTriggerClean', 'keep', 'timeout', NULL),
  ('TriggerStart', 'RELEASE_OK', 'StartInProgress', 'clear', 'interval', NULL),
  ('TriggerStart', 'RELEASE_ERR', 'ErrorClean', 'set', 'none', NULL),
  ('TriggerTermination', 'RELEASE_OK', 'TerminateInProgress', 'clear', 'interval', NULL),
  ('TriggerTermination', 'RELEASE_ERR', 'ErrorWaitToClean', 'set', 'now', NULL),
  ('ErrorTriggerClean', 'RELEASE_OK', 'ErrorCleanInProgress', 'keep', 'interval', NULL),
  ('ErrorTriggerClean', 'RELEASE_ERR', 'ErrorWaitToClean', 'append', 'now', NULL),
  ('TriggerStart', 'TIMEOUT', 'WaitToStart', 'clear', 'now', NULL),
  ('TriggerTermination', 'TIMEOUT', 'WaitToTerminate', 'clear', 'now', NULL),
  ('ErrorTriggerClean', 'TIMEOUT', 'ErrorWaitToClean', 'keep', 'now', NULL),
  ('StartInProgress', 'PHASE_Pending', 'StartInProgress', 'keep', 'interval', NULL),
  ('StartInProgress', 'PHASE_Unknown', 'StartInProgress', 'keep', 'interval', NULL),
  ('StartInProgress', 'PHASE_Running', 'Running', 'clear', 'interval', NULL),
  ('StartInProgress', 'PHASE_Succeeded', 'ErrorClean', 'const', 'none', 'Engine fails to start.'),
  ('StartInProgress', 'PHASE_Failed', 'ErrorClean', 'const', 'none', 'Engine fails to start.'),
  ('StartInProgress', 'PHASE_NotExisted', 'ErrorClean', 'const', 'none', 'Engine fails to start.'),
  ('Running', 'PHASE_Pending', 'ErrorCleanInProgress', 'const', 'interval', 'Engine restarts unexpected.'),
  ('Running', 'PHASE_Running', 'Running', 'keep', 'interval', NULL),
  ('Running', 'PHASE_Unknown', 'Running', 'keep', 'interval', NULL),
  ('Running', 'PHASE_Succeeded', 'ErrorClean', 'const', 'none', 'Engine terminates during running.'),
  ('Running', 'PHASE_Failed', 'ErrorClean', 'const', 'none', 'Engine terminates during running.'),
  ('Running', 'PHASE_NotExisted', 'ErrorClean', 'const', 'none', 'Engine terminates during running.'),
  ('TerminateInProgress', 'PHASE_NotExisted', 'Terminated', 'clear', 'none', NULL),
  ('TerminateInProgress', 'PHASE_Pending', 'TerminateInProgress', 'keep', 'interval', NULL),
  ('TerminateInProgress', 'PHASE_Running', 'TerminateInProgress', 'keep', 'interval', NULL),
  ('TerminateInProgress', 'PHASE_Succeeded', 'TerminateInProgress', 'keep', 'interval', NULL),
  ('TerminateInProgress', 'PHASE_Failed', 'TerminateInProgress', 'keep', 'interval', NULL),
  ('TerminateInProgress', 'PHASE_Unknown', 'TerminateInProgress', 'keep', 'interval', NULL),
  ('ErrorCleanInProgress', 'PHASE_NotExisted', 'ErrorClean', 'keep', 'none', NULL),
  ('ErrorCleanInProgress', 'PHASE_Pending', 'ErrorCleanInProgress', 'keep', 'interval', NULL),
  ('ErrorCleanInProgress', 'PHASE_Running', 'ErrorCleanInProgress', 'keep', 'interval', NULL),
  ('ErrorCleanInProgress', 'PHASE_Succeeded', 'ErrorCleanInProgress', 'keep', 'interval', NULL),
  ('ErrorCleanInProgress', 'PHASE_Failed', 'ErrorCleanInProgress', 'keep', 'interval', NULL),
  ('ErrorCleanInProgress', 'PHASE_Unknown', 'ErrorCleanInProgress', 'keep', 'interval', NULL)
) t(from_kind, signal, to_kind, msg_rule, next_rule, const_message)"""

VIEWS["last_obs"] = """
select id, phase, ts from (
  select id, phase, ts, row_number() over (partition by id order by ts desc, l_linenumber desc, l_partkey desc, l_suppkey desc) as rn
  from observations) x where rn = 1"""

VIEWS["due"] = f"""
select * from registry where next_update_time is not null and next_update_time < {NOW}"""

# dependencies between views (a view may use the ones listed)
DEPS = {
    "updates": ["registry"], "last_obs": ["observations"], "due": ["registry"],
}
ORDER = ["registry", "observations", "signals", "outcomes", "updates", "requests", "access_log", "claims",
         "edges", "last_obs", "due"]


def with_views(names: list[str], body: str) -> str:
    need: set[str] = set()

    def add(n):
        if n in need:
            return
        need.add(n)
        for d in DEPS.get(n, []):
            add(d)

    for n in names:
        add(n)
    ctes = [f"{n} as ({VIEWS[n]}\n)" for n in ORDER if n in need]
    head = "with recursive " if "rec as (" in body else "with "
    return head + ",\n".join(ctes) + "\n" + body


def msg_sql(old: str, rule: str, arg: str, const: str) -> str:
    return (f"case {rule} when 'keep' then {old} when 'set' then {arg} "
            f"when 'append' then {old} || chr(10) || chr(10) || {arg} when 'const' then {const} "
            f"else cast(null as varchar) end")


def next_sql(rule: str, now: str = str(NOW)) -> str:
    return (f"cast(case {rule} when 'now' then {now} when 'interval' then {now} + {INTERVAL} "
            f"when 'timeout' then {now} + {TIMEOUT} else cast(null as bigint) end as bigint)")


STATE_LIST = ", ".join(_q(s) for s in FOLD_STATES)
SIGNAL_LIST = ", ".join(_q(s) for s in SIGNALS)


def debug_sql(kind: str, msg: str) -> str:
    esc = msg
    for a, b in [("\\", "\\\\"), ('"', '\\"'), ("chr(10)", "\\n"), ("chr(13)", "\\r"), ("chr(9)", "\\t")]:
        a_sql = a if a.startswith("chr(") else _q(a)
        esc = f"replace({esc}, {a_sql}, {_q(b)})"
    return f"case when {kind} like 'Error%' then {kind} || '(\"' || {esc} || '\")' else {kind} end"


VIEWS["routed"] = """
select *, case when template like '%{id}%' then regexp_extract(path, '^/engine/([^/]+)', 1) end as id,
  case when operation is not null then 'routed' when template is not null then 'MethodNotAllowed' else 'NotFound' end as route_status
from (
  select a.*, t.template, r.operation from access_log a
  cross join lateral (select case when regexp_matches(a.path, '^/engine$') then '/engine'
      when regexp_matches(a.path, '^/engine/[^/]+$') then '/engine/{id}'
      when regexp_matches(a.path, '^/engine/[^/]+/stop$') then '/engine/{id}/stop'
      when regexp_matches(a.path, '^/engine/[^/]+/restart$') then '/engine/{id}/restart' end as template) t
  left join (values ('POST', '/engine', 'create'), ('GET', '/engine', 'list'), ('GET', '/engine/{id}', 'get'),
      ('DELETE', '/engine/{id}', 'delete'), ('POST', '/engine/{id}/stop', 'stop'), ('POST', '/engine/{id}/restart', 'restart'))
    r(method, template, operation) on r.method = a.method and r.template = t.template) x"""
DEPS["routed"] = ["access_log"]
ORDER.append("routed")


VIEWS["state_wire"] = """
select id, state_kind, state_message,
  case o_orderkey % 13 when 0 then '{"' || state_kind || '":' || cast(o_custkey as varchar) || '}'
    when 1 then '"' || lower(state_kind) || '"'
    when 2 then '{"' || state_kind || '":"a","x":"b"}'
    when 3 then '"' || state_kind
    else case when state_kind like 'Error%' then json_object(state_kind, state_message)::varchar
              else '"' || state_kind || '"' end end as wire
from registry"""
DEPS["state_wire"] = ["registry"]

VIEWS["id_wire"] = """
select o_orderkey as request_id,
  case o_orderkey % 6 when 0 then '{"id":"eng-' || cast(o_orderkey as varchar) || '"}'
    when 1 then '"eng-' || cast(o_orderkey as varchar) || '"'
    when 2 then '{"id":""}'
    when 3 then '{"id":"eng-' || cast(o_orderkey as varchar) || '","other":"x"}'
    when 4 then '{"id":' || cast(o_orderkey as varchar) || '}'
    else '{"id":"eng-' || cast(o_orderkey as varchar) end as wire
from orders"""

VIEWS["time_text"] = """
select o_orderkey as request_id,
  case when o_orderkey % 7 = 0 then replace(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), ' ', 'T')
       else strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') end
  || ' ' || case o_orderkey % 3 when 0 then '+00:00:00' when 1 then '+05:30:15' else '-03:00:00' end as text
from orders"""

VIEWS["checked"] = """
select request_id, body0 as body,
  case when body is null then 'malformed'
       when json_type(body) <> 'OBJECT' then 'not_object'
       when first_problem is not null then split_part(first_problem, '|', 1)
       when missing is not null then 'missing_field' end as reason,
  case when body is null then 'malformed JSON'
       when json_type(body) <> 'OBJECT' then 'invalid type, expected struct CreateEngineRequest'
       when first_problem is not null then split_part(first_problem, '|', 2)
       when missing is not null then 'missing field `' || missing || '`' end as detail
from (
  select *,
    case when keys is not null then list_filter(list_transform(keys, lambda k, i: case
        when k not in ('name', 'engine_type', 'version', 'config')
          then 'unknown_field|unknown field `' || k || '`, expected one of `name`, `engine_type`, `version`, `config`'
        when list_position(keys, k) < i then 'duplicate_field|duplicate field `' || k || '`'
        when k = 'name' and json_type(body, '$.name') <> 'VARCHAR' then 'bad_type|name: invalid type, expected a string'
        when k = 'version' and json_type(body, '$.version') <> 'VARCHAR' then 'bad_type|version: invalid type, expected a string'
        when k = 'engine_type' and json_type(body, '$.engine_type') <> 'VARCHAR'
          then 'bad_type|engine_type: invalid type, expected variant identifier'
        when k = 'engine_type' and json_extract_string(body, '$.engine_type') not in ('Spark')
          then 'unknown_variant|engine_type: unknown variant `' || json_extract_string(body, '$.engine_type') || '`, expected `Spark`'
        when k = 'config' and json_type(body, '$.config') not in ('NULL', 'OBJECT') then 'bad_type|config: invalid type, expected a map'
        when k = 'config' and json_type(body, '$.config') = 'OBJECT' and bad_cfg is not null
          then 'bad_type|config.' || bad_cfg || ': invalid type, expected a string'
      end), lambda x: x is not null)[1] end as first_problem,
    case when keys is null then null when not list_contains(keys, 'name') then 'name'
         when not list_contains(keys, 'engine_type') then 'engine_type'
         when not list_contains(keys, 'version') then 'version' end as missing
  from (
    select *,
      case when json_type(body) = 'OBJECT' then json_keys(body) end as keys,
      case when json_type(body) = 'OBJECT' and json_type(body, '$.config') = 'OBJECT' then
        list_filter(json_keys(body, '$.config'),
                    lambda ck: json_type(body, '$.config."' || ck || '"') <> 'VARCHAR')[1] end as bad_cfg
    from (select request_id, body as body0, case when json_valid(body) then body end as body from requests) r) a) b"""
DEPS["checked"] = ["requests"]

VIEWS["valid"] = """
select request_id, json_extract_string(body, '$.name') as name, json_extract_string(body, '$.engine_type') as engine_type,
  json_extract_string(body, '$.version') as version,
  case when json_type(body, '$.config') = 'OBJECT' then
    list_transform(list_sort(json_keys(body, '$.config')), lambda ck: ck || '=' || json_extract_string(body, '$.config."' || ck || '"'))
  else [] end as config_kv
from checked where reason is null"""
DEPS["valid"] = ["checked"]

VIEWS["created"] = f"""
select sha256(cast(request_id as varchar)) as id, name, engine_type, version, config_kv,
  'WaitToStart' as state_kind, cast({NOW} as bigint) as next_update_time
from valid"""
DEPS["created"] = ["valid"]
ORDER.extend(["state_wire", "id_wire", "time_text", "checked", "valid", "created"])


VIEWS["cas_requests"] = f"""
select case when l_orderkey % 13 = 0 then concat('none-', cast(l_orderkey as varchar)) else concat('eng-', cast(l_orderkey as varchar)) end as id,
  l_shipdate as ts, cast(l_linenumber as bigint) + l_suppkey * 8 + l_partkey * {8 << 20} as seq,
  [{STATE_LIST}][l_partkey % 12 + 1] as before_kind, case when l_partkey % 12 >= 8 then 'm' || cast(l_linenumber % 3 as varchar) end as before_message,
  [{STATE_LIST}][l_suppkey % 12 + 1] as after_kind, case when l_suppkey % 12 >= 8 then 'm' || cast(l_suppkey % 3 as varchar) end as after_message,
  {_epoch('l_shipdate')} as next_update_time
from lineitem"""
ORDER.append("cas_requests")


VIEWS["waits"] = f"""
select concat('eng-', cast(user_id as varchar)) as id, event_id as wait_id, ts,
  case event_id % 3 when 0 then 'Running' when 1 then 'Terminated' else 'ErrorClean' end as target,
  case event_id % 3 when 0 then ['WaitToStart', 'TriggerStart', 'StartInProgress']
    when 1 then ['WaitToStart', 'TriggerStart', 'StartInProgress', 'Running', 'WaitToTerminate', 'TriggerTermination', 'TerminateInProgress']
    else ['WaitToStart', 'TriggerStart', 'StartInProgress', 'Running', 'WaitToTerminate', 'TriggerTermination', 'TerminateInProgress',
          'ErrorWaitToClean', 'ErrorTriggerClean', 'ErrorCleanInProgress'] end as allowed,
  ts + to_days(cast(event_id % 5 + 1 as int)) as deadline
from (select *, {PROPS_K} as k from events) x where k % 7 = 3"""
ORDER.append("waits")

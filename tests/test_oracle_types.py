"""Every batch query returns the same column names and types as its DuckDB oracle (sf0.001)."""

import duckdb

from conftest import SF001
from fleetstate.plans.catalog import ORACLE, QUERIES

SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


def test_types_match_oracle(spark):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in ["orders", "lineitem", "events"]:
        con.execute(f"create view {t} as select * from read_parquet('{SF001}/{t}.parquet')")
    bad = {}
    for name, fn in QUERIES.items():
        if name.startswith("stream_") or name == "monitor_rounds":
            continue  # covered by test_streaming and the oracle check
        st = dict(fn(spark, SF001).dtypes)
        rel = con.sql(ORACLE[name])
        dt = dict(zip(rel.columns, [str(t) for t in rel.types]))
        diff = [(c, st.get(c), dt.get(c)) for c in set(st) | set(dt) if SPARK_TO_DUCK.get(st.get(c), st.get(c)) != dt.get(c)]
        if diff:
            bad[name] = diff
    assert bad == {}

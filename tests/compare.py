"""Run a registered query and its SQL twin and compare all rows."""

from __future__ import annotations

import duckdb

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
)


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _kind(spark_type: str) -> str:
    return {
        "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
        "date": "DATE", "timestamp_ntz": "TIMESTAMP", "int": "INTEGER",
    }.get(spark_type, spark_type)


def differences(df, con, sql: str) -> list[str]:
    """What differs: columns, types, row count or rows (values compared exactly)."""
    rel = con.sql(sql)
    names = sorted(df.columns)
    found = []
    if names != sorted(rel.columns):
        return [f"columns {names} != {sorted(rel.columns)}"]
    theirs_types = dict(zip(rel.columns, map(str, rel.types)))
    for name, kind in df.dtypes:
        if _kind(kind) != theirs_types[name]:
            found.append(f"type of {name}: {_kind(kind)} != {theirs_types[name]}")
    quoted = ", ".join(f'"{n}"' for n in names)
    ours = sorted(map(repr, (tuple(r) for r in df.select(*names).collect())))
    theirs = sorted(map(repr, con.sql(f"select {quoted} from ({sql}) as t").fetchall()))
    if len(ours) != len(theirs):
        found.append(f"rows {len(ours)} != {len(theirs)}")
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if wrong:
        found.append(f"{len(wrong)} rows differ, first: {wrong[0][0]} != {wrong[0][1]}")
    return found

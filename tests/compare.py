"""Compare a registered query with its SQL in DuckDB."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, bool):
        return str(value)
    return repr(value)


KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "date": "DATE", "timestamp": "TIMESTAMP",
}


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Empty when schema and rows agree."""
    relation = con.sql(sql)
    expected = dict(zip(relation.columns, map(str, relation.types)))
    actual = {f.name: KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    problems = []
    if expected != actual:
        problems.append(f"schema: spark {actual} sql {expected}")
        return problems
    names = sorted(actual)
    ours = Counter(tuple(_plain(row[n]) for n in names) for row in df.collect())
    place = [relation.columns.index(n) for n in names]
    theirs = Counter(tuple(_plain(row[i]) for i in place) for row in relation.fetchall())
    if ours != theirs:
        problems.append(f"rows: spark {sum(ours.values())} sql {sum(theirs.values())}")
        problems += [f"only spark {names}: {row}" for row in list((ours - theirs))[:3]]
        problems += [f"only sql   {names}: {row}" for row in list((theirs - ours))[:3]]
        problems.append(f"differing rows: {sum((ours - theirs).values())}")
    if not ours:
        problems.append("no rows")
    return problems

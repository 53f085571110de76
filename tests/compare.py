"""Side-by-side run of the registered queries in Spark and DuckDB."""

from __future__ import annotations

import math
import re
import time

import duckdb

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR",
         "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "tinyint": "TINYINT"}


def spark_type(text: str) -> str:
    match = re.match(r"array<(.*)>$", text)
    return spark_type(match.group(1)) + "[]" if match else TYPES.get(text, text)


def connect(sf_dir: str, tables: list[str]):
    con = duckdb.connect()
    for name in tables:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def key(row):
    return tuple("\0" if v is None else (f"{v:.9g}" if isinstance(v, float) else str(v)) for v in row)


def same(a, b, exact: bool) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        if a == b or (math.isnan(a) and math.isnan(b)):
            return True
        return (not exact) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12)
    if isinstance(a, (list, tuple)) and isinstance(b, (list, tuple)):
        return len(a) == len(b) and all(same(x, y, exact) for x, y in zip(a, b))
    return a == b


def compare(frame, con, sql: str):
    """Returns (ok, message)."""
    schema = {f.name: spark_type(f.dataType.simpleString()) for f in frame.schema.fields}
    described = con.execute("DESCRIBE " + sql).fetchall()
    other = {r[0]: r[1] for r in described}
    names = sorted(schema)
    if names != sorted(other):
        return False, f"columns differ: spark {names} duckdb {sorted(other)}"
    odd = {n: (schema[n], other[n]) for n in names if schema[n] != other[n]}
    start = time.time()
    ours = sorted(([tuple(r[n] for n in names) for r in frame.collect()]), key=key)
    spent = time.time() - start
    order = [list(other).index(n) for n in names]
    theirs = sorted(([tuple(r[i] for i in order) for r in con.execute(sql).fetchall()]), key=key)
    if odd:
        return False, f"types differ: {odd}"
    if len(ours) != len(theirs):
        return False, f"row counts differ: spark {len(ours)} duckdb {len(theirs)}"
    inexact = 0
    for a, b in zip(ours, theirs):
        for n, x, y in zip(names, a, b):
            if not same(x, y, False):
                return False, f"column {n}: spark {x!r} duckdb {y!r}\n   {a}\n   {b}"
            if not same(x, y, True):
                inexact += 1
    note = f" INEXACT({inexact})" if inexact else ""
    return True, f"{len(ours)} rows {spent:.2f}s{note}"

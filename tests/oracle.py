"""Run a registered query and its SQL on the same tables and compare the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{Path(sf_dir) / (name + '.parquet')}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{plain(v)}" for k, v in value.items()) + "}"
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    return str(value)


def difference(df, con, sql: str, show: int = 5) -> str:
    """'' if both give the same columns and rows, else what differs."""
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    expected_rows = result.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    kinds = {"double": "DOUBLE", "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN"}
    types = dict(df.dtypes)
    odd = [
        f"{c[0]}: {types[c[0]]} / {c[1]}"
        for c in result.description
        if types[c[0]] in ("double",) and "DOUBLE" not in str(c[1]).upper() and "DECIMAL" not in str(c[1]).upper()
        and "FLOAT" not in str(c[1]).upper() and "NUMBER" not in str(c[1]).upper()
    ]
    order = sorted(names)
    got = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    where = {n: i for i, n in enumerate(names)}

    def norm(v, kind):
        import decimal

        if isinstance(v, decimal.Decimal):
            v = float(v)
        if kind == "double" and isinstance(v, int):
            v = float(v)
        return plain(v)

    want = sorted(tuple(norm(r[where[c]], types[c]) for c in order) for r in expected_rows)
    if got == want:
        return f"types {odd}" if odd else ""
    extra = sorted(set(got) - set(want))[:show]
    missing = sorted(set(want) - set(got))[:show]
    return f"{len(got)} rows, expected {len(want)}; columns {order}\n only spark: {extra}\n only sql:   {missing}"

"""Compare a registered query with its SQL in DuckDB over the same files."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    if isinstance(value, list):
        return [_plain(v) for v in value]
    if hasattr(value, "asDict"):
        return {k: _plain(v) for k, v in value.asDict().items()}
    return value


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


SPARK_TO_SQL = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
    "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE",
}


def difference(spark_df, con, sql: str) -> str | None:
    """None when columns, types and values agree, else what differs."""
    result = con.execute(sql)
    types = {d[0]: str(d[1]) for d in result.description}
    columns, want = sorted_rows([d[0] for d in result.description], result.fetchall())
    got_columns, got = sorted_rows(spark_df.columns, spark_df.collect())
    if columns != got_columns:
        return f"columns {got_columns} != {columns}"
    for name, kind in spark_df.dtypes:
        if SPARK_TO_SQL.get(kind) != types[name]:
            return f"type of {name}: {kind} != {types[name]}"
    if len(want) != len(got):
        return f"{len(got)} rows, expected {len(want)}; " + _first(got, want)
    if want != got:
        wrong = sum(a != b for a, b in zip(got, want))
        return f"{wrong} rows differ; " + _first(got, want)
    return None


def _first(got, want) -> str:
    gs, ws = set(map(repr, got)), set(map(repr, want))
    return f"only spark: {sorted(gs - ws)[:2]} only sql: {sorted(ws - gs)[:2]}"

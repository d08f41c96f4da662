"""Run a catalogue query in Spark and its SQL in DuckDB and compare names, row count and values."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else v
    if isinstance(v, int):
        return float(v) if abs(v) < 2**53 else v
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(
        (tuple(_cell(r[i]) for i in order) for r in rows),
        key=lambda r: tuple((x is None, str(type(x)), x if not isinstance(x, tuple) else str(x)) for x in r),
    )


def _close(g, w) -> bool:
    """Equal but for one unit in the sixth digit, which a mean exactly half-way between two may differ by."""
    return all(
        a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) < 1.5e-6) for a, b in zip(g, w)
    )


def compare(spark, con, query, sf_dir, close: bool = False) -> str | None:
    """None when equal, else what differs."""
    df = query.build(spark, sf_dir)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(query.sql)
    names = [d[0] for d in cur.description]
    want = _rows(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; first {got[:2]} / {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w and not (close and _close(g, w))]
    return f"{len(bad)} of {len(got)} rows differ; first {bad[0]}" if bad else None

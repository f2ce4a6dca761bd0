"""Compare a registered query with its SQL in DuckDB: as bags of rows, columns by name, doubles to nine digits."""

from __future__ import annotations

import datetime
import decimal
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if x != x else float(f"{x:.9g}") + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    return x


def bag(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def oracle(sql: str, sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got = con.execute(sql)
    return bag([x[0] for x in got.description], got.fetchall())


def differences(df, sql: str, sf_dir: str) -> list[str]:
    """What differs, in words; empty if nothing does."""
    names, want = oracle(sql, sf_dir)
    mine, got = bag(df.columns, [tuple(r) for r in df.collect()])
    if mine != names:
        return [f"columns {mine} and {names}"]
    if len(got) != len(want):
        return [f"{len(got)} and {len(want)} rows", f"{[x for x in got if x not in want][:2]} / {[x for x in want if x not in got][:2]}"]
    return [f"{a} and {b}" for a, b in zip(got, want, strict=True) if a != b][:3]

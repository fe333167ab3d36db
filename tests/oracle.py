"""Holds a query against its oracle SQL: columns sorted by name, rows as a multiset."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.6g}"
    return str(x)


def rows(df_or_sql, sf_dir: str | None = None) -> tuple[list[str], list[tuple]]:
    if isinstance(df_or_sql, str):
        con = duckdb.connect()
        for t in TABLES:
            p = Path(sf_dir, f"{t}.parquet")
            if p.exists():
                con.execute(f"create view {t} as select * from '{p}/**/*.parquet'" if p.is_dir() else f"create view {t} as select * from '{p}'")
        cur = con.execute(df_or_sql)
        names, got = [d[0] for d in cur.description], cur.fetchall()
    else:
        names, got = df_or_sql.columns, [tuple(r) for r in df_or_sql.collect()]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in got)


def same(df, sql: str, sf_dir: str) -> None:
    (n1, r1), (n2, r2) = rows(df), rows(sql, sf_dir)
    assert n1 == n2
    assert len(r1) == len(r2), (len(r1), len(r2))
    wrong = [(a, b) for a, b in zip(r1, r2, strict=True) if a != b]
    assert not wrong, (len(wrong), wrong[:3])

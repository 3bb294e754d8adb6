"""Compare a Spark query with its DuckDB SQL on a folder of parquet tables."""

from __future__ import annotations

import math
import os

import duckdb


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.10g}") + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_plain(x) for x in value)
    return value


def duck_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}/*.parquet" if os.path.isdir(f"{sf_dir}/{name}") else f"{sf_dir}/{name}"
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{path}'")
    got = con.execute(sql)
    return [d[0] for d in got.description], got.fetchall()


def same(spark, query, sql: str, sf_dir: str) -> None:
    frame = query(spark, sf_dir)
    columns, rows = duck_rows(sql, sf_dir)
    assert sorted(columns) == sorted(frame.columns)
    order = sorted(columns)
    want = sorted((tuple(_plain(r[columns.index(c)]) for c in order) for r in rows), key=repr)
    got = sorted((tuple(_plain(r[c]) for c in order) for r in frame.collect()), key=repr)
    assert len(got) == len(want)
    different = [(g, w) for g, w in zip(got, want) if g != w]
    assert not different, different[:3]

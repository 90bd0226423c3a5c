"""Runs a query and its SQL over one data folder and compares names and rows."""

import math
import os

import duckdb


def tables(sf_dir):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for name in os.listdir(sf_dir):
        if name.endswith(".parquet"):
            con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{sf_dir}/{name}'")
    return con


def _key(row):
    return tuple((x is not None, f"{x:.6g}" if isinstance(x, float) else str(x)) for x in row)


def _same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))
    return a == b


def differences(spark, sf_dir, query, sql, most=3):
    """Empty if the two agree."""
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    found = tables(sf_dir).sql(sql)
    if sorted(found.columns) != names:
        return [f"columns {names} and {sorted(found.columns)}"]
    mine = sorted((tuple(r) for r in df.select(*(f"`{c}`" for c in names)).collect()), key=_key)
    other = sorted(found.project(", ".join(f'"{c}"' for c in names)).fetchall(), key=_key)
    if len(mine) != len(other):
        return [f"{len(mine)} and {len(other)} rows"]
    return [f"{a} and {b}" for a, b in zip(mine, other, strict=True) if not all(map(_same, a, b))][:most]

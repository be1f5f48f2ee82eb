"""Run a registered query and its SQL oracle on the same tables and compare them."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pandas as pd


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(glob.glob(f"{sf}/*.parquet")):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _value(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return v
    if isinstance(v, float) and v.is_integer() and abs(v) < 2**53:
        return int(v)
    return v


def rows(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    out = [tuple(_value(v) for v in r) for r in df[cols].itertuples(index=False, name=None)]
    return sorted(out, key=lambda r: tuple(str(v) for v in r))


def kinds(df: pd.DataFrame) -> dict[str, str]:
    def kind(c):
        s = df[c].dropna()
        return type(_value(s.iloc[0])).__name__ if len(s) else "-"

    return {c: kind(c) for c in sorted(df.columns)}


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    a, b = rows(got), rows(want)
    if len(a) != len(b):
        extra = list(set(map(str, a)) - set(map(str, b)))[:3]
        missing = list(set(map(str, b)) - set(map(str, a)))[:3]
        return f"{len(a)} rows != {len(b)}\n only here {extra}\n only oracle {missing}"
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(bad)} of {len(a)} rows differ, columns {sorted(got.columns)}\n" + "\n".join(
            f"  {x}\n  {y}" for x, y in bad[:3]
        )
    for c in got.columns:
        pair = {str(got[c].dtype), str(want[c].dtype)}
        text, number = {"object", "str", "string", "boolean"}, {"float64", "Int64", "int64", "Int32"}
        with_nulls = got[c].isna().any() and pair <= number
        if len(pair) > 1 and not pair <= text and not with_nulls:
            return f"dtype of {c}: {got[c].dtype} != {want[c].dtype}"
    return None

"""Rows of a Spark result and of its DuckDB twin in one comparable form."""

import math

import pandas as pd


def cell(v):
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return repr(float(v))
    return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(map(cell, r)) for r in df.itertuples(index=False))

"""Comparison of a query's rows with its SQL's rows."""

import math
import os
from datetime import datetime

import duckdb
import numpy as np
import pandas as pd


def connection(folder: str):
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.execute(f"create view {name[:-8]} as select * from read_parquet('{folder}/{name}')")
    return con


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, (float, np.floating)):
        return int(v) if v == int(v) else round(float(v), 6)
    if isinstance(v, (datetime, pd.Timestamp)):
        return pd.Timestamp(v).isoformat()
    return v


def rows(frame: pd.DataFrame) -> tuple[list, list]:
    frame = frame.reindex(sorted(frame.columns), axis=1)
    return list(frame.columns), sorted((tuple(plain(x) for x in r) for r in frame.itertuples(index=False, name=None)), key=repr)

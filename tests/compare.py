"""Rows of a query and of its oracle in one form."""

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _one(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(_one, v))
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, (float, np.floating)) and np.isnan(v)):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, (float, np.floating)):
        v = round(float(v), 6)
        return int(v) if v == int(v) else v
    return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(map(_one, r)) for r in df.itertuples(index=False)), key=repr)

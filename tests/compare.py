"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import numpy as np
import pandas as pd


def _plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df:
        if df[c].dtype == object:
            df[c] = df[c].map(lambda v: tuple(v) if isinstance(v, (list, np.ndarray)) else v)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def assert_same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert set(got.columns) == set(want.columns)
    assert len(got) == len(want)
    a, b = _plain(got), _plain(want)
    for c in a:
        differs = (a[c] != b[c]) & ~(a[c].isna() & b[c].isna())
        assert not differs.any(), f"{c}: {a[c][differs].iloc[0]!r} and {b[c][differs].iloc[0]!r}"

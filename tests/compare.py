"""Rows of two results in a form that can be compared: columns by name, rows in any order."""

import math


def rows(df):
    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>"):
            return None
        if isinstance(v, float):
            return round(v, 6) + 0.0
        if hasattr(v, "tolist"):
            return str(v.tolist())
        return v

    names = sorted(df.columns)
    out = [tuple(plain(v) for v in r) for r in df[names].astype(object).itertuples(index=False, name=None)]
    norm = [tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r) for r in out]
    return names, sorted(norm, key=str)

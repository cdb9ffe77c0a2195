"""Comparison of a Spark result with rows or SQL."""

import math
import numbers


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or type(v).__name__ in ("NaTType", "NAType"):
        return "-"
    if not isinstance(v, bool) and isinstance(v, numbers.Number):
        v = float(v)
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    s = str(v)
    return s.removesuffix(" 00:00:00")


def rows_of(pdf):
    cols = sorted(pdf.columns)
    return sorted(tuple(plain(v) for v in r) for r in pdf[cols].itertuples(index=False))


def same_as_sql(df, con, sql):
    a, b = df.toPandas(), con.execute(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows_of(a) == rows_of(b)

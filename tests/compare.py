"""Rows of a DataFrame against rows of a DuckDB query, in any order, columns by name."""

import math


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v).replace("+00:00", "") if hasattr(v, "isoformat") else v


def same(df, duck, sql):
    columns = sorted(df.columns)
    ours = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    result = duck.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    theirs = [tuple(plain(r[i]) for i in order) for r in result.fetchall()]
    assert sorted(map(str, ours)) == sorted(map(str, theirs))

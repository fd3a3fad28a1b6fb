"""Comparison of a query with its SQL, as multisets of rows with columns sorted by name."""

import math


def tidy(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def same_rows(df, con, sql):
    cols = sorted(df.columns)
    mine = [tuple(tidy(r[c]) for c in cols) for r in df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    theirs = [tuple(tidy(r[names.index(c)]) for c in cols) for r in cur.fetchall()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(mine, key=key) == sorted(theirs, key=key)

"""Comparison of a query in both engines."""

from __future__ import annotations


def plain(value):
    """Values as both engines give them, doubles to six places."""
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def same(frame, con, sql: str) -> bool:
    """Whether a DataFrame and a DuckDB query give the same rows."""
    got = [tuple(plain(r[c]) for c in sorted(frame.columns)) for r in frame.collect()]
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = [names.index(c) for c in sorted(names)]
    want = [tuple(plain(row[k]) for k in order) for row in found.fetchall()]
    key = lambda row: tuple((x is not None, str(x)) for x in row)
    return sorted(names) == sorted(frame.columns) and sorted(got, key=key) == sorted(want, key=key)

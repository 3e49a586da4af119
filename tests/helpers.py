"""Comparisons of frames that several test modules share."""

from __future__ import annotations


def rows_of(df, order="event_id"):
    columns = sorted(df.columns)
    return [tuple(r[c] for c in columns) for r in df.select(*columns).orderBy(order).collect()]


def close(a, b, digits=9):
    if isinstance(a, float) and isinstance(b, float):
        return abs(a - b) <= 10**-digits * max(1.0, abs(a))
    return a == b


def assert_same(left, right, order="event_id"):
    a, b = rows_of(left, order), rows_of(right, order)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(close(i, j) for i, j in zip(x, y)), (x, y)

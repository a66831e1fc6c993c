"""Comparing query results."""

from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def _plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return (str(type(v)), str(v))
    if isinstance(v, (bytes, bytearray)):
        return ("bytes", bytes(v).hex())
    try:
        return ("number", f"{float(v):.9g}")
    except (TypeError, ValueError):
        return ("other", str(v))


def same_rows(df, relation) -> None:
    """Both have the same columns and, in any order, the same rows."""
    cols = sorted(df.columns)
    assert cols == sorted(relation.columns)
    at = [relation.columns.index(c) for c in cols]
    a = sorted(tuple(_plain(r[c]) for c in cols) for r in df.collect())
    b = sorted(tuple(_plain(r[i]) for i in at) for r in relation.fetchall())
    assert a == b

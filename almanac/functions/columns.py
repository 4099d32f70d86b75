"""Scalar column functions (F1-F13).  All are built-in expressions, so they stay
inside whole-stage code generation; none is a Python UDF."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_last_token(c: str | Column, sep: str = "_") -> Column:
    """``rsplit(sep, 1)[0]``; unchanged when there is no separator."""
    return F.regexp_replace(_c(c), f"{sep}[^{sep}]*$", "")


def prefix(c: str | Column, n: int) -> Column:
    """first ``n`` characters."""
    return F.substring(_c(c), 1, n)


def replace(c: str | Column, old: str, new: str) -> Column:
    """literal substring replacement."""
    return F.replace(_c(c), F.lit(old), F.lit(new))


def zfill(c: str | Column, width: int) -> Column:
    """left-pad with zeros only when shorter (``lpad`` would cut)."""
    c = _c(c)
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def contains(c: str | Column, s: str) -> Column:
    """F5."""
    return _c(c).contains(s)


def inv_logit(p: str | Column) -> Column:
    """numerically stable logistic function."""
    p = _c(p)
    return F.when(p >= 0, F.lit(1.0) / (F.lit(1.0) + F.exp(-p))) \
        .otherwise(F.exp(p) / (F.lit(1.0) + F.exp(p)))


def isclose(a: str | Column, b: str | Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """numpy ``isclose`` rule ``|a-b| <= atol + rtol*|b|``."""
    a, b = _c(a), _c(b)
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def cut(c: str | Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """right-closed interval labels (``pd.cut``); outside -> null."""
    c = _c(c)
    out = F.lit(None).cast("string")
    for lo, hi, lab in reversed(list(zip(edges[:-1], edges[1:], labels))):
        out = F.when((c > lo) & (c <= hi), F.lit(lab)).otherwise(out)
    return out


def clip(c: str | Column, lo: Column | float | None, hi: Column | float | None) -> Column:
    """F8 clip that keeps nulls null (``least``/``greatest`` skip nulls)."""
    c = _c(c)
    out = c
    if lo is not None:
        out = F.greatest(out, lo if isinstance(lo, Column) else F.lit(lo))
    if hi is not None:
        out = F.least(out, hi if isinstance(hi, Column) else F.lit(hi))
    return F.when(c.isNotNull(), out)


def nan_to_null(c: str | Column) -> Column:
    """Ingestion guard: NaN never reaches aggregates."""
    c = _c(c)
    return F.when(~F.isnan(c), c)

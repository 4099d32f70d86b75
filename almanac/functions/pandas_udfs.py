"""Vectorised pandas UDFs (Arrow batches).  Kept in a module without
``from __future__ import annotations`` because pandas_udf reads the real type
hints to pick the UDF kind."""

import pandas as pd
from pyspark.sql import functions as F


@F.pandas_udf("long")
def poisson_draw(lam: pd.Series, h: pd.Series) -> pd.Series:
    """Poisson(lam) draws, a pure function of (lam, 64-bit hash h)."""
    from almanac.operators.sampling import _poisson_inverse_cdf
    return pd.Series(_poisson_inverse_cdf(lam.to_numpy(), h.to_numpy()))

"""A membership filter of fixed size over 64-bit hashes.

One bit per hash bucket, however many hashes: the filter can be sent to every
task whatever the size of the data, and only ever lets too much through.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def build(hashes: DataFrame, column: str, bits: int) -> np.ndarray:
    """Bitmap of 2 ** ``bits`` bits over a long column; at most 2 ** (bits - 6) rows reach the driver."""
    bucket = f"shiftrightunsigned({column}, {64 - bits})"
    rows = (hashes.select(F.expr(f"shiftrightunsigned({bucket}, 6)").alias("slot"), F.expr(f"shiftleft(1L, cast({bucket} & 63 as int))").alias("bit"))
            .groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow())
    out = np.zeros(1 << (bits - 6), np.int64)
    out[rows.column("slot").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint64)


def passes(bitmap: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """Boolean mask of the hashes whose bit is set."""
    bucket = hashes >> np.uint64(64 - bits)
    return (bitmap[bucket >> np.uint64(6)] >> (bucket & np.uint64(63)) & np.uint64(1)).astype(bool)

"""A filter of fixed size for hashes: what isn't in it wasn't put in; some that is wasn't either.

It is built by all tasks, and its size (8 MB) doesn't depend on how many hashes it holds: of more
than some ten million ever more pass, and whoever uses it is only slower.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 26
_U = np.uint64


def build(df: DataFrame, column: str) -> np.ndarray:
    """The filter's 2^20 words of 64 bits, from a column of long hashes."""
    place = F.shiftrightunsigned(column, 64 - BITS)
    bit = F.expr("shiftleft(1L, cast(place & 63 as int))")
    words = df.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 6), dtype=_U)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(_U)
    return out


def contains(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes (64 bits, any integer type) may be in the filter."""
    place = hashes.view(_U) >> _U(64 - BITS)
    return (words[(place >> _U(6)).astype(np.int64)] >> (place & _U(63))) & _U(1) != 0

"""A set of 64-bit hashes as a bitmap of a fixed size, built on the cluster.

The bitmap holds 2**BITS bits whatever the number of hashes, so a broadcast of it has a
proven bound. It has no false negatives; with more hashes it lets more of the others
through, which costs work behind it but changes no result.
"""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 16 MB.
BITS = 27


def bitmap(hashes: DataFrame, column: str, bits: int = BITS) -> Broadcast[np.ndarray]:
    """The bitmap of a long column, combined by OR on the executors; the driver gets its words, 2**(bits - 6) at most."""
    bit = F.shiftrightunsigned(column, 64 - bits)
    parts = hashes.select(F.shiftright(bit, 6).alias("w"), F.expr("1L").alias("one"), bit.bitwiseAND(F.lit(63)).cast("int").alias("b"))
    parts = parts.groupBy("w").agg(F.expr("bit_or(shiftleft(one, b))").alias("v"))
    table = parts.toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[table["w"].to_numpy()] = table["v"].to_numpy().view(np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(out)


def contains(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each uint64 hash may be in the set."""
    bit = hashes >> np.uint64(64 - (len(words) * 64).bit_length() + 1)
    return (words[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1

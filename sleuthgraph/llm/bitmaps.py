"""A Bloom bitmap of hashes, of bounded size, that spares rows a shuffle.

The bitmap only sets aside rows that cannot match; the join after it decides.
Its size follows the number of hashes up to ``MOST_BITS`` (16 MB); beyond that it
lets more rows pass, and nothing else changes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_BITS = 1 << 16
MOST_BITS = 1 << 27


class Bitmap:
    """Membership of 64-bit hashes; shared with tasks as a broadcast of at most ``MOST_BITS`` bits."""

    def __init__(self, hashes: DataFrame, column: str):
        count = hashes.count()
        bits = LEAST_BITS
        while bits < min(16 * count, MOST_BITS):
            bits *= 2
        spots = F.array(*[F.pmod(F.hash(*first, column), F.lit(bits)) for first in ([], [F.lit(1)])])
        rows = (hashes.select(F.explode(spots).alias("s")).groupBy(F.floor(F.col("s") / 32).cast("int").alias("w"))
                .agg(F.bit_or(F.expr("shiftleft(1L, s % 32)")).alias("b")).mapInPandas(_packed, "w binary, b binary"))
        table = np.zeros(bits // 32, dtype=np.uint32)
        for row in rows.toLocalIterator(prefetchPartitions=True):
            table[np.frombuffer(row["w"], dtype=np.uint32)] = np.frombuffer(row["b"], dtype=np.uint32)
        self.bits = bits
        self.shared = hashes.sparkSession.sparkContext.broadcast(table)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each hash may be among those given; never false for one that is."""
        x, table, out = hashes.view(np.uint64), self.shared.value, np.ones(len(hashes), dtype=bool)
        halves = [(x & np.uint64(0xFFFFFFFF)).astype(np.uint32), (x >> np.uint64(32)).astype(np.uint32)]
        for seed in (np.full(1, 42, dtype=np.uint32), _murmur([np.ones(1, dtype=np.uint32)], np.full(1, 42, dtype=np.uint32))):
            spot = _murmur(halves, seed).astype(np.int64) % self.bits
            out &= (table[spot >> 5] >> (spot & 31).astype(np.uint32)) & np.uint32(1) == 1
        return out

    def may(self, *columns: str) -> Column:
        """A test of rows by the hash of their columns (``key_of``); for columns without nulls."""
        def test(keys: pd.Series) -> pd.Series:
            return pd.Series(self.has(keys.to_numpy(np.int64)))

        return F.pandas_udf(test, "boolean")(key_of(*columns))


def _packed(batches):
    for batch in batches:
        if len(batch):
            yield pd.DataFrame({c: [batch[c].to_numpy(np.int64).astype(np.uint32).tobytes()] for c in ("w", "b")})


def key_of(*columns: str) -> Column:
    """One long for several columns."""
    return F.xxhash64(*columns)


def _murmur(words: list[np.ndarray], seed: np.ndarray) -> np.ndarray:
    """Spark's ``hash`` of an int or long (public 32-bit Murmur 3), from its 32-bit words; the seed is the hash so far."""
    def turn(v, r):
        return (v << np.uint32(r)) | (v >> np.uint32(32 - r))

    h = np.repeat(seed, len(words[0])) if len(seed) == 1 else seed
    for word in words:
        k = turn(word * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        h = turn(h ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h = h ^ np.uint32(4 * len(words))
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return h ^ (h >> np.uint32(16))

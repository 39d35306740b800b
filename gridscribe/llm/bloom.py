"""A Bloom filter of 64-bit keys, built where the keys are, as a cheap sieve before an exact join.

It only saves shuffled rows: keys that pass by mistake fall out in the join that follows. Its size is
bounded: with very many keys it has fewer bits for each and lets more through, and with too few bits to be of use
it is not built, everything then goes through that join.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix

MAX_BYTES = 64 << 20
_BITS_A_KEY, _LEAST_BITS, _UNIT = 12, 2, 1 << 16


class Sieve:
    """`passes` says of 64-bit keys whether they may be in the set; without bits, any may."""

    def __init__(self, bits: np.ndarray | None, hashes: int = 0):
        self.bits, self.hashes = bits, hashes

    def passes(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        if self.bits is not None:
            for at in _positions(keys, self.hashes, len(self.bits) * 8):
                out[out] = (self.bits[at[out] >> np.uint64(3)] >> (at[out] & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def _positions(keys: np.ndarray, hashes: int, size: int) -> list[np.ndarray]:
    a, b = mix(keys, 71), mix(keys, 72) | np.uint64(1)
    return [(a + np.uint64(i) * b) % np.uint64(size) for i in range(hashes)]


def build_sieve(keys: DataFrame, max_bytes: int = MAX_BYTES) -> Sieve:
    """Sieve of the one column of longs of `keys`."""
    name, count = keys.columns[0], keys.count()
    each = min(_BITS_A_KEY, max_bytes * 8 / max(1, count))
    if each < _LEAST_BITS:
        return Sieve(None)
    hashes = max(1, min(4, round(each * math.log(2))))
    size = max(1, math.ceil(count * each / _UNIT)) * _UNIT

    def bits(batches):
        mine = None
        for b in batches:
            mine = np.zeros(size // 8, np.uint8) if mine is None else mine
            for at in _positions(b.column(name).to_numpy(zero_copy_only=False).view(np.uint64), hashes, size):
                np.bitwise_or.at(mine, at >> np.uint64(3), np.left_shift(1, at & np.uint64(7)).astype(np.uint8))
        if mine is not None:
            words = mine.view(np.int64)
            for at in range(0, len(words), 1 << 16):
                slots = np.flatnonzero(words[at : at + (1 << 16)]) + at
                yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(words[slots])], names=["slot", "bits"])

    merged = keys.mapInArrow(bits, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[merged["slot"].to_numpy()] = merged["bits"].to_numpy()
    return Sieve(out.view(np.uint8), hashes)

"""A Bloom filter of bounded size over 64-bit keys, built slice by slice on executors and broadcast.

Its size has a fixed upper bound whatever the input; beyond it more keys pass than need to, which costs work in the
exact step behind it and never a result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import mixed

SLICES = 16
PROBES = 4
MOST_BITS = 1 << 28
LEAST_BITS = 1 << 16


def size_for(keys: int, most: int = MOST_BITS) -> int:
    return min(most, max(LEAST_BITS, 1 << (max(1, 12 * keys) - 1).bit_length()))


def places(keys: np.ndarray, bits: int):
    """PROBES bit numbers per key, all inside the key's slice."""
    part = bits // SLICES
    with np.errstate(over="ignore"):
        x = mixed(keys ^ np.uint64(0xA0761D6478BD642F))
        base = (keys >> np.uint64(60)) * np.uint64(part)
        step = (x >> np.uint64(32)) | np.uint64(1)
        for i in range(PROBES):
            yield base + (x + np.uint64(i) * step) % np.uint64(part)


def build(keys: DataFrame, column: str, bits: int) -> Broadcast:
    """keys: one long column among others. Each slice is filled in one task; the driver gets bits / 8 bytes."""
    part = bits // SLICES

    def fill(batches):
        mine: dict[int, np.ndarray] = {}
        for b in batches:
            k = b.column(0).to_numpy().view(np.uint64)
            slot = (k >> np.uint64(60)).astype(np.int64)
            for at in places(k, bits):
                for s in np.unique(slot):
                    field = mine.setdefault(int(s), np.zeros(part, bool))
                    field[(at[slot == s] - np.uint64(int(s) * part)).astype(np.int64)] = True
        if mine:
            yield pa.RecordBatch.from_arrays([pa.array(list(mine), pa.int32()), pa.array([np.packbits(f).tobytes() for f in mine.values()], pa.binary())], ["slice", "field"])

    dealt = keys.select(F.col(column).cast("long").alias("k")).repartition(SLICES, F.shiftrightunsigned("k", 60))
    whole = np.zeros(bits // 8, np.uint8)
    for r in dealt.mapInArrow(fill, "slice int, field binary").collect():
        whole[r["slice"] * part // 8 : (r["slice"] + 1) * part // 8] |= np.frombuffer(r["field"], np.uint8)
    return keys.sparkSession.sparkContext.broadcast(whole)


def has(field: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in the filter."""
    left = np.arange(len(keys))
    for i in range(PROBES):
        at = list(places(keys[left], len(field) * 8))[i] if i else next(places(keys, len(field) * 8))
        left = left[(field[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1]
    out = np.zeros(len(keys), bool)
    out[left] = True
    return out

"""Sharding by histogram sort.

Rows are ordered by (hash of text, doc_id), so equal texts stand together and may still be cut by a boundary when
a group is larger than a shard. Splitters between shards come from repeated histograms: every task counts exact bytes
and rows below the candidate boundaries, the sums (at most about PROBES numbers, whatever the input) go to the driver,
and the probes close in until each splitter is within tolerance or between two neighbouring keys. Then the rows move
once, by (shard, key), into pieces of about `piece_bytes` that Spark's range partitioning cuts, so no task sorts a
whole shard; the moved rows are a written table, and a row's slot is its place in its piece plus the rows of the shard
in the pieces before, which are counted there.

Law: ``bytes``. Size of a row: UTF-8 bytes of its text (null: 0) plus 16. Rows that repeat both text and id have
one key and stay together, in one piece. Null ids sort first, null texts by the hash of null. Very long texts are rows
like others. Reruns agree in the shard of every row; rows of one key may swap slots. An empty table gives no rows.
Input columns named like the outputs (size, shard, slot) are replaced in any case, others pass under any name.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, fresh, without

#: Probes of one round, dealt to the splitters that are still open (LEAST_PROBES each at least).
PROBES, LEAST_PROBES = 4096, 15
TOLERANCE = 0.002
PIECE_BYTES = 64 << 20
BROADCAST_PIECES = 200_000
TOP = 1 << 64


def unsigned(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)


def bins(k1: np.ndarray, k2: np.ndarray, probes: list[int]) -> np.ndarray:
    """For each key the number of probes at or below it; probes are sorted 128-bit numbers (k1, k2)."""
    p1 = np.array([p >> 64 for p in probes], np.uint64)
    p2 = np.array([p & (TOP - 1) for p in probes], np.uint64)
    low, high = np.searchsorted(p1, k1, "left"), np.searchsorted(p1, k1, "right")
    out = low.copy()
    tied = np.flatnonzero(low != high)
    for a in np.unique(low[tied]):
        at = tied[low[tied] == a]
        out[at] = a + np.searchsorted(p2[a : high[at[0]]], k2[at], "right")
    return out


def below(keys: DataFrame, probes: list[int]) -> list[tuple[int, int]]:
    """Exact (bytes, rows) below each probe."""
    n = len(probes) + 1

    def count(batches):
        size, rows = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for b in batches:
            at = bins(unsigned(b.column(0).to_numpy()), unsigned(b.column(1).to_numpy()), probes)
            np.add.at(size, at, b.column(2).to_numpy())
            rows += np.bincount(at, minlength=n)
        full = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(size[full]), pa.array(rows[full])], ["bin", "bytes", "rows"])

    got = {r["bin"]: (r["bytes"], r["rows"]) for r in keys.mapInArrow(count, "bin int, bytes long, rows long").groupBy("bin").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).collect()}
    out, at = [], (0, 0)
    for i in range(len(probes)):
        at = (at[0] + got.get(i, (0, 0))[0], at[1] + got.get(i, (0, 0))[1])
        out.append(at)
    return out


def splitters(keys: DataFrame, total: int, rows: int, pieces: int, tolerance: float) -> list[tuple[int, int]]:
    """(boundary key, rows below it) of each inner boundary."""
    ideal = [total * j / pieces for j in range(1, pieces)]
    known = {0: (0, 0), TOP * TOP: (total, rows)}  # bytes and rows below a key
    slack = tolerance * total / pieces

    def bracket(goal: float) -> tuple[int, int]:
        i = bisect.bisect_left(order, goal, key=lambda k: known[k][0])
        return order[max(0, i - 1)], order[min(i, len(order) - 1)]

    while True:
        order = sorted(known)
        probes, done, open_ = set(), [], []
        for goal in ideal:
            lo, hi = bracket(goal)
            best = min((lo, hi), key=lambda k: (abs(known[k][0] - goal), k))
            done.append((best, known[best][1]))
            if abs(known[best][0] - goal) > slack and hi - lo > 1 and known[hi][1] - known[lo][1] > 1:
                open_.append((lo, hi))
        each = max(LEAST_PROBES, PROBES // max(1, len(open_)))
        for lo, hi in set(open_):
            probes.update(lo + (hi - lo) * i // (each + 1) for i in range(1, each + 1))
        probes = sorted(probes - known.keys())
        if not probes:
            return done
        known.update(zip(probes, below(keys, probes)))


def shard(docs: DataFrame, n_shards: int = 40, tolerance: float = TOLERANCE, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """The rows of docs, exchanged once, with size, shard and slot (gapless from 0 in each shard)."""
    scratch = Scratch(docs.sparkSession, "shard")
    docs = without(docs, "size", "shard", "slot")
    key1, key2, place, piece, first, before, of, inside = fresh(docs, "key1", "key2", "place", "piece", "first", "before", "of", "inside")
    keyed = docs.select("*", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.xxhash64("text").alias(key1), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias(key2))
    keys = scratch.save(keyed.select(key1, key2, "size"), "keys")
    total, rows = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    bounds = [k for k, _ in splitters(keys, total, rows, n_shards, tolerance)] if rows else []
    scratch.drop("keys")

    @F.pandas_udf("int")
    def shard_of(k1: pd.Series, k2: pd.Series) -> pd.Series:
        return pd.Series(bins(unsigned(k1.to_numpy()), unsigned(k2.to_numpy()), bounds).astype(np.int32))

    order = ["shard", key1, key2]
    pieces = max(n_shards, math.ceil(total / piece_bytes))
    dealt = keyed.withColumn("shard", shard_of(key1, key2) if bounds else F.lit(0)).repartitionByRange(pieces, *order).sortWithinPartitions(*order)
    moved = scratch.save(dealt.drop(key1, key2).withColumn(place, F.monotonically_increasing_id()).withColumn(piece, F.shiftright(F.col(place), 33)), "moved")
    # one row per piece and shard in it: pieces + n_shards at most
    cells = moved.groupBy(F.col(piece).alias(of), F.col("shard").alias(inside)).agg(F.min(place).alias(first), F.count("*").alias("n"))
    earlier = Window.partitionBy(inside).orderBy(of).rowsBetween(Window.unboundedPreceding, -1)
    cells = scratch.save(cells.withColumn(before, F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n"), "cells")
    placed = moved.join(F.broadcast(cells) if pieces <= BROADCAST_PIECES else cells, (F.col(piece) == F.col(of)) & (F.col("shard") == F.col(inside)))
    return placed.withColumn("slot", F.col(place) - F.col(first) + F.col(before)).select(*[F.col(f"`{c}`") for c in docs.columns], "size", "shard", "slot")

"""Importance resampling towards a target distribution.

Features are all runs of one to three consecutive words, hashed into BUCKETS buckets (crc32). One pass counts the
buckets of the whole corpus, one those of the target texts; each bucket's gain is the floor of 1000 times the log ratio
of its smoothed shares. The gains are an array of BUCKETS numbers, so a document's weight is a sum of array entries.
Its score is the weight plus Gumbel noise drawn from its id, and the highest scores are a draw without replacement in
proportion to exp(weight / 1000).

Scores are integers. Their exact histogram gives each score its rank offset: the number of documents above it. The
suffix sums are taken level by level over the digits (base DIGIT) of the distance from the highest score, so a sum
runs over at most DIGIT counts, however the scores lie. The cutoff is the lowest score whose offset is below the number
to draw; only documents of a surviving score are numbered, by doc_id within it. Nothing is sorted as a whole, and the
driver sees two arrays of BUCKETS counts, the number of documents and the cutoff.

Defined cases: null and empty texts have no features, weight 0 and are never drawn; a null id draws its noise as the
empty text does and comes first among ties; rows that repeat an id share their noise and all count; equal scores go
to the smaller id; very long texts count whole; an empty target gives each bucket the gain of its smoothed share; an
empty table gives no rows; further columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .scratch import Scratch

BUCKETS = 10_000
DIGIT_BITS = 12
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = _WORD[_LOWER]
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)
LONG = 48


def onward(state: np.ndarray, buf: np.ndarray, starts: np.ndarray, size: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The CRC registers after each span, from those before it; `order` puts long spans first."""
    out = state[order]
    s, n = starts[order], size[order]
    longer = int(np.searchsorted(-n, -LONG))
    for i in range(longer):
        out[i] = zlib.crc32(buf[s[i] : s[i] + n[i]], int(out[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    for j in range(int(n[longer]) if longer < len(n) else 0):
        m = int(np.searchsorted(-n, -j))
        part = out[longer:m]
        out[longer:m] = _CRC[(part ^ buf[s[longer:m] + j]) & np.uint32(255)] ^ (part >> np.uint32(8))
    back = np.empty_like(out)
    back[order] = out
    return back


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text of each feature, its bucket) and the number of words of each text."""
    w = W.Words(texts, kind=_KIND)
    buf, doc = _LOWER[w.buf], w.docs()
    size = w.ends - w.starts
    order = np.argsort(-size, kind="stable")
    state = np.full(len(size), 0xFFFFFFFF, np.uint32)
    whole = np.ones(len(size), bool)
    docs, found = [], []
    for n in range(3):
        if n:
            before = np.full(len(size), 0xFFFFFFFF, np.uint32)
            before[1:] = _CRC[(state[:-1] ^ np.uint32(32)) & np.uint32(255)] ^ (state[:-1] >> np.uint32(8))
            state = before
            whole[: min(n, len(whole))] = False
            whole[n:] &= doc[n:] == doc[:-n]
        state = onward(state, buf, w.starts, size, order)
        docs.append(doc[whole])
        found.append((state[whole] ^ np.uint32(0xFFFFFFFF)) % np.uint32(BUCKETS))
    return np.concatenate(docs), np.concatenate(found), np.diff(w.first)


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """texts: one text column. The features in each bucket."""

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for b in W.slices(batches, b_name):
            total += np.bincount(features(b.column(b_name))[1], minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["bucket", "n"])

    b_name = texts.columns[0]
    out = np.zeros(BUCKETS, np.int64)
    for r in texts.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + BUCKETS) / ((s + 1)(T + BUCKETS)))) for each bucket, in doubles."""
    all_s, all_t = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1.0) * all_s / ((s + 1.0) * all_t))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(doc_id, seed: int = SEED) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(docs: DataFrame, gains: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    def run(batches):
        for b in W.slices(batches):
            doc, found, n_words = features(b.column("text"))
            n = b.num_rows
            total = np.append(0, np.cumsum(shared.value[found[np.argsort(doc, kind="stable")]]))
            edge = np.append(0, np.cumsum(np.bincount(doc, minlength=n)))
            weight = total[edge[1:]] - total[edge[:-1]]
            score = weight + np.array([noise(i, seed) for i in b.column("doc_id").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, (n_words.astype(np.int64), np.diff(edge), weight, score))], ["doc_id", "n_words", "n_features", "weight", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def offsets(scores: DataFrame, highest: int, lowest: int) -> DataFrame:
    """(score, above): how many rows have a higher score, from the exact histogram of `score`."""
    out = scores.groupBy("score").agg(F.count("*").alias("n")).withColumn("above", F.lit(0).cast("long"))
    out = out.withColumn("d0", F.lit(highest) - F.col("score"))
    level, counts = 0, out.select(F.col("d0").alias("key"), "n")
    while True:
        siblings = Window.partitionBy(F.shiftright("key", DIGIT_BITS)).orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
        sums = counts.select("key", F.coalesce(F.sum("n").over(siblings), F.lit(0)).alias("before"))
        out = out.join(sums, F.shiftright("d0", DIGIT_BITS * level) == F.col("key")).withColumn("above", F.col("above") + F.col("before")).drop("key", "before")
        level += 1
        if (highest - lowest) >> (DIGIT_BITS * level) == 0:
            return out.select("score", "above")
        counts = counts.groupBy(F.shiftright("key", DIGIT_BITS).alias("key")).agg(F.sum("n").alias("n"))


def draw(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row; rank counts the drawn ones from 1 and is null
    for others. Of the N rows with at least `least_words` words, floor(percent * N / 100) are drawn."""
    scratch = Scratch(docs.sparkSession, "resampling")
    gains = gains_of(bucket_counts(docs.select(F.col("text").cast("string").alias("text"))), bucket_counts(target.select(F.col("text").cast("string").alias("text"))))
    rows = scratch.save(weighed(docs, gains, seed), "weighed")
    able = F.col("n_words") >= least_words
    n, highest, lowest = rows.where(able).agg(F.count("*"), F.max("score"), F.min("score")).first()
    taken = percent * n // 100
    unranked = F.lit(None).cast("long").alias("rank")
    if not taken:
        return rows.select("*", unranked)
    above = scratch.save(offsets(rows.where(able), highest, lowest).where(F.col("above") < taken), "above")
    cutoff = above.agg(F.min("score")).first()[0]
    survives = able & (F.col("score") >= cutoff)
    place = F.row_number().over(Window.partitionBy("score").orderBy("doc_id"))
    ranked = rows.where(survives).join(above, "score").withColumn("rank", F.col("above") + place)
    ranked = ranked.select(*rows.columns, F.when(F.col("rank") <= taken, F.col("rank")).alias("rank"))
    return rows.where(~survives).select("*", unranked).unionByName(ranked)

"""Hashed terms of whole texts and the bounded labelled sample that the classifiers learn from."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

DIM = 1 << 16
MIN_DOCS, MIN_Z, COMMON_DOCS = 8, 5, 100
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
#: Character classes of a word's shape: upper 65, lower and beyond ASCII 97, digit 48, others as they are.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:], _SHAPE[48:58] = 65, 97, 97, 48


def _span_hashes(words: W.Words, starts: np.ndarray, ends: np.ndarray, total: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return W.mixed((total[ends] - total[starts]) * W._inverse[starts] + np.uint64(salt))


def terms(texts: pa.Array, prefixes=(4, 5, 6), shapes: bool = False, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed terms of each text, end to end: (text number, term number below DIM, count), distinct and sorted.

    A word counts with ASCII punctuation cut off its ends and A-Z folded, as its first bytes (`prefixes`), and on
    request as its shape, runs of a character class taken as one. Of terms outside `known` nothing is returned.
    """
    w = W.Words(texts, fold=True)
    doc = w.docs()
    n = len(w.buf)
    W._grow(n + 1)
    starts, ends = w.starts.copy(), w.ends.copy()
    for _ in range(3):
        if len(starts):
            ends -= (ends - starts > 1) & _PUNCT[w.buf[ends - 1]]
            starts += (ends - starts > 1) & _PUNCT[w.buf[starts]]
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(W._FOLDED[w.buf] * W._powers[:n], out=total[1:])
    docs, keys = [doc], [_span_hashes(w, starts, ends, total, 1)]
    for p in prefixes:
        long = ends - starts > p
        docs.append(doc[long])
        keys.append(_span_hashes(w, starts[long], starts[long] + p, total, 1 + p))
    if shapes and n:
        kind = _SHAPE[w.buf]
        new = np.ones(n, bool)
        new[1:] = kind[1:] != kind[:-1]
        new[w.starts] = True
        at = np.append(0, np.cumsum(new))
        with np.errstate(over="ignore"):
            runs = np.append(np.uint64(0), np.cumsum(W._VALUES[kind[new]] * W._powers[: at[-1]]))
            keys.append(W.mixed((runs[at[w.ends]] - runs[at[w.starts]]) * W._inverse[at[w.starts]] + np.uint64(99)))
        docs.append(doc)
    doc, key = np.concatenate(docs).astype(np.int64), (np.concatenate(keys) >> np.uint64(48)).astype(np.int64) % DIM
    if known is not None:
        use = known[key]
        doc, key = doc[use], key[use]
    both = doc * DIM + key
    found, count = np.unique(both, return_counts=True)
    return found // DIM, found % DIM, count


def telling(seen: np.ndarray, seen_in_1: np.ndarray, n: int, n_1: int) -> np.ndarray:
    """Terms that a sample of n texts, n_1 of class 1, allows to learn: their share differs between the classes by
    MIN_Z standard errors, or they are common, so that pairs of terms which tell nothing alone can be learnt too."""
    n_0 = n - n_1
    if not n_0 or not n_1:
        return np.zeros(len(seen), bool)
    p = seen / n
    z = np.abs(seen_in_1 / n_1 - (seen - seen_in_1) / n_0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n_1 + 1 / n_0))
    return (seen >= MIN_DOCS) & (z >= MIN_Z) | (seen >= max(COMMON_DOCS, 0.02 * n))


def learning_fold(doc_id) -> F.Column:
    """Whether labels of this row may be learnt from: crc32 of the id as text, modulo 5, is not 0."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 != 0, F.lit(False))


def least_hashes(ids: DataFrame, n: int, count: int) -> tuple[int, int]:
    """The n-th least (__h, __id) of `count` rows of distinct ids: a cut that about 3 * n rows lie below bounds what
    the driver sees. (-1, 0) if there are no rows, the greatest pair if there are no more than n."""
    if count <= n:
        return (1 << 63) - 1, (1 << 63) - 1
    cut = min((1 << 63) - 1, (1 << 63) * 3 * n // count)
    some = sorted((r["__h"], r["__id"]) for r in ids.where(F.col("__h") <= cut).select("__h", "__id").collect())
    return some[min(n, len(some)) - 1] if some and n else (-1, 0)


def hashed(ids: DataFrame, salt: int) -> DataFrame:
    return ids.withColumn("__h", F.xxhash64("__id", F.lit(salt)).bitwiseAND(F.lit((1 << 63) - 1)))


def below(at: tuple[int, int]):
    return (F.col("__h") < at[0]) | (F.col("__h") == at[0]) & (F.col("__id") <= at[1])


def labelled_ids(labels: DataFrame, label: str, per_class: int) -> tuple[DataFrame, tuple[float, float]]:
    """(__id, y): at most per_class ids of each class of the learning fold, those of least hash, and the number of
    labels that an id of class 0 and one of class 1 stands for (1 where the class is whole)."""
    ids = labels.where(F.col(label).isin(0, 1) & learning_fold(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max(label).cast("int").alias("y"))
    ids = hashed(ids, 7)
    counts = {int(r["y"]): r["count"] for r in ids.groupBy("y").count().collect()}
    use, stands = F.lit(False), [1.0, 1.0]
    for y, n in counts.items():
        use = use | ((F.col("y") == y) & below(least_hashes(ids.where(F.col("y") == y), per_class, n)))
        stands[y] = max(1.0, n / per_class)
    return ids.where(use).select("__id", "y"), (stands[0], stands[1])


def unlabelled_ids(docs: DataFrame, labels: DataFrame, n: int) -> DataFrame:
    """(__id): n ids of documents that have no row in labels, those of least hash. Both sides are cut by hash before
    they meet, at a share that leaves about 3 * n such ids where labels cover only ids of documents."""
    every = hashed(docs.select(F.col("doc_id").cast("long").alias("__id")).where("__id IS NOT NULL"), 11)
    said = hashed(labels.select(F.col("doc_id").cast("long").alias("__id")).where("__id IS NOT NULL"), 11)
    rows, known = every.count(), said.count()
    cut = min((1 << 63) - 1, (1 << 63) * 3 * n // max(rows - known, n, 1))
    free = every.where(F.col("__h") <= cut).join(said.where(F.col("__h") <= cut).select("__id"), "__id", "left_anti").distinct()
    return free.orderBy("__h", "__id").limit(n).select("__id")


def one_row_an_id(rows: DataFrame, *more: str) -> DataFrame:
    """Of rows that repeat a doc_id the least one: by hash of its text (column h), then by all other columns."""
    return rows.groupBy("doc_id").agg(F.min(F.struct("h", *[c for c in rows.columns if c not in ("doc_id", "h")])).alias("r")).select("doc_id", "r.*").drop("h")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))

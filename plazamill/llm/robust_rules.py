"""Quality rules: plain limits, then robust multivariate outliers within each language and source.

A document's statistics become a vector of DIM numbers (see `vector`): mean length of its words, symbols a word,
repeated lines a word, share of words in repeated windows, each damped towards a usual value for short texts and made
roots or logarithms. Per language and source the minimum covariance determinant is sought: the subset of SHARE of the
rows that pass the plain limits whose covariance has the least determinant. A bounded sample of each group (SAMPLE rows
by least hash) gives the start by the usual random subsets; from there STEPS concentration steps run over all rows of
all groups: distances from the last estimate are binned, the bins' counts and integer moments are summed, the nearest
bins that hold the subset's share (the last one whole) give the next mean and covariance. Moments are exact integers,
so results don't depend on the order of rows, and a hot group is summed before it is shuffled. The determinant never
rises; where it would not fall any more further steps change nothing.

FLOOR is added to the variances (most documents have no symbol and no repeated line at all, and would make every
other document infinitely far); the covariance is scaled to be consistent for normal data. A document is rejected when
it fails the plain limits or its squared Mahalanobis distance is above CUT.

Defined cases: groups of fewer than LEAST_ROWS rows that pass the limits are taken together by language, and where
that is too few too, together over all; if even those are too few their documents are judged by the plain limits only. Null
text has no words and fails; null language or source is a value of its own; rows that repeat count again and are
judged alike; very long texts count whole; an empty table gives no rows; columns of other names are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .scratch import Scratch

LEAST_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5
DIM = 4
ONE = 1024  # vectors are integers in units of 1 / ONE
SHARE = 0.75
SAMPLE, STARTS, STEPS = 240, 40, 4
LEAST_ROWS = 60
BINS = 64  # bins of the squared distance to each doubling of 1 + distance
FLOOR = np.array([0.04, 0.05, 0.05, 0.10]) ** 2
CUT = 60.0
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
POINT = [f"x{i}" for i in range(DIM)]
HALF = [(i, j) for i in range(DIM) for j in range(i, DIM)]


def _sums(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(mask))
    return total[bounds[1:]] - total[bounds[:-1]]


def _again(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries stand anywhere else in their document, and which stand earlier in it."""
    order = np.lexsort((key, doc))
    same = (doc[order][1:] == doc[order][:-1]) & (key[order][1:] == key[order][:-1])
    twice, later = np.zeros(len(doc), bool), np.zeros(len(doc), bool)
    later[order[1:]] = same
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    return twice, later


def statistics(texts: pa.Array) -> list[np.ndarray]:
    """COUNTS of each text."""
    w = W.Words(texts)
    buf, bounds, n = w.buf, w.bounds, len(w.first) - 1
    chars = _sums(W._IS_WORD[buf] & ((buf & 0xC0) != 0x80), bounds)
    symbols = _sums(_SYMBOL[buf], bounds)
    doc, key = w.docs(), W.rolling(w.hashes(), WINDOW)
    last = w.first[1:][doc[: len(key)]]
    where = np.flatnonzero(np.arange(len(key)) + WINDOW <= last)
    where = where[_again(doc[where], key[where])[0]]
    depth = np.zeros(len(doc) + 1, np.int64)
    np.add.at(depth, where, 1)
    np.add.at(depth, where + WINDOW, -1)
    repeated = _sums(np.cumsum(depth)[:-1] > 0, w.first)
    breaks = np.flatnonzero(buf == 10)
    starts = np.union1d(bounds[:-1], breaks + 1)
    starts = starts[starts < len(buf)]
    ends = np.minimum(np.append(breaks, bounds[-1])[np.searchsorted(breaks, starts)], bounds[np.searchsorted(bounds, starts, "right")])
    said = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    starts, ends = starts[said], ends[said]
    W._grow(len(buf) + 1)
    with np.errstate(over="ignore"):
        total = np.append(np.uint64(0), np.cumsum(W._VALUES[buf] * W._powers[: len(buf)]))
        line = W.mixed((total[ends] - total[starts]) * W._inverse[starts])
    of = np.searchsorted(bounds, starts, "right") - 1
    return [np.diff(w.first), chars, symbols, np.bincount(of[_again(of, line)[1]], minlength=n), repeated]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, COUNTS and base_failed of every row."""

    def run(batches):
        for b in W.slices(batches):
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *[pa.array(x.astype(np.int64)) for x in statistics(b.column("text"))]], ["doc_id", "lang", "source", *COUNTS])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("lang", "source", "text")])
    counts = rows.mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))
    return counts.withColumn("base_failed", F.expr(f"n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words"))


def vector() -> list[Column]:
    """The statistics as integers in units of 1 / ONE. Twenty further words of five letters damp short texts."""
    n = F.col("n_words") + 20.0
    each = [F.log((F.col("word_chars") + 100.0) / n), F.sqrt(F.col("n_symbols") / n), F.sqrt(F.col("n_dup_lines") / n), F.sqrt(F.col("n_repeat_words") / n)]
    return [F.round(x * ONE).cast("long").alias(name) for x, name in zip(each, POINT)]


def consistency(share: float = SHARE) -> float:
    """What the covariance of the inner `share` of normal data of four dimensions is to be divided by."""
    low, high = 0.0, 100.0
    for _ in range(80):
        x = (low + high) / 2
        low, high = (x, high) if 1 - math.exp(-x / 2) * (1 + x / 2) < share else (low, x)
    return (1 - math.exp(-x / 2) * (1 + x / 2 + x * x / 8)) / share


def estimate(n, sums: np.ndarray, products: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and covariances (with the floor) from counts, sums and products of integer vectors, one row a group."""
    n = np.asarray(n, float)[:, None]
    mean = sums / n
    full = np.empty((len(n), DIM, DIM))
    for k, (i, j) in enumerate(HALF):
        full[:, i, j] = full[:, j, i] = (products[:, k] / n[:, 0] - mean[:, i] * mean[:, j]) / ONE**2
    return mean / ONE, full / consistency() + np.diag(FLOOR)


def squared(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    d = x - mean
    return np.einsum("ni,ij,nj->n", d, np.linalg.inv(cov), d)


def start(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best estimate of a sample: random subsets of DIM + 1 rows, concentrated until the determinant stays."""
    rng, h = np.random.default_rng(9), int(SHARE * len(x)) + 1
    best = (math.inf,)
    for _ in range(STARTS):
        own, last = rng.choice(len(x), DIM + 1, replace=False), math.inf
        for _ in range(20):
            part = x[own]
            cov = np.cov(part.T, bias=True) / consistency() + np.diag(FLOOR)
            det = np.linalg.det(cov)
            if det >= last * (1 - 1e-9):
                break
            last, mean = det, part.mean(0)
            own = np.argsort(squared(x, mean, cov), kind="stable")[:h]
        if last < best[0]:
            best = (last, mean, cov)
    return best[1:]


PARAMETERS = "key string, " + ", ".join([*(f"m{i} double" for i in range(DIM)), *(f"a{i}{j} double" for i, j in HALF)])


def parameters(keys: list[str], means: np.ndarray, covs: np.ndarray) -> pd.DataFrame:
    inverse = np.linalg.inv(covs)
    return pd.DataFrame({"key": keys, **{f"m{i}": means[:, i] for i in range(DIM)}, **{f"a{i}{j}": inverse[:, i, j] for i, j in HALF}})


def distance() -> Column:
    """Squared Mahalanobis distance of a row from its group's parameters."""
    d = [F.col(POINT[i]) / ONE - F.col(f"m{i}") for i in range(DIM)]
    out = F.lit(0.0)
    for i, j in HALF:
        out = out + d[i] * d[j] * F.col(f"a{i}{j}") * (1 if i == j else 2)
    return out


def concentrated(points: DataFrame, known: DataFrame) -> DataFrame:
    """One step: the parameters from the SHARE of each group's rows that are nearest by the known ones."""
    near = points.join(known, "key").withColumn("bin", F.floor(F.log2(1 + distance()) * BINS))
    sums = [F.sum(p).alias(f"s{i}") for i, p in enumerate(POINT)] + [F.sum(F.col(POINT[i]) * F.col(POINT[j])).alias(f"p{i}{j}") for i, j in HALF]
    bins = near.groupBy("key", "bin").agg(F.count("*").alias("n"), *sums)
    group = Window.partitionBy("key")
    inner = bins.withColumn("all", F.sum("n").over(group)).withColumn("before", F.sum("n").over(group.orderBy("bin")) - F.col("n"))
    inner = inner.where(F.col("before") < F.floor(F.col("all") * SHARE) + 1)
    names = [*(f"s{i}" for i in range(DIM)), *(f"p{i}{j}" for i, j in HALF)]
    moments = inner.groupBy("key").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names])

    def solved(frames):
        for f in frames:
            if len(f):
                yield parameters(f["key"].tolist(), *estimate(f["n"], f[names[:DIM]].to_numpy(float), f[names[DIM:]].to_numpy(float)))

    return moments.mapInPandas(solved, PARAMETERS)


def sample_starts(points: DataFrame) -> DataFrame:
    """Parameters from the SAMPLE rows of least hash of each group."""

    def begun(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["h", *POINT])
        mean, cov = start(f[POINT].to_numpy(float) / ONE)
        return parameters([f["key"].iloc[0]], mean[None], cov[None])

    h = F.xxhash64("doc_id", *COUNTS).alias("h")
    place = F.row_number().over(Window.partitionBy("key").orderBy("h", *POINT))
    few = points.select("key", *POINT, h).withColumn("place", place).where(F.col("place") <= SAMPLE)
    return few.groupBy("key").applyInPandas(begun, PARAMETERS)


def keyed(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows with `key`, the group that their estimate comes from: language and source, language or all."""
    sizes = scratch.save(rows.where("NOT base_failed").groupBy("lang", "source").agg(F.count("*").alias("n")), "sizes")
    small = F.col("n") < LEAST_ROWS
    pooled = sizes.where(small).groupBy("lang").agg((F.sum("n") >= LEAST_ROWS).alias("enough"))
    named = sizes.select("lang", "source", small.alias("small")).join(pooled.withColumnRenamed("lang", "l"), F.col("lang").eqNullSafe(F.col("l")), "left")
    key = F.when(~F.col("small"), F.to_json(F.array("lang", "source"))).when(F.col("enough"), F.to_json(F.array("lang"))).otherwise("[]")
    keys = scratch.save(named.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), key.alias("key")), "keys")
    return rows.join(keys, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left").drop("__lang", "__source")


def judge(docs: DataFrame, cut: float = CUT) -> DataFrame:
    """doc_id, lang, source, COUNTS, base_failed, distance (squared; null where no estimate applies) and kept."""
    scratch = Scratch(docs.sparkSession, "rules")
    rows = scratch.save(measured(docs), "measured")
    points = scratch.save(keyed(rows, scratch).select("*", *vector()), "points")
    fitted = points.where("NOT base_failed")
    enough = fitted.groupBy("key").count().where(F.col("count") >= LEAST_ROWS).select("key")
    known = scratch.save(sample_starts(fitted.join(enough, "key")), "start")
    for k in range(STEPS):
        known = scratch.save(concentrated(fitted, known), f"step-{k}")
    far = points.join(known, "key", "left").withColumn("distance", distance())
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= cut)
    return far.select("doc_id", "lang", "source", *COUNTS, "base_failed", "distance", kept.alias("kept"))

"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(bias + sum of term weights + sum over pairs of <v_i, v_j> / n), n the number of terms of the text:
next to the weight of each term there is a learnt weight for each pair of terms, through RANK factors a term, so an
insult beside a group mention can count for more than both apart. It is trained in one task on a bounded sample
(at most PER_CLASS documents of each class of the learning fold, one row an id, see features.labelled_ids) and
broadcast: DIM * (RANK + 1) floats. Texts become terms before they are exchanged. Where the sample holds another share of a class than the labels do, the bias is moved by the
difference of log odds, so scores keep to the labels' shares at every input size. Every document is then scored over
its whole text.

Terms that the sample can't teach (features.telling) have no weight. Defined cases: null or empty text gets the
score of no terms; labels of one class only give every document that class's score, no labels a score of 0.5; label
values other than 0 and 1 are ignored; a document labelled twice is toxic if either says so; of rows that repeat a
labelled id one (of least text hash) is learnt from, and all are scored; repeated texts get one score; ties in hashes
go to the smaller id; very long texts count whole, each term once; columns other than doc_id and text are ignored,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import DIM, labelled_ids, learning_fold, one_row_an_id, sigmoid, telling, terms
from .scratch import Scratch
from .words import slices

RANK = 4
PER_CLASS = 5000
EPOCHS = 8
BATCH = 128


def pair_sums(v: np.ndarray, doc: np.ndarray, idx: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text the sum of its factors, and the pair term before division by the number of terms."""
    sums = np.stack([np.bincount(doc, v[idx, f], n_docs) for f in range(v.shape[1])], 1)
    squares = np.bincount(doc, (v[idx] ** 2).sum(1), n_docs)
    return sums, 0.5 * ((sums**2).sum(1) - squares)


def margins(model, doc: np.ndarray, idx: np.ndarray, n_docs: int) -> np.ndarray:
    bias, w, v = model
    n = np.maximum(np.bincount(doc, minlength=n_docs), 1)
    return bias + np.bincount(doc, w[idx], n_docs) + pair_sums(v, doc, idx, n_docs)[1] / n


def train(samples: list[np.ndarray], y: np.ndarray, seed: int = 1, stands: tuple[float, float] = (1.0, 1.0)):
    """Mini-batch AdaGrad on the logistic loss, over the terms that the sample allows to learn; weights begin at half
    the log odds of their term. A sample of class c stands for stands[c] labels."""
    rng = np.random.default_rng(seed)
    ones = [s for s, one in zip(samples, y) if one]
    seen, in_1 = (np.bincount(np.concatenate(x), minlength=DIM) if x else np.zeros(DIM) for x in (samples, ones))
    use = telling(seen, in_1, len(samples), len(ones))
    samples = [s[use[s]] for s in samples]
    rate = min(max(y.mean() if len(y) else 0, 1e-4), 1 - 1e-4)
    odds = np.log((in_1 + 0.5) / (len(ones) + 1)) - np.log((seen - in_1 + 0.5) / (len(samples) - len(ones) + 1))
    bias, w, v = np.log(rate / (1 - rate)), np.where(use, np.clip(odds, -3, 3) / 2 + 1e-9, 0), rng.normal(0, 0.01, (DIM, RANK)) * use[:, None]
    if 0 < y.sum() < len(y):
        gw, gv, gb = np.full(DIM, 1e-2), np.full((DIM, RANK), 1e-2), 1e-2
        for _ in range(EPOCHS):
            order = rng.permutation(len(samples))
            for a in range(0, len(order), BATCH):
                part = order[a : a + BATCH]
                lens = np.array([len(samples[i]) for i in part])
                idx, doc = np.concatenate([samples[i] for i in part]), np.repeat(np.arange(len(part)), lens)
                sums, pairs = pair_sums(v, doc, idx, len(part))
                n = np.maximum(lens, 1)
                g = sigmoid(bias + np.bincount(doc, w[idx], len(part)) + pairs / n) - y[part]
                d = np.bincount(idx, g[doc], DIM) + 1e-3 * w
                gw += d * d
                w -= 0.1 * d / np.sqrt(gw) * use
                each = (g / n)[doc]
                for f in range(RANK):
                    d = np.bincount(idx, each * (sums[doc, f] - v[idx, f]), DIM) + 1e-3 * v[:, f]
                    gv[:, f] += d * d
                    v[:, f] -= 0.05 * d / np.sqrt(gv[:, f]) * use
                gb += g.sum() ** 2
                bias -= 0.1 * g.sum() / np.sqrt(gb)
        bias += np.log(stands[1] / stands[0])
    return float(bias), w.astype(np.float32), v.astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS):
    """The model (bias, weights, factors); its size does not depend on the input."""
    scratch = Scratch(docs.sparkSession, "fm")
    ids, stands = labelled_ids(labels, label, per_class)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = slim.join(F.broadcast(ids), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "y", F.xxhash64("text").alias("h"))

    def vectors(batches):
        for b in slices(batches):
            doc, idx, _ = terms(b.column("text"))
            edge = np.searchsorted(doc, np.arange(b.num_rows + 1))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), b.column("y"), pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(idx.astype(np.int32)))], ["doc_id", "h", "y", "terms"])

    known = scratch.save(one_row_an_id(sample.mapInArrow(vectors, "doc_id long, h long, y int, terms array<int>")), "sample")

    def learn(batches):
        rows, y = [], []
        for b in batches:
            col = b.column("terms")
            rows += [col[i].values.to_numpy() for i in range(b.num_rows)]
            y += b.column("y").to_pylist()
        bias, w, v = train(rows, np.array(y, float), stands=stands)
        yield pa.RecordBatch.from_arrays([pa.array([bias]), pa.array([w.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())], ["bias", "w", "v"])

    one = known.repartition(1).sortWithinPartitions("doc_id", "y")
    got = one.mapInArrow(learn, "bias double, w binary, v binary").collect()
    scratch.drop()
    return (got[0]["bias"], np.frombuffer(got[0]["w"], np.float32), np.frombuffer(got[0]["v"], np.float32).reshape(DIM, RANK)) if got else (0.0, np.zeros(DIM, np.float32), np.zeros((DIM, RANK), np.float32))


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in slices(batches):
            doc, idx, _ = terms(b.column("text"), known=shared.value[1] != 0)
            s = sigmoid(margins(shared.value, doc, idx, b.num_rows).astype(np.float64))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (~learning_fold(F.col("doc_id"))).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")

"""Quality by co-training two views.

The text view is a linear model over hashed terms of the content (words, word shapes) and over content statistics;
the page view is one over the metadata (source, language, length, layout of lines). Both learn from a bounded sample
of labelled rows; in each round either view labels the pool documents that it is surest of (the same share of each
class as among the labels) and hands them to the other view as training rows. The pool holds no id that has a label.
Then each view is calibrated on labels kept from training (Platt), and the calibrated views are averaged in log odds:
a view weighs what it saves there of the log loss of the bare shares (see weighed), and the average is calibrated once
more. A sampled row weighs as many labels as it stands for wherever shares of classes matter (bias, pseudo-labels,
calibration), so the sample's bound doesn't change them. The models (three small arrays) are broadcast and every
document is scored over its whole text.

Bounds: PER_CLASS labelled ids of each class, POOL unlabelled ones, both by least hash, one row an id; rows become
features before they are exchanged. Defined cases: null or empty text has no terms and is scored by its metadata; null
metadata is a value of its own; without labels of both classes every document gets the share of good labels (1 without
any labels) and is kept; an id labelled twice is good if either says so; of rows that repeat a labelled id the one of
least text hash is learnt from, and all are scored; equal rows get equal scores; ties in hashes go to the smaller id;
very long texts count whole; columns named like the outputs are replaced in any case, further columns pass unread; an
empty table gives no rows. A document is rejected when its score is below 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .features import DIM, labelled_ids, one_row_an_id, sigmoid, telling, terms, unlabelled_ids
from .scratch import Scratch, fresh, small_batches, without

PER_CLASS = 4000
POOL = 4000
ROUNDS = 3
SHARE = 0.1
STATS = 7
BINS = 24


def bucket(x: np.ndarray, low: float, high: float) -> np.ndarray:
    return np.clip((x - low) / (high - low) * BINS, 0, BINS - 1).astype(np.int64)


def text_rows(texts: pa.Array, known: np.ndarray | None = None):
    """(text number, feature, value): share-of-text terms, then one feature per statistic and bin from DIM on."""
    doc, idx, count = terms(texts, prefixes=(), shapes=True, known=known)
    w = W.Words(texts)
    n, size = np.maximum(np.diff(w.first), 1), np.maximum(np.diff(w.bounds), 1)
    number = len(n)
    of_word = w.docs()
    h = w.hashes()
    order = np.lexsort((h, of_word))
    hs, ds = h[order], of_word[order]
    new = np.ones(len(hs), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
    distinct = np.bincount(ds[new], minlength=number)
    most = np.zeros(number, np.int64)
    np.maximum.at(most, ds[new], np.diff(np.append(np.flatnonzero(new), len(hs))))
    of_byte = np.repeat(np.arange(number), np.diff(w.bounds))
    b = w.buf
    share = lambda mask: np.bincount(of_byte[mask], minlength=number) / size
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (of_word[1:] == of_word[:-1])
    stats = [
        bucket(distinct / n, 0, 1), bucket(most / n, 0, 0.5), bucket(size / n, 1, 20), bucket(share((b >= 65) & (b <= 90)), 0, 0.8),
        bucket(share((b > 32) & (b < 128) & W_PUNCT[b]), 0, 0.4), bucket(share((b >= 48) & (b <= 57)), 0, 0.3),
        bucket(np.bincount(of_word[again], minlength=number) / n, 0, 0.8),
    ]
    extra = np.stack([DIM + s * BINS + x for s, x in enumerate(stats)], 1).reshape(-1)
    return np.append(doc, np.repeat(np.arange(number), STATS)), np.append(idx, extra), np.append(np.sqrt(count / n[doc]), np.full(len(extra), 0.5))


W_PUNCT = np.zeros(256, bool)
W_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def page_rows(batch: pa.RecordBatch):
    """(row number, feature, value) from the metadata columns there are (those after the text), the length and the
    layout of lines."""
    n = batch.num_rows
    text = pc.fill_null(batch.column("text"), "")
    size = pc.binary_length(text).to_numpy(zero_copy_only=False).astype(float)
    lines = pc.count_substring(text, "\n").to_numpy(zero_copy_only=False).astype(float) + 1
    said = []
    for c, values in zip(batch.schema.names, batch.columns):
        if c != "text":
            said.append([xxhash.xxh3_64_intdigest(f"{c}={v}") % DIM for v in values.to_pylist()])
    for name, x in (("size", np.log2(size + 1)), ("lines", np.log2(lines)), ("line", np.log2(size / lines + 1))):
        said.append([xxhash.xxh3_64_intdigest(f"{name}:{v}") % DIM for v in np.round(x).astype(int)])
    idx = np.array(said, np.int64).reshape(len(said), n).T.reshape(-1)
    return np.repeat(np.arange(n), len(said)), idx, np.ones(len(idx))


class Rows:
    """Sparse rows laid end to end."""

    def __init__(self, doc, idx, value, n):
        order = np.argsort(doc, kind="stable")
        self.idx, self.value, self.n = idx[order], value[order], n
        self.edge = np.searchsorted(doc[order], np.arange(n + 1))

    @classmethod
    def laid(cls, lens, idx, value):
        """From rows that lie in order already, without a copy."""
        rows = cls.__new__(cls)
        rows.idx, rows.value, rows.n, rows.edge = idx, value, len(lens), np.append(0, np.cumsum(lens))
        return rows

    def pieces(self, which, at_once: int = 1024):
        """take, a number of rows at a time, so no array of all their features is made."""
        for a in range(0, len(which), at_once):
            yield which[a : a + at_once], *self.take(which[a : a + at_once])

    def take(self, which):
        lens = np.diff(self.edge)[which]
        at = np.repeat(self.edge[which] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
        return np.repeat(np.arange(len(which)), lens), self.idx[at], self.value[at]

    def margin(self, model):
        out = np.empty(self.n)
        for which, doc, idx, value in self.pieces(np.arange(self.n)):
            out[which] = model[0] + np.bincount(doc, model[1][idx] * value, len(which))
        return out


def logistic(rows: Rows, which: np.ndarray, y: np.ndarray, stands: np.ndarray, width: int, epochs: int = 6, seed: int = 3):
    """(bias, weights) by mini-batch AdaGrad, over features that the rows allow to learn; the bias is then moved to the
    odds that the classes have when each row counts as the rows it stands for."""
    rng = np.random.default_rng(seed)
    seen, in_1, at = np.zeros(width, np.int64), np.zeros(width), 0
    for part, doc, idx, _ in rows.pieces(which):
        seen += np.bincount(idx, minlength=width)
        in_1 += np.bincount(idx, y[at + doc], width)
        at += len(part)
    use = telling(seen, in_1, len(which), int(y.sum()))
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias, w, g2, b2 = np.log(rate / (1 - rate)), np.zeros(width), np.full(width, 1e-2), 1e-2
    for _ in range(epochs):
        order = rng.permutation(len(which))
        for a in range(0, len(order), 128):
            part = order[a : a + 128]
            doc, idx, value = rows.take(which[part])
            g = sigmoid(bias + np.bincount(doc, w[idx] * value, len(part))) - y[part]
            d = np.bincount(idx, g[doc] * value, width) + 1e-3 * w
            g2 += d * d
            w -= 0.3 * d / np.sqrt(g2) * use
            b2 += g.sum() ** 2
            bias -= 0.3 * g.sum() / np.sqrt(b2)
    if 0 < y.sum() < len(y):
        bias += np.log(stands[y == 1].mean() / stands[y == 0].mean())
    return float(bias), w


def platt(x: np.ndarray, y: np.ndarray, stands: np.ndarray) -> np.ndarray:
    """Intercept and slope (x: one column) of a logistic fit by damped Newton steps; a slope below 0 becomes 0 and the
    intercept is fitted without it. Rows weigh in proportion to what they stand for."""
    weight = stands / stands.mean()

    def fitted(X, ridge):
        b = np.zeros(X.shape[1])
        for _ in range(50):
            p = sigmoid(X @ b)
            step = np.linalg.solve(X.T @ (X * (weight * p * (1 - p))[:, None]) + np.diag(ridge), X.T @ (weight * (y - p)) - ridge * b)
            b += np.clip(step, -1, 1)
            if np.abs(step).max() < 1e-6:
                break
        return b

    one = np.ones((len(y), 1))
    both = fitted(np.column_stack([one, x]), np.array([1e-6, 0.05]))
    return both if both[1] > 0 else np.append(fitted(one, np.array([1e-6])), 0.0)


def log_loss(logit: np.ndarray, y: np.ndarray, stands: np.ndarray) -> float:
    return float(np.average(np.logaddexp(0, np.where(y == 1, -logit, logit)), weights=stands))


def weighed(logits: np.ndarray, y: np.ndarray, stands: np.ndarray) -> np.ndarray:
    """Intercept and one weight per view of the combination: views are averaged by the share of the log loss that each
    takes off that of the bare shares (views that take nothing off: 1 in 1000), then the average is calibrated."""
    good = np.average(y, weights=stands)
    bare = log_loss(np.full(len(y), np.log(good / (1 - good))), y, stands)
    skill = np.maximum([1 - log_loss(x, y, stands) / bare for x in logits.T], 1e-3)
    share = skill / skill.sum()
    a, b = platt((logits @ share)[:, None], y, stands)
    return np.array([a, *(max(b, 1e-3) * share)])


def cotrain(text: Rows, page: Rows, y: np.ndarray, stands: tuple[float, float] = (1.0, 1.0)):
    """y: 1, 0 or -1 (pool); a labelled row of class c stands for stands[c] labels. The two views, their calibrations
    and the weights of the combination."""
    each_stands = np.where(y == 1, stands[1], np.where(y == 0, stands[0], 1.0))
    labelled = np.flatnonzero(y >= 0)
    check, train = labelled[::4], labelled[np.arange(len(labelled)) % 4 != 0]
    pool = np.flatnonzero(y < 0)
    own = {v: (train, y[train].astype(float), each_stands[train]) for v in ("text", "page")}
    views = {"text": (text, DIM + STATS * BINS), "page": (page, DIM)}
    good = np.average(y[train], weights=each_stands[train])
    for turn in range(ROUNDS + 1):
        models = {v: logistic(rows, *own[v], width) for v, (rows, width) in views.items()}
        if turn == ROUNDS or not len(pool):
            break
        for giver, taker in (("text", "page"), ("page", "text")):
            score = views[giver][0].margin(models[giver])[pool]
            order = np.argsort(score, kind="stable")
            n = int(SHARE * (turn + 1) * len(pool))
            low, high = order[: int(n * (1 - good))], order[len(order) - int(n * good) :]
            low, high = low[score[low] < -2], high[score[high] > 2]  # surer than 88 %
            own[taker] = (np.concatenate([train, pool[low], pool[high]]), np.concatenate([y[train], np.zeros(len(low)), np.ones(len(high))]), np.concatenate([each_stands[train], np.ones(len(low) + len(high))]))
    margins = np.column_stack([views[v][0].margin(models[v])[check] for v in ("text", "page")])
    each = [platt(margins[:, [i]], y[check], each_stands[check]) for i in (0, 1)]
    calibrated = np.column_stack([e[0] + e[1] * margins[:, i] for i, e in enumerate(each)])
    return models["text"], models["page"], each, weighed(calibrated, y[check], each_stands[check])


def viewed(docs: DataFrame, metadata: list[str]) -> DataFrame:
    """text and the metadata under names of their own, so that no other column's name matters."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(f"`{c}`").cast("string").alias(f"m_{c.lower()}") for c in metadata])


def known_metadata(docs: DataFrame, metadata) -> list[str]:
    own = {c.lower() for c in docs.columns}
    return [c for c in metadata if c.lower() in own]


def sample_of(docs: DataFrame, labels: DataFrame, label: str, metadata, per_class: int, pool: int) -> tuple[DataFrame, tuple[float, float]]:
    """(doc_id, text, metadata, y) of labelled documents and, with y = -1, of pool documents."""
    rows = viewed(docs, known_metadata(docs, metadata))
    ids, stands = labelled_ids(labels, label, per_class)
    chosen = ids.union(unlabelled_ids(docs, labels, pool).select("__id", F.lit(-1).alias("y")))
    return rows.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).drop("__id"), stands


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", metadata=("source", "lang"), per_class: int = PER_CLASS, pool: int = POOL):
    """The model; its size does not depend on the input."""
    scratch = Scratch(docs.sparkSession, "cotrain")
    rows, stands = sample_of(docs, labels, label, metadata, per_class, pool)
    names = [c for c in rows.columns if c not in ("doc_id", "y")]

    def features(batches):
        for b in W.slices(batches):
            n, kinds = b.num_rows, (pa.int32(), pa.float32())
            lists = []
            for doc, idx, value in (text_rows(b.column("text")), page_rows(b.select(names))):
                r = Rows(doc, idx, value, n)
                lists += [pa.ListArray.from_arrays(pa.array(r.edge.astype(np.int32)), pa.array(x, k)) for x, k in zip((r.idx, r.value), kinds)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), b.column("y"), *lists], ["doc_id", "h", "y", "t_idx", "t_value", "p_idx", "p_value"])

    made = rows.withColumn("h", F.xxhash64("text")).mapInArrow(features, "doc_id long, h long, y int, t_idx array<int>, t_value array<float>, p_idx array<int>, p_value array<float>")
    known = scratch.save(one_row_an_id(made), "sample")

    def learn(batches):
        y, lens, parts = [], ([], []), ([], [], [], [])
        for b in batches:
            y += b.column("y").to_pylist()
            for i, c in enumerate(("t_idx", "t_value", "p_idx", "p_value")):
                x = b.column(c)
                parts[i].append(x.flatten().to_numpy())
                if not i % 2:
                    lens[i // 2].append(pc.list_value_length(x).to_numpy())
        if not y:
            return
        y = np.array(y)
        found = (0.0, np.zeros(DIM + STATS * BINS)), (0.0, np.zeros(DIM)), [np.zeros(2)] * 2, np.array([4.0 if not (y >= 0).any() else np.log((stands[1] * np.sum(y == 1) + 0.5) / (stands[0] * np.sum(y == 0) + 0.5)), 0, 0])
        if (y == 0).sum() >= 8 and (y == 1).sum() >= 8:
            views = [Rows.laid(np.concatenate(n), np.concatenate(i), np.concatenate(v)) for n, i, v in zip(lens, parts[::2], parts[1::2])]
            parts = None
            found = cotrain(*views, y, stands)
        (tb, tw), (pb, pw), each, both = found
        numbers = np.concatenate([[tb, pb], each[0], each[1], both, tw, pw])
        yield pa.RecordBatch.from_arrays([pa.array([numbers.tobytes()], pa.binary())], ["numbers"])

    got = known.repartition(1).sortWithinPartitions("y", F.xxhash64("doc_id", F.lit(5)), "doc_id").mapInArrow(learn, "numbers binary").collect()
    scratch.drop()
    x = np.frombuffer(got[0]["numbers"]) if got else np.concatenate([np.zeros(6), [4, 0, 0], np.zeros(2 * DIM + STATS * BINS)])
    width = DIM + STATS * BINS
    return {"text": (x[0], x[9 : 9 + width]), "page": (x[1], x[9 + width :]), "each": (x[2:4], x[4:6]), "both": x[6:9], "metadata": known_metadata(docs, metadata)}


def score(docs: DataFrame, model) -> DataFrame:
    """All input columns with text_score, page_score, score and keep; columns of these names are replaced. Only the text
    and the metadata go to Python, and only the scores come back."""
    small_batches(docs.sparkSession)
    docs = without(docs, "text_score", "page_score", "score", "keep")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    view = viewed(docs, model["metadata"])
    names = view.columns[1:]

    @F.arrow_udf("struct<text_score double, page_score double, score double, keep boolean>")
    def scores(columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        m = shared.value
        known = m["text"][1][:DIM] != 0
        for whole in columns:
            parts = [pa.array([], SCORES)]
            for b in W.slices([pa.RecordBatch.from_arrays(list(whole), names)]):
                margin = [Rows(*text_rows(b.column("text"), known), b.num_rows).margin(m["text"]), Rows(*page_rows(b), b.num_rows).margin(m["page"])]
                logit = [e[0] + e[1] * x for e, x in zip(m["each"], margin)]
                both = sigmoid(m["both"][0] + m["both"][1] * logit[0] + m["both"][2] * logit[1])
                parts.append(pa.StructArray.from_arrays([pa.array(x) for x in (sigmoid(logit[0]), sigmoid(logit[1]), both, both >= 0.5)], fields=list(SCORES)))
            yield pa.concat_arrays(parts)

    # not deterministic to the optimizer: else it may run the function once for a filter and again for the columns
    called = scores.asNondeterministic()(*[F.col(f"`{c}`").cast("string") for c in ("text", *model["metadata"])])
    (inner,) = fresh(docs, "scores")
    return docs.withColumn(inner, called).select(*[F.col(f"`{c}`") for c in docs.columns], f"{inner}.text_score", f"{inner}.page_score", f"{inner}.score", f"{inner}.keep")


SCORES = pa.struct([("text_score", pa.float64()), ("page_score", pa.float64()), ("score", pa.float64()), ("keep", pa.bool_())])

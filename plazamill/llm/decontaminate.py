"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

The n-grams (three words) of the test items are counted over the whole corpus (documents that hold each), in one pass
for all items behind a Bloom filter of bounded size; the counts are a written table. A seed is an n-gram that is rare
in the corpus (in the share RARE of the documents at most, or at most four times as frequent as the median of its
item) or the rarest of some quarter of its item, so no part of an item is without seeds, however often it leaked.
Documents are joined to items where they hold a seed; seeds on near diagonals make a region; item and region are
aligned word by word (match +1, mismatch and gap -1), and the best local alignment, divided by the item's words, is
the score. From `threshold` on the document leaks the item. An alignment above 0.5 + 1 / words holds three intact
words in a row somewhere, so only copies whose intact runs are all common phrases have no seed.

Items are handled in blocks of at most BLOCK_BYTES of text, each broadcast after that check; any number of blocks is
exact. Documents are never shuffled. A region longer than four items is aligned in windows that overlap by half: a
local alignment of positive score spans less than two items. Array passes are bounded by CELLS. Words have ASCII
punctuation cut off both ends and A-Z folded.

Defined cases: null or empty texts leak nothing and are leaked by nothing; an item with fewer words than a seed is
one seed as a whole; very long texts and items are aligned whole; rows that repeat are judged alike; items that repeat
an id count as one item, the best text deciding (ties: the later place in the document); null item ids are ordinary;
empty tables give no leaks. Input columns named `leaks` are replaced, others pass unread under any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bloom
from . import words as W
from .features import _PUNCT, _span_hashes
from .scratch import Scratch, as_text, without

SEED = 3
RARE = 1e-3
THRESHOLD = 0.5
BLOCK_BYTES = 8 << 20
CELLS = 1 << 17
LEAK = T.ArrayType(T.StructType().add("item_id", "long").add("score", "double").add("start", "integer").add("stop", "integer"))
ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("start", pa.int32()), ("stop", pa.int32())]))


def word_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the trimmed, folded words, end to end, and the first word of each text."""
    w = W.Words(texts, fold=True)
    starts, ends = w.starts.copy(), w.ends.copy()
    for _ in range(2):
        if len(starts):
            ends -= (ends - starts > 1) & _PUNCT[w.buf[ends - 1]]
            starts += (ends - starts > 1) & _PUNCT[w.buf[starts]]
    n = len(w.buf)
    W._grow(n + 1)
    total = np.zeros(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(W._FOLDED[w.buf] * W._powers[:n], out=total[1:])
    return _span_hashes(w, starts, ends, total, 1), w.first


def grams(h: np.ndarray, first: np.ndarray, lengths) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length (where its n-grams begin, their hashes), inside the texts only."""
    out = []
    end = np.repeat(first[1:], np.diff(first))
    for n in lengths:
        g = W.rolling(h, n, salt=0 if n == SEED else n)
        where = np.flatnonzero(np.arange(len(g)) + n <= end[: len(g)])
        out.append((where, g[where]))
    return out


def own_grams(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, place, hash) of the n-grams of items; an item shorter than a seed has one, its whole."""
    size = np.diff(first)
    parts = []
    for n in range(1, SEED + 1):
        which = size >= SEED if n == SEED else size == n
        if which.any():
            ((where, g),) = grams(h, first, [n])
            item = np.searchsorted(first, where, "right") - 1
            use = which[item]
            parts.append((item[use], where[use] - first[item[use]], g[use]))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    item, place, key = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((place, item))
    return item[order], place[order], key[order]


class Items:
    """The test items of one block and their n-grams: sorted keys, and for each the (item, place) pairs that hold it."""

    def __init__(self, ids: list, texts: list):
        h, first = word_keys(pa.array(texts, pa.string()))
        self.words = [h[a:b] for a, b in zip(first[:-1], first[1:])]
        self.ids = ids
        self.lengths = [SEED, *sorted({len(w) for w in self.words if 0 < len(w) < SEED})]
        self.item, self.place, self.gram = own_grams(h, first)
        self.arrange()

    def arrange(self) -> None:
        order = np.argsort(self.gram, kind="stable")
        self.item, self.place, self.gram = self.item[order], self.place[order], self.gram[order]
        self.keys, edge = np.unique(self.gram, return_index=True)
        self.edge = np.append(edge, len(self.gram)).astype(np.int64)

    def choose(self, frequency: np.ndarray, documents: int) -> None:
        """frequency: documents that hold each of `keys`. Keeps the seeds only."""
        of = np.repeat(frequency, np.diff(self.edge))
        order = np.lexsort((self.place, self.item))
        own, keep = of[order], np.zeros(len(of), bool)
        edge = np.append(np.flatnonzero(np.diff(self.item[order], prepend=-1)), len(of))
        for a, b in zip(edge[:-1], edge[1:]):
            f = own[a:b]
            part = max(1, len(f) // 4)
            least = np.lib.stride_tricks.sliding_window_view(f, part).argmin(1) + np.arange(len(f) - part + 1)
            use = f <= max(RARE * documents, 4 * np.median(f))
            use[least] = True
            keep[order[a:b]] = use
        self.item, self.place, self.gram = self.item[keep], self.place[keep], self.gram[keep]
        self.arrange()

    def hits(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the words where an n-gram of the items begins, and the n-gram's number."""
        at, key = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(self.keys):
            for where, g in grams(h, first, self.lengths):
                found = np.minimum(np.searchsorted(self.keys, g), len(self.keys) - 1)
                same = self.keys[found] == g
                at.append(where[same]), key.append(found[same])
        return np.concatenate(at), np.concatenate(key)


def align(items: list[np.ndarray], regions: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each pair and where it ends in the region, pairs that fit CELLS in one pass."""
    widest = max(map(len, regions))
    at_once = max(1, CELLS // widest)
    if len(items) > at_once:
        parts = [align(items[a : a + at_once], regions[a : a + at_once]) for a in range(0, len(items), at_once)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    m, w = max(map(len, items)), max(map(len, regions))
    a, b = np.zeros((len(items), m), np.uint64), np.full((len(items), w), np.uint64(1))
    for i, (x, y) in enumerate(zip(items, regions)):
        a[i, : len(x)], b[i, : len(y)] = x, y
    real = np.arange(w) < np.array([len(y) for y in regions])[:, None]
    last, best, stop = np.zeros((len(items), w + 1), np.int32), np.zeros(len(items), np.int32), np.zeros(len(items), np.int64)
    steps = np.arange(w, dtype=np.int32)
    lens = np.array([len(x) for x in items])
    for i in range(m):
        now = np.maximum(last[:, :-1] + np.where(a[:, i : i + 1] == b, np.int32(1), np.int32(-1)), last[:, 1:] - 1)
        now = np.where(real & (i < lens)[:, None], np.maximum(now, 0), 0)
        now = np.maximum.accumulate(now + steps, 1) - steps  # gaps in the item
        now = np.where(real, now, 0).astype(np.int32)
        top = now.argmax(1)
        score = now[np.arange(len(items)), top]
        stop, best = np.where(score > best, top + 1, stop), np.maximum(best, score)
        last = np.concatenate([np.zeros((len(items), 1), np.int32), now], 1)
    return best, stop


def regions_of(items: Items, at: np.ndarray, key: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(document, item, first word, end) of the text to align: around seeds on diagonals within an item's length of
    the next, cut into windows of four items."""
    count = np.diff(items.edge)[key]
    which = np.repeat(items.edge[:-1][key] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    at, item, place = np.repeat(at, count), items.item[which], items.place[which]
    doc = np.searchsorted(first, at, "right") - 1
    begin = at - place
    order = np.lexsort((begin, item, doc))
    doc, item, begin = doc[order], item[order], begin[order]
    size = np.array([len(w) for w in items.words], np.int64)[item]
    new = np.ones(len(doc), bool)
    new[1:] = (np.diff(doc) != 0) | (np.diff(item) != 0) | (np.diff(begin) > size[1:])
    start = np.flatnonzero(new)
    out = []
    for a, b in zip(start.tolist(), np.append(start[1:], len(doc)).tolist()):
        d, m = int(doc[a]), int(size[a])
        slack = m // 3 + 2
        low, high = max(int(first[d]), int(begin[a]) - slack), min(int(first[d + 1]), int(begin[b - 1]) + m + slack)
        while high - low > 4 * m + 2 * slack:
            out.append((d, int(item[a]), low, low + 4 * m + 2 * slack))
            low += 2 * m
        out.append((d, int(item[a]), low, high))
    return out


def leaks_in(items: Items, texts: pa.Array, threshold: float) -> list[list[dict]]:
    h, first = word_keys(texts)
    found = sorted(regions_of(items, *items.hits(h, first), first), key=lambda x: (len(items.words[x[1]]), x[3] - x[2]))
    out = [{} for _ in range(len(texts))]
    for a in range(0, len(found), 1024):
        part = found[a : a + 1024]
        best, stop = align([items.words[i] for _, i, _, _ in part], [h[low:high] for _, _, low, high in part])
        for (d, i, low, _), x, end in zip(part, best.tolist(), stop.tolist()):
            m, stop_at = len(items.words[i]), int(low - first[d] + end)
            score, old = x / m, out[d].get(items.ids[i])
            if score >= threshold and (old is None or (score, stop_at) > (old["score"], old["stop"])):
                out[d][items.ids[i]] = {"item_id": items.ids[i], "score": score, "start": max(0, stop_at - m), "stop": stop_at}
    return [sorted(x.values(), key=lambda y: (y["item_id"] is None, y["item_id"])) for x in out]


def with_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The input rows with `leaks`: item_id, score and the aligned words (about where) of each leaked item."""
    spark = docs.sparkSession
    docs = without(docs, "leaks")
    out, (whole,) = as_text(docs, ["text"])
    out = out.withColumn("leaks", F.array().cast(LEAK))
    tests = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    size = tests.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(2 * size / block_bytes)) if size > block_bytes else 1
    scratch = Scratch(spark, "grams")
    counts = counted(docs.select(F.col("text").cast("string").alias("text")), tests, scratch)
    documents = docs.count()
    for block in range(blocks):
        rows = tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        items = Items([r["item_id"] for r in rows], [r["text"] for r in rows])
        if len(items.keys):
            own = spark.createDataFrame(pa.table({"own": items.keys.view(np.int64)}))
            got = own.join(counts, F.col("own") == F.col("key")).select("key", "n").toArrow()
            frequency = np.zeros(len(items.keys), np.int64)
            frequency[np.searchsorted(items.keys, got.column("key").to_numpy().view(np.uint64))] = got.column("n").to_numpy()
            items.choose(frequency, documents)
            out = found_in(out, spark.sparkContext.broadcast(items), threshold, whole)
    scratch.drop()
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], "leaks")


def counted(texts: DataFrame, tests: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, n): documents that hold each n-gram of the items; a few n-grams of no item come along."""

    def of_items(batches):
        for b in W.slices(batches):
            h, first = word_keys(b.column("text"))
            key = own_grams(h, first)[2]
            short = np.diff(first)
            short = np.unique(short[(short > 0) & (short < SEED)])
            yield pa.RecordBatch.from_arrays([pa.array(np.append(np.unique(key).view(np.int64), short)), pa.array(np.append(np.zeros(len(np.unique(key)), np.int32), np.ones(len(short), np.int32)), pa.int32())], ["key", "short"])

    keys = scratch.save(tests.select("text").mapInArrow(of_items, "key long, short int").distinct(), "items")
    lengths = [SEED, *sorted(r["key"] for r in keys.where("short = 1").collect())]
    field = bloom.build(keys.where("short = 0").select("key"), "key", bloom.size_for(keys.count()))

    def count(batches):
        for b in W.slices(batches):
            h, first = word_keys(b.column("text"))
            found = []
            for where, g in grams(h, first, lengths):
                maybe = bloom.has(field.value, g)
                found.append(np.stack([g[maybe], np.searchsorted(first, where[maybe], "right").astype(np.uint64)], 1))
            pairs = np.concatenate(found)
            pairs = pairs[np.lexsort(pairs.T[::-1])]
            once = np.ones(len(pairs), bool)
            once[1:] = (pairs[1:] != pairs[:-1]).any(1)
            key, n = np.unique(pairs[once, 0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    return scratch.save(texts.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "counts")


def found_in(rows: DataFrame, shared, threshold: float, whole: str) -> DataFrame:
    """The rows with the leaks of one block of items added to `leaks`; only texts and leaks go to Python."""

    @F.arrow_udf(LEAK)
    def more(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, before in columns:
            found = [pa.array([], ARROW)]
            for b in W.slices([pa.RecordBatch.from_arrays([texts, before], ["text", "leaks"])]):
                new = leaks_in(shared.value, b.column("text"), threshold)
                found.append(pa.array([[*old, *x] for old, x in zip(b.column("leaks").to_pylist(), new)], ARROW))
            yield pa.concat_arrays(found)

    # not deterministic to the optimizer: else it may run the function once for a filter and again for the column
    return rows.withColumn("leaks", more.asNondeterministic()(F.col(f"`{whole}`"), F.col("leaks")))


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per leaked item of a document: doc_id, item_id, score, start, stop."""
    found = with_leaks(docs.select("doc_id", "text"), benchmark, threshold)
    return found.select("doc_id", F.explode("leaks").alias("x")).groupBy("doc_id", "x.item_id").agg(F.max(F.struct("x.score", "x.start", "x.stop")).alias("x")).select("doc_id", "item_id", "x.score", "x.start", "x.stop")

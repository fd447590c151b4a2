"""Removal of repeated substrings by difference-cover anchors.

A window is `window` consecutive words of one document; a word is removed if some window that covers it has a word
sequence that also starts anywhere else, the same document included. All windows are judged on the input.

D = {0, 1, 3, 9} is a difference cover modulo 13: for any two positions i, j some shift k < 13 puts both i + k and
j + k on D modulo 13. So if short anchors of window - 12 words are hashed only at the positions on D (4 of 13), any
two equal windows share an anchor that is aligned in both. Anchors that occur twice are found exactly by one
shuffle of bare hashes; only windows that hold such an anchor can repeat, and these alone are extended: they are hashed
whole (128 bits) and counted by a second shuffle. No pairs are formed, so a passage in a third of all documents
costs as much as any other text.

The rows are packed into chunks with their texts, compressed, in one map-only pass; hashes travel as one sorted
block per chunk and bucket, each value once per chunk with a mark if the chunk itself holds it twice. A bucket answers every
chunk with the bits of the hashes that repeat, and the chunk, met again by its number, cuts its words. A chunk sends at
most one block a bucket and at most one a hash, and a task takes its buckets one after another from a sorted stream, so
work and memory stay in proportion whatever the number of buckets.

Defined cases: words are `[^\\x20\\x09-\\x0D]+`, unchanged; null text has none; text shorter than a window
keeps everything; repeated rows repeat their windows; null ids are ordinary; input columns named like the outputs
(n_words, n_removed, kept_text, removed) are replaced in any case, others pass unread; very long texts are one chunk;
an empty table gives no rows.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bloom
from .scratch import Scratch, without
from .words import Words, rolling, slices

COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16)}
CHUNK_BYTES = 4 << 20
BUCKET_WORDS = 2_000_000
#: Beyond so many, a task takes several buckets.
MOST_TASKS = 20_000


def packed(frame: DataFrame) -> DataFrame:
    """Chunks of the rows: a number that no retry repeats wrongly (it is written once), the words in it, the rows."""

    def run(batches):
        held, size = [], 0
        for b in slices(batches, most=CHUNK_BYTES // 4):
            held.append(b)
            size += b.nbytes
            if size >= CHUNK_BYTES:
                yield chunk(held)
                held, size = [], 0
        if held:
            yield chunk(held)

    def chunk(held):
        t = pa.Table.from_batches(held).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(t)
        n = int(Words(column(t, "text")).first[-1])
        return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().int >> 65], pa.int64()), pa.array([n], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "words", "rows"])

    return frame.mapInArrow(run, "chunk long, words long, rows binary")


def unpacked(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(blob)).read_all().combine_chunks()


def column(t: pa.Table, name: str) -> pa.Array:
    c = t.column(name)
    return c.chunk(0) if c.num_chunks else pa.array([], c.type)


def anchors(words: Words, h: np.ndarray, window: int, period: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in the chunk) and hashes of the anchors that lie on the cover and inside one document."""
    length = window - period + 1
    on = np.zeros(period, bool)
    on[list(COVERS[period])] = True
    counts = np.diff(words.first)
    start = np.repeat(words.first[:-1], counts)
    at = np.arange(len(h)) - start
    ok = on[at % period] & (at + length <= np.repeat(counts, counts)) & np.repeat(counts >= window, counts)
    where = np.flatnonzero(ok[: max(0, len(h) - length + 1)])
    return where, rolling(h, length)[where]


def candidates(words: Words, h: np.ndarray, window: int, period: int, field: np.ndarray) -> np.ndarray:
    """Starts of the windows that hold an anchor which the filter knows."""
    where, key = anchors(words, h, window, period)
    n = len(h)
    hit = np.zeros(n + 1, np.int64)
    hit[1:][where[bloom.has(field, key)]] = 1
    total = np.cumsum(hit)
    counts = np.diff(words.first)
    fits = np.repeat(words.first[1:], counts) - np.arange(n) >= window
    at = np.flatnonzero(fits)
    return at[total[np.minimum(at + period, n)] > total[at]]


def window_keys(h: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """128-bit keys as two columns."""
    out = np.empty((len(at), 2), np.uint64)
    out[:, 0], out[:, 1] = rolling(h, window)[at], rolling(h, window, salt=0x5851F42D)[at]
    return out


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct rows and whether each occurs twice or more."""
    order = np.lexsort(keys.T[::-1]) if keys.ndim == 2 else np.argsort(keys, kind="stable")
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]).any(1) if keys.ndim == 2 else k[1:] != k[:-1]
    first = np.flatnonzero(new)
    return k[first], np.diff(np.append(first, len(k))) > 1


def by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of keys sorted by their first 64 bits, and where each begins, with the end of the last."""
    head = keys[:, 0] if keys.ndim == 2 else keys
    bucket = ((head >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    start = np.flatnonzero(np.diff(bucket, prepend=np.uint64(buckets)))
    return bucket[start].astype(np.int32), np.append(start, len(keys))


def blocks(batches, buckets: int, keys_of):
    for b in batches:
        for i in range(b.num_rows):
            keys, twice = distinct(keys_of(b.column("rows")[i].as_buffer().to_pybytes()))
            full, edge = by_bucket(keys, buckets)
            spans = list(zip(edge[:-1].tolist(), edge[1:].tolist()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(full), pa.array(np.full(len(full), b.column("chunk")[i].as_py(), np.int64)),
                    pa.array([keys[x:y].tobytes() for x, y in spans], pa.binary()), pa.array([np.packbits(twice[x:y]).tobytes() for x, y in spans], pa.binary()),
                ],
                ["bucket", "chunk", "keys", "twice"],
            )


BLOCK = "bucket int, chunk long, keys binary, twice binary"


def groups(batches):
    """The rows of one bucket after another, from rows sorted by bucket."""
    now, held = None, []
    for b in batches:
        for row in b.to_pylist():
            if held and row["bucket"] != now:
                yield held
                held = []
            now = row["bucket"]
            held.append(row)
    if held:
        yield held


def repeated(rows: list[dict], width: int) -> tuple[np.ndarray, np.ndarray]:
    """All keys of a bucket's blocks, end to end, and which of them occur more than once."""
    shape = (-1, 2) if width == 2 else (-1,)
    parts = [np.frombuffer(r["keys"], np.uint64).reshape(shape) for r in rows]
    keys = np.concatenate(parts)
    twice = np.concatenate([np.unpackbits(np.frombuffer(r["twice"], np.uint8))[: len(p)].astype(bool) for r, p in zip(rows, parts)])
    order = np.lexsort(keys.T[::-1]) if width == 2 else np.argsort(keys, kind="stable")
    k = keys[order]
    same = (k[1:] == k[:-1]).all(1) if width == 2 else k[1:] == k[:-1]
    more = np.zeros(len(k), bool)
    more[1:] |= same
    more[:-1] |= same
    twice[order] |= more
    return keys, twice


def remove_repeats(docs: DataFrame, window: int = 35, period: int = 13, filter_bits: int = bloom.MOST_BITS) -> DataFrame:
    """The input rows with n_words, n_removed, kept_text and removed (spans of word numbers, end excluded)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring")
    docs = without(docs, "n_words", "n_removed", "kept_text", "removed")
    chunks = scratch.save(packed(docs), "chunks")
    words = chunks.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    buckets = max(12, math.ceil(words / BUCKET_WORDS))
    tasks = min(buckets, MOST_TASKS)
    spread = chunks.repartition(max(spark.sparkContext.defaultParallelism * 2, min(MOST_TASKS, math.ceil(words / 2_000_000))))

    def anchor_keys(blob):
        w = Words(column(unpacked(blob), "text"))
        return anchors(w, w.hashes(), window, period)[1]

    def twins(batches):
        for rows in groups(batches):
            keys, twice = repeated(rows, 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(keys[twice]).view(np.int64))], ["h"])

    sent = spread.select("chunk", "rows").mapInArrow(lambda bs: blocks(bs, buckets, anchor_keys), BLOCK)
    shared = scratch.save(sent.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(twins, "h long"), "anchors")
    field = bloom.build(shared, "h", bloom.size_for(shared.count(), filter_bits))
    scratch.drop("anchors")

    def keys_of(w: Words):
        h = w.hashes()
        at = candidates(w, h, window, period, field.value)
        return at, window_keys(h, at, window)

    def answers(batches):
        for rows in groups(batches):
            _, twice = repeated(rows, 2)
            ends = np.cumsum([len(r["keys"]) // 16 for r in rows])
            for r, end in zip(rows, ends):
                own = twice[end - len(r["keys"]) // 16 : end]
                if own.any():
                    yield pa.RecordBatch.from_arrays([pa.array([r["chunk"]], pa.int64()), pa.array([r["bucket"]], pa.int32()), pa.array([np.packbits(own).tobytes()], pa.binary())], ["chunk", "bucket", "bits"])

    sent = spread.select("chunk", "rows").mapInArrow(lambda bs: blocks(bs, buckets, lambda blob: keys_of(Words(column(unpacked(blob), "text")))[1]), BLOCK)
    said = sent.repartition(tasks, "bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(answers, "chunk long, bucket int, bits binary")
    said = scratch.save(said.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "bits")).alias("said")), "answers")

    def cut(batches):
        for b in batches:
            for blob, bits in zip(b.column("rows"), b.column("said")):
                t = unpacked(blob.as_buffer().to_pybytes())
                w = Words(column(t, "text"))
                n = int(w.first[-1])
                gone = np.zeros(n + 1, np.int64)
                if bits.as_py():
                    at, keys = keys_of(w)
                    own, _ = distinct(keys)
                    full, edge = by_bucket(own, buckets)
                    dup = np.zeros(len(own), bool)
                    for x in bits.as_py():
                        lo, hi = edge[(j := np.searchsorted(full, x["bucket"])) : j + 2]
                        dup[lo:hi] = np.unpackbits(np.frombuffer(x["bits"], np.uint8))[: hi - lo]
                    # a window repeats if its key does; rank it among the chunk's sorted distinct keys
                    order = np.lexsort(keys.T[::-1])
                    k = keys[order]
                    rank = np.empty(len(k), np.int64)
                    rank[order] = np.cumsum(np.append(False, (k[1:] != k[:-1]).any(1))) if len(k) else 0
                    start = at[dup[rank]]
                    np.add.at(gone, start, 1)
                    np.add.at(gone, start + window, -1)
                yield pa.RecordBatch.from_arrays([*(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in t.columns), *kept(w, np.cumsum(gone)[:n] > 0)], [*t.column_names, "n_words", "n_removed", "kept_text", "removed"])

    out = "n_words long, n_removed long, kept_text string, removed array<struct<start: long, stop: long>>"
    schema = T.StructType([*docs.schema.fields, *spark.createDataFrame([], out).schema.fields])
    return chunks.join(said, "chunk", "left").select("rows", "said").mapInArrow(cut, schema)


def kept(w: Words, gone: np.ndarray) -> list[pa.Array]:
    """For each text: its words, those removed, the rest joined by one space, and the removed spans."""
    counts = np.diff(w.first)
    total = np.append(0, np.cumsum(gone))
    removed = total[w.first[1:]] - total[w.first[:-1]]
    texts, spans, raw = [], [], w.buf.tobytes()
    for i in range(len(counts)):
        a, b = w.first[i], w.first[i + 1]
        own = raw[w.bounds[i] : w.bounds[i + 1]].split()
        if removed[i]:
            g = gone[a:b]
            edge = np.flatnonzero(np.diff(np.concatenate([[False], g, [False]]).astype(np.int8)))
            spans.append([{"start": s, "stop": e} for s, e in edge.reshape(-1, 2).tolist()])
            texts.append(b" ".join([own[j] for j in np.flatnonzero(~g)]))
        else:
            spans.append([])
            texts.append(b" ".join(own))
    pair = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    return [pa.array(counts.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(spans, pair)]

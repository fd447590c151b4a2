"""Source divergence audit: how far the sources of a language are apart in their use of words, and by which words.

Terms are maximal runs of ASCII letters and of characters beyond ASCII, with A-Z lower-cased. A first pass counts, per
language, the documents that hold each term; the terms with at least `least_docs` of them are the language's kept
terms. A second pass recounts their occurrences with an Aho-Corasick automaton over the kept terms, each padded with
the delimiter on both sides, over texts in which every character that is no term character is that delimiter. Kept
terms are dealt by hash to blocks of about BLOCK_BYTES of terms; a block's terms are broadcast (the block bounds their
size), each worker builds their automaton once, and one run over the corpus counts them.

Every group (language, source), and the language, gives each kept term p = 1 + floor(SCALE (count + ALPHA) / (N + ALPHA
V)). Only counts above 0 are held (postings). The distance of two sources is the sum of |p - q| over all kept terms:
postings are dealt by tiles of TILE sources and chunks of terms, a task sums the terms that occur in its two tiles, and
the terms that occur in neither add their number times the difference of the two sources' p at count 0. So no task
holds a language, a source or all pairs.

Arithmetic is exact: 64-bit counts, 38-digit products. Defined cases: null text, language or source reads as ''; a group
without terms, and a language without kept terms (all distances 0), take part; ties in value go to the smaller
item by UTF-8; rows that repeat count again; very long texts count whole (a slice holds one text at least); an empty
table gives no rows; further columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections import Counter
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .scratch import Scratch

LEAST_DOCS = 30
TOP_TERMS = 50
SCALE = 1_000_000_000
ALPHA = 5
BLOCK_BYTES = 4 << 20
TILE = 128
CHUNK_ROWS = 200_000
HELD = 400_000
MERGED = 1_000_000
PART = 4096
SLICE_BYTES = 4 << 20
#: A-Z become a-z; other ASCII that is no letter becomes the delimiter; bytes beyond ASCII stay.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 97 and c <= 122 or c >= 128 else 32 for c in range(256))


def read(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def plain(texts: pa.Array) -> list[bytes]:
    """Each text as terms and delimiters."""
    return [t.translate(_PLAIN) for t in texts.cast(pa.binary()).to_pylist()]


def document_counts(rows: DataFrame) -> DataFrame:
    """(lang, term, docs): how many documents of the language hold the term."""

    def count(batches):
        held: dict[str, Counter] = {}

        def flushed():
            for lang, n in held.items():
                terms = pa.array(n, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), terms, pa.array(n.values(), pa.int64())], ["lang", "term", "docs"])
            held.clear()

        for b in W.slices(batches, most=SLICE_BYTES):
            for lang, text in zip(b.column("lang").to_pylist(), plain(b.column("text"))):
                held.setdefault(lang, Counter()).update(set(text.split()))
            if sum(map(len, held.values())) > HELD:
                yield from flushed()
        yield from flushed()

    return rows.mapInArrow(count, "lang string, term string, docs long").groupBy("lang", "term").agg(F.sum("docs").alias("docs"))


class Automaton:
    """For each language an automaton over its padded terms of one block; texts are read byte by byte."""

    def __init__(self, langs: list[str], terms: list[str]):
        self.of = {}
        for i, (lang, term) in enumerate(zip(langs, terms)):
            self.of.setdefault(lang, ahocorasick.Automaton()).add_word(f" {term.encode().decode('latin-1')} ", i)
        for a in self.of.values():
            a.make_automaton()

    def counts(self, lang: str, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the terms that occur in these texts of the language, and how often."""
        if lang not in self.of:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        text = (b" " + b" ".join(texts) + b" ").decode("latin-1")
        return np.unique(np.fromiter(map(itemgetter(1), self.of[lang].iter(text)), np.int64), return_counts=True)


_built: dict[str, Automaton] = {}


def automaton(block: str, shared) -> Automaton:
    """The block's automaton, built once by each worker; that of another block goes."""
    if block not in _built:
        _built.clear()
        _built[block] = Automaton(*shared.value)
    return _built[block]


PARTS = "lang string, source string, part int, ids binary, counts binary"


def recounted(rows: DataFrame, block: str, shared) -> DataFrame:
    """(lang, source, number, count): occurrences of the block's terms, by the term's number in it, above 0.

    A task adds up what it reads and sends each group's counts packed, PART numbers to a row; those of one group and
    part then meet in one stream, added up row by row.
    """

    def count(batches):
        held: dict[tuple[str, str], list] = {}

        def merged(found: list) -> tuple[np.ndarray, np.ndarray]:
            ids, where = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
            total = np.zeros(len(ids), np.int64)
            np.add.at(total, where, np.concatenate([n for _, n in found]))
            return ids, total

        def flushed():
            out = []
            for (lang, source), found in held.items():
                ids, n = merged(found)
                edge = np.searchsorted(ids, np.arange(0, ids[-1] + PART + 1, PART)) if len(ids) else []
                out += [(lang, source, k, (ids[a:b] - k * PART).astype("<i4").tobytes(), n[a:b].astype("<i8").tobytes()) for k, (a, b) in enumerate(zip(edge[:-1], edge[1:])) if b > a]
            held.clear()
            if out:
                kinds = (pa.string(), pa.string(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], ["lang", "source", "part", "ids", "counts"])

        size = 0
        for b in W.slices(batches, most=SLICE_BYTES):
            groups: dict[tuple, list[bytes]] = {}
            for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), plain(b.column("text"))):
                groups.setdefault((lang, source), []).append(text)
            for (lang, source), texts in groups.items():
                ids, n = automaton(block, shared).counts(lang, texts)
                held.setdefault((lang, source), []).append((ids, n))
                size += len(ids)
            if size > MERGED:
                held = {g: [merged(found)] for g, found in held.items()}
                size = sum(len(found[0][0]) for found in held.values())
                if size > MERGED // 2:
                    yield from flushed()
                    size = 0
        yield from flushed()

    def add(batches):
        of, total = None, np.zeros(PART, np.int64)

        def summed():
            used = np.flatnonzero(total)
            names = [pa.array([x] * len(used), pa.string()) for x in of[:2]]
            out = pa.RecordBatch.from_arrays([*names, pa.array((used + of[2] * PART).astype(np.int32)), pa.array(total[used])], ["lang", "source", "number", "count"])
            total[:] = 0
            return out

        for b in batches:
            for *group, ids, n in zip(*[c.to_pylist() for c in b.columns]):
                if of is not None and group != of:
                    yield summed()
                of = group
                total[np.frombuffer(ids, "<i4")] += np.frombuffer(n, "<i8")
        if of is not None:
            yield summed()

    parts = rows.mapInArrow(count, PARTS)
    return parts.repartition("lang", "source", "part").sortWithinPartitions("lang", "source", "part").mapInArrow(add, "lang string, source string, number int, count long")


def share(count: str, total: str = "total", kept: str = "kept"):
    """p of a count as a SQL expression, in exact arithmetic; 0 for a language without kept terms."""
    top = f"(CAST({count} AS DECIMAL(20,0)) + {ALPHA}) * CAST({SCALE} AS DECIMAL(10,0))"
    return F.expr(f"CASE WHEN {kept} = 0 THEN 0L ELSE 1L + {top} DIV (CAST({total} AS DECIMAL(20,0)) + {ALPHA} * CAST({kept} AS DECIMAL(20,0))) END")


def counted(rows: DataFrame, kept: DataFrame, scratch: Scratch, block_bytes: int) -> DataFrame:
    """(lang, source, term, count) of all kept terms, above 0: one run over the corpus for each block of terms."""
    spark = rows.sparkSession
    size = kept.agg(F.coalesce(F.sum(F.octet_length("term") + 2), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    parts = []
    for block in range(blocks):
        terms = kept.where(F.pmod(F.xxhash64("lang", "term"), F.lit(blocks)) == block).select("lang", "term").orderBy("lang", "term").toArrow()
        shared = spark.sparkContext.broadcast((terms.column("lang").to_pylist(), terms.column("term").to_pylist()))
        found = scratch.save(recounted(rows, scratch.path(str(block)), shared), f"counts-{block}")
        shared.destroy()
        named = spark.createDataFrame(pa.table({"number": pa.array(range(len(terms)), pa.int32()), "term": terms.column("term")}))
        parts.append(found.join(scratch.save(named, f"terms-{block}"), "number").drop("number"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


PAIRS = "lang string, source string, item string, apart long, seen long, bare long"


def tile_sums(table: pa.Table, width: int) -> pa.Table:
    """One chunk of the terms of two tiles of sources. Rows without a term give a source and its p at count 0. Per pair
    of sources: the sum of |p - q| over the chunk's terms, their number, and |p - q| of a term that neither has."""
    at = {n: table.column(n).combine_chunks() for n in ("lang", "source", "number", "term", "p", "low", "high")}
    base = np.asarray(pc.is_null(at["term"]))
    number, p, names = at["number"].to_numpy(), at["p"].to_numpy(), at["source"]
    low, high = at["low"][0].as_py(), at["high"][0].as_py()
    sources, first = np.unique(number[base], return_index=True)
    first = np.flatnonzero(base)[first]
    bare, names = p[first], names.take(pa.array(first)).to_pylist()
    row = np.searchsorted(sources, number[~base])
    terms = at["term"].filter(pa.array(~base)).dictionary_encode()
    n_terms, column, value = len(terms.dictionary), terms.indices.to_numpy(), p[~base]
    mine, other = (sources // width == low), (sources // width == high)
    a, b = np.flatnonzero(mine), np.flatnonzero(other)
    total = np.zeros((len(a), len(b)), np.int64)
    order = np.argsort(column, kind="stable")
    row, column, value = row[order], column[order], value[order]
    for start in range(0, n_terms, 1024):
        x, y = np.searchsorted(column, [start, start + 1024])
        dense = np.repeat(bare[:, None], min(1024, n_terms - start), 1)
        dense[row[x:y], column[x:y] - start] = value[x:y]
        ours, theirs = dense[a], dense[b]
        for i in range(len(a)):
            total[i] += np.abs(theirs - ours[i]).sum(1)
    i, j = np.nonzero(a[:, None] < b[None, :]) if low == high else (x.ravel() for x in np.indices(total.shape))
    out = {"apart": total[i, j], "seen": np.full(len(i), n_terms, np.int64), "bare": np.abs(bare[a[i]] - bare[b[j]])}
    lang = at["lang"][0].as_py()
    return pa.table({"lang": pa.array([lang] * len(i), pa.string()), "source": pa.array([names[k] for k in a[i]], pa.string()), "item": pa.array([names[k] for k in b[j]], pa.string()), **{k: pa.array(v, pa.int64()) for k, v in out.items()}})


def distances(groups: DataFrame, postings: DataFrame, width: int) -> DataFrame:
    """(lang, source, item, value) of every ordered pair of sources of a language. groups: lang, source, number (from 0
    within the language), total, kept, tiles and chunks of the language; postings: those and term and p."""
    both = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("facing")
    tile = F.floor(F.col("number") / width).cast("int")
    common = ["lang", "source", "number", "kept", "term", "p", "chunk"]
    held = postings.withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int")).select(*common, both)
    bare = groups.withColumn("term", F.lit(None).cast("string")).withColumn("p", share("0")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = held.unionByName(bare.select(*common, both)).withColumn("low", F.least(tile, "facing")).withColumn("high", F.greatest(tile, "facing"))
    sums = rows.groupBy("lang", "low", "high", "chunk").applyInArrow(lambda table: tile_sums(table, width), PAIRS)
    one_way = sums.groupBy("lang", "source", "item").agg(F.sum("apart").alias("apart"), F.sum("seen").alias("seen"), F.max("bare").alias("bare"))
    kept = groups.select(F.col("lang").alias("__lang"), "kept").distinct()
    value = F.col("apart") + (F.col("kept") - F.col("seen")) * F.col("bare")
    valued = one_way.join(kept, F.col("lang") == F.col("__lang")).select("lang", "source", "item", value.alias("value"))
    ways = F.array(F.struct(F.col("source").alias("s"), F.col("item").alias("i")), F.struct(F.col("item").alias("s"), F.col("source").alias("i")))
    return valued.select("lang", "value", F.explode(ways).alias("w")).select("lang", F.col("w.s").alias("source"), F.col("w.i").alias("item"), "value")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, block_bytes: int = BLOCK_BYTES, chunk_rows: int = CHUNK_ROWS, width: int = TILE) -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value, rank."""
    scratch = Scratch(docs.sparkSession, "divergence")
    rows = read(docs)
    kept = scratch.save(document_counts(rows).where(F.col("docs") >= least_docs), "kept")
    counts = counted(rows.where("text != ''"), kept, scratch, block_bytes)
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"))
    sums = counts.groupBy("lang", "source").agg(F.sum("count").alias("total"), F.count("*").alias("held"))
    named = rows.select("lang", "source").distinct().join(langs, "lang", "left").join(sums, ["lang", "source"], "left").na.fill(0)
    of_lang = Window.partitionBy("lang")
    groups = scratch.save(
        named.withColumn("number", F.row_number().over(of_lang.orderBy("source")) - 1)
        .withColumn("tiles", F.ceil(F.count("*").over(of_lang) / width).cast("int"))
        .withColumn("chunks", F.greatest(F.lit(1), F.ceil(F.sum("held").over(of_lang) / chunk_rows)).cast("int")),
        "groups",
    )
    postings = scratch.save(counts.join(groups, ["lang", "source"]).withColumn("p", share("count")), "postings")
    of_term = postings.groupBy("lang", "term").agg(F.sum("count").alias("in_lang"))
    all_in = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("kept").alias("kept"))
    usual = of_term.join(all_in, "lang").select("lang", "term", share("in_lang").alias("q"))
    more = postings.join(usual, ["lang", "term"]).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    terms = more.select("*", rank).where(F.col("rank") <= top)
    pairs = distances(groups, postings, width).withColumn("part", F.lit("pair"))
    return pairs.select("lang", "source", "part", "item", "value", rank).unionByName(terms)

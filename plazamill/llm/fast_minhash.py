"""Near duplicates by fast similarity sketching, banding and exact verification.

A document is its set of distinct word shingles. Its sketch has `bins` coordinates: in round i every shingle is
hashed to one bin with a value that begins with i, and a bin keeps its least value; rounds go on until every bin is
filled (after `bins` random rounds, round bins + j fills bin j), so small sets fill as surely as large ones, and the
share of equal coordinates is concentrated about the Jaccard similarity. `bands` groups of `rows` coordinates are
bucket keys: at similarity 0.8 a pair misses all 50 bands of 6 with probability below 3e-7.

Equal sets form a class, and only classes are linked. Inside a bucket no pairs are listed wholesale: a class is
verified against the best leader of its buckets first, then against all their leaders; buckets that hold several
components even then are gathered into clusters and compared in blocks. So every candidate pair that isn't in one
component already is verified exactly, on full sets recomputed from the texts; pairs inside a component need no
check, since they can't change it.

Defined cases: words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased; with fewer words than a shingle the
whole sequence is the one shingle; null text, empty text and text of blanks have an empty set, linked with nothing;
rows with a null id take no part (component null, kept); rows that repeat an id share a fate: if their texts differ,
all their sets are linked through the id, and each is verified against its candidates; very long texts are whole sets;
columns other than doc_id and text are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .graph import components
from .scratch import Scratch
from .words import Words, mixed, rolling, slices

BANDS, ROWS = 50, 6
HUB, BLOCK, COLUMNS = 500, 512, 4096
#: Tables of one row per node with a partner are broadcast up to this many rows, else exchanged: the driver
#: builds one for every join with the components, and holds it until it is collected.
BROADCAST_IDS = 50_000
SKETCH_BYTES = 2 << 20


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, laid end to end, and each text's number of them."""
    words = Words(texts, fold=True)
    h, first = words.hashes(), words.first
    counts = np.diff(first)
    n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    ends = np.cumsum(n)
    flat = np.empty(ends[-1] if len(ends) else 0, np.uint64)
    every = rolling(h, k)
    short = {j: rolling(h, j, salt=j) for j in range(1, k) if (counts == j).any()}
    for i in range(len(n)):
        a, m = first[i], n[i]
        if m:
            own = flat[ends[i] - m : ends[i]]
            own[:] = every[a : a + m] if counts[i] >= k else short[counts[i]][a]
            own.sort()
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    new[(ends - n)[n > 0]] = True
    sizes = np.zeros(len(n), np.int64)
    np.add.at(sizes, np.repeat(np.arange(len(n)), n), new)
    return flat[new], sizes


def sketches(flat: np.ndarray, sizes: np.ndarray, bins: int) -> np.ndarray:
    """The fast similarity sketch of each non-empty set, one row of `bins` values each."""
    unset = np.uint64(2**64 - 1)
    out = np.full(len(sizes) * bins, unset)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    with np.errstate(over="ignore"):
        for i in range(2 * bins):
            x = mixed(flat + np.uint64(0x9E3779B97F4A7C15) * np.uint64(i + 1))
            value = (x & np.uint64(0xFFFFFFFF)) | np.uint64(i << 32)
            at = doc * bins + (((x >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64) if i < bins else doc * bins + (i - bins)
            free = out[at] == unset
            np.minimum.at(out, at[free], value[free])
            if i < 4 or i % 4 == 3:
                open_ = (out.reshape(-1, bins) == unset).any(1)[doc]
                if not open_.any():
                    break
                flat, doc = flat[open_], doc[open_]
    return out.reshape(-1, bins)


def marks(docs: DataFrame, k: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, set size, 128-bit key of the set, and its bucket keys; the last three null for empty sets."""
    c1, c2 = np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3)
    weights = mixed(np.arange(1, rows + 1).astype(np.uint64)) | np.uint64(1)
    tag = mixed(np.arange(1, bands + 1).astype(np.uint64) << np.uint64(20))

    def run(batches):
        for b in slices(batches, most=SKETCH_BYTES):
            flat, sizes = shingle_sets(b.column("text"), k)
            full = np.flatnonzero(sizes)
            key1, key2 = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)
            lists = pa.nulls(len(sizes), pa.list_(pa.int64()))
            if len(full):
                starts = np.cumsum(sizes[full]) - sizes[full]
                with np.errstate(over="ignore"):
                    key1[full], key2[full] = np.add.reduceat(mixed(flat ^ c1), starts), np.add.reduceat(mixed(flat ^ c2), starts)
                    s = sketches(flat, sizes[full], bands * rows).reshape(-1, bands, rows)
                    keys = mixed((s * weights).sum(2, dtype=np.uint64) + tag)
                offsets = np.zeros(len(sizes) + 1, np.int64)
                np.cumsum(np.where(sizes > 0, bands, 0), out=offsets[1:])
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(keys.reshape(-1).view(np.int64)))
            gone = sizes == 0
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(sizes), pa.array(key1.view(np.int64), mask=gone), pa.array(key2.view(np.int64), mask=gone), lists],
                ["doc_id", "n_shingles", "k1", "k2", "bands"],
            )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>")


def verified(pairs: DataFrame, sets: DataFrame, k: int, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (u, v) whose full sets have 100 * intersection >= percent * union.

    A pair travels to its u: the texts of u (one, unless rows repeat the id) come first and are held, those of its
    partners follow. A hub with more than HUB partners is dealt over several tasks, each with a copy of its texts.
    """
    hubs = pairs.groupBy("u").agg(F.ceil(F.count("*") / HUB).alias("__deals"))
    dealt = pairs.join(hubs, "u").select("u", "v", F.pmod(F.xxhash64("v"), F.col("__deals")).alias("deal"))
    wanted = dealt.select(F.col("v").alias("doc_id"), "u", "deal", F.lit(1).alias("kind")).union(dealt.select(F.col("u").alias("doc_id"), "u", "deal", F.lit(0).alias("kind")).distinct())
    rows = sets.join(wanted, "doc_id").repartition("u", "deal").sortWithinPartitions("u", "deal", "kind").select("u", "kind", "doc_id", "text")

    def run(batches):
        hub, held = None, []
        for b in slices(batches):
            flat, sizes = shingle_sets(b.column("text"), k)
            ends = np.cumsum(sizes)
            us, kinds, ids = b.column("u").to_numpy(), b.column("kind").to_numpy(), b.column("doc_id").to_numpy()
            good = np.zeros(len(us), bool)
            for i in range(len(us)):
                mine = flat[ends[i] - sizes[i] : ends[i]]
                if hub != us[i]:
                    hub, held = us[i], []
                if not kinds[i]:
                    held.append(mine.copy())
                    continue
                for own in held:
                    if len(own) and len(mine) and 100 * min(len(own), len(mine)) >= percent * max(len(own), len(mine)):
                        at = np.searchsorted(own, mine)
                        both = int((own[np.minimum(at, len(own) - 1)] == mine).sum())
                        good[i] |= 100 * both >= percent * (len(own) + len(mine) - both)
            if good.any():
                yield pa.RecordBatch.from_arrays([pa.array(us[good]), pa.array(ids[good])], ["u", "v"])

    return scratch.save(rows.mapInArrow(run, "u long, v long"), name)


def in_blocks(placed: DataFrame, sets: DataFrame, k: int, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """Links (u, v) between the rows (id, now, cluster) of one cluster whose components (now) differ.

    A cluster is cut into blocks of about BLOCK documents and every two blocks meet in one task, which counts all
    common shingles by products of 0/1 matrices and returns links that join components, a forest at most. No pair
    of documents becomes a row.
    """
    size = placed.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n"))
    dealt = placed.join(size, "cluster").withColumn("own", F.pmod(F.xxhash64("id"), F.col("n")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, n - 1)")))
    dealt = dealt.select("id", "now", "cluster", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own")
    rows = sets.join(dealt, F.col("doc_id") == F.col("id")).repartition("cluster", "a", "b").sortWithinPartitions("cluster", "a", "b", "id").select("cluster", "a", "b", "own", "id", "now", "text")

    def run(batches):
        at, held = None, []
        for s in slices(batches):
            flat, sizes = shingle_sets(s.column("text"), k)
            ends = np.cumsum(sizes)
            for i, (c, a, b, own, name, now) in enumerate(zip(*(s.column(j).to_pylist() for j in range(6)))):
                if at != (c, a, b):
                    yield from links(held, at)
                    at, held = (c, a, b), []
                held.append((own, name, now, flat[ends[i] - sizes[i] : ends[i]].copy()))
        yield from links(held, at)

    def links(held, at):
        left = [x for x in held if x[0] == at[1]]
        right = [x for x in held if x[0] == at[2]]
        found = joined(left, right, percent) if left and right else []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["u", "v"])

    return scratch.save(rows.mapInArrow(run, "u long, v long"), name)


def joined(left: list, right: list, percent: int) -> list[tuple[int, int]]:
    """left, right: (block, id, component, sorted set) rows; a forest of the similar pairs across components."""
    na, nb = (np.array([len(x[3]) for x in side]) for side in (left, right))
    ca, cb = (np.array([x[2] for x in side]) for side in (left, right))
    flat = np.concatenate([x[3] for side in (left, right) for x in side])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    row = np.repeat(np.arange(len(left) + len(right)), np.concatenate([na, nb]))
    use = count[column] > 1
    row, column = row[use], number[column[use]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(left), len(right)), np.float32)
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, [a, a + COLUMNS])
        x = np.zeros((len(left) + len(right), COLUMNS), np.float32)
        x[row[lo:hi], column[lo:hi] - a] = 1
        common += x[: len(left)] @ x[len(left) :].T
    similar = (100 * common >= percent * (na[:, None] + nb[None, :] - common)) & (ca[:, None] != cb[None, :])
    parent: dict[int, int] = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(similar)):
        x, y = top(int(ca[i])), top(int(cb[j]))
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((left[i][1], right[j][1]))
    return out


def labelled(frame: DataFrame, comps: DataFrame, column: str, out: str, small: bool) -> DataFrame:
    """With the component of a column's node, itself where it has no link. small: comps is known to fit a broadcast."""
    side = comps.select(F.col("id").alias("__id"), F.col("comp").alias("__comp"))
    return frame.join(F.broadcast(side) if small else side.hint("merge"), F.col(column) == F.col("__id"), "left").withColumn(out, F.coalesce("__comp", column)).drop("__id", "__comp")


def bucket_members(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """(band, rep, lead) of each bucket of two classes or more.

    The lead of a bucket is its member that meets most others in all of its buckets (ties: the least id): among
    edited copies of one text that is the text itself, since copies are nearer to it than to one another.
    """
    every = classes.select("rep", F.explode("bands").alias("band"))
    shared = every.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    met = scratch.save(every.join(shared, "band"), "met")
    degree = met.groupBy("rep").agg(F.sum(F.col("n") - 1).alias("degree"))
    ranked = scratch.save(met.join(degree, "rep").select("band", "rep", "degree"), "ranked")
    best = ranked.groupBy("band").agg(F.max(F.struct("degree", (-F.col("rep")).alias("least"))).alias("best"))
    return scratch.save(ranked.drop("degree").join(best, "band").select("band", "rep", (-F.col("best.least")).alias("lead"), F.col("best.degree").alias("degree")), "members")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (the least id reachable), kept (it is that id)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = scratch.save(marks(slim, k, bands, rows), "marks")
    known = marked.where("doc_id IS NOT NULL AND k1 IS NOT NULL")
    classes = scratch.save(known.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands")), "classes")
    tagged = scratch.save(marked.select("doc_id", "n_shingles", "k1", "k2").join(classes.select("k1", "k2", "rep"), ["k1", "k2"], "left").drop("k1", "k2"), "tagged")
    # an id in several classes ties their least ids together
    several = tagged.where("doc_id IS NOT NULL AND rep IS NOT NULL").groupBy("doc_id").agg(F.min("rep").alias("v"), F.max("rep").alias("w")).where("v <> w")
    ties = scratch.save(tagged.join(several.select("doc_id", "v"), "doc_id").where("rep <> v").select(F.col("rep").alias("u"), "v").distinct(), "ties")

    members = bucket_members(classes, scratch)
    wanted = scratch.save(members.select(F.col("rep").alias("doc_id")).distinct(), "wanted")
    n_wanted = wanted.count()
    small = n_wanted <= BROADCAST_IDS
    field = bloom.build(wanted.select(F.xxhash64("doc_id").alias("h")), "h", bloom.size_for(n_wanted))

    def maybe(batches):
        for b in batches:
            h = b.column("h").to_numpy().view(np.uint64)
            yield b.filter(pa.array(bloom.has(field.value, h))).drop_columns(["h"])

    some = slim.where("doc_id IS NOT NULL").select("doc_id", "text", F.xxhash64("doc_id").alias("h")).mapInArrow(maybe, "doc_id long, text string")
    # one row, unless rows repeat the id with several texts: then each of them counts
    sets = scratch.save(some.join(F.broadcast(wanted) if small else wanted.hint("merge"), "doc_id", "left_semi").groupBy("doc_id", F.xxhash64("text").alias("h"), F.length("text").alias("l")).agg(F.min("text").alias("text")).select("doc_id", "text"), "sets")

    def settle(comps: DataFrame | None, found: DataFrame, turn: int) -> DataFrame:
        """The components once the links found are added."""
        if comps is None:
            return scratch.save(components(found, scratch, "c0"), "comps-0")
        linked = scratch.save(labelled(labelled(found, comps, "u", "cu", small), comps, "v", "cv", small).select("u", "v", "cu", "cv"), f"linked-{turn}")
        joined = scratch.save(components(linked.select(F.col("cu").alias("u"), F.col("cv").alias("v")), scratch, f"c{turn}"), f"joined-{turn}")
        every = comps.union(linked.select("u", "cu")).union(linked.select("v", "cv")).distinct()
        return scratch.save(labelled(every, joined, "comp", "top", small).select("id", F.col("top").alias("comp")), f"comps-{turn}")

    best = F.max(F.struct("degree", (-F.col("lead")).alias("least")))["least"]
    tried = scratch.save(members.where("rep <> lead").groupBy("rep").agg((-best).alias("u")).select("u", F.col("rep").alias("v")), "tried-0")
    found = verified(tried, sets, k, percent, scratch, "links-0")
    comps = settle(None, scratch.save(found.union(ties), "edges-0"), 0)

    more = labelled(labelled(members, comps, "rep", "comp", small), comps, "lead", "lead_comp", small).where("comp <> lead_comp").select(F.col("lead").alias("u"), F.col("rep").alias("v")).distinct()
    found = verified(scratch.save(more.join(tried, ["u", "v"], "left_anti"), "tried-1"), sets, k, percent, scratch, "links-1")
    comps = settle(comps, found, 1)

    # buckets that still hold several components: all their pairs, in blocks, wherever the components differ
    now = scratch.save(labelled(members, comps, "rep", "comp", small), "now")
    several = now.groupBy("band").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("band")
    rest = now.join(several, "band")
    rest = scratch.save(rest.select("rep", "lead", "comp").distinct(), "rest")
    clusters = components(scratch.save(rest.select(F.col("rep").alias("u"), F.col("lead").alias("v")).distinct(), "rest-links"), scratch, "c2")
    placed = clusters.withColumnRenamed("comp", "cluster").join(rest.groupBy("rep").agg(F.min("comp").alias("now")), F.col("id") == F.col("rep")).select("id", "now", "cluster")
    comps = settle(comps, in_blocks(scratch.save(placed, "placed"), sets, k, percent, scratch, "links-2"), 2)

    for name in ("marks", "classes", "ties", "met", "ranked", "members", "wanted", "sets", "now", "rest", "placed"):  # the result reads tagged and the last components
        scratch.drop(name)
    out = labelled(tagged, comps, "rep", "top", small).withColumn("component_id", F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("top", "rep", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))

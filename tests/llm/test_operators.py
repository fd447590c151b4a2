"""The ten operators against brute force, with nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plazamill.llm import bloom, chat_format, cotrain, decontaminate, fast_minhash, features, graph, mixing, perm_index, sharding, substring_dedup, token_store, toxicity_fm, words
from plazamill.llm.scratch import Scratch

WORD = re.compile("[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def corpus(seed=1, n=60):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(2, 7))) for _ in range(400)]
    say = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    base, passage = say(300), say(60)
    rows = []
    for i in range(n):
        t = say(r.randint(1, 200))
        if i % 6 == 0:
            t = base
        elif i % 6 == 1:
            w = base.split()
            for _ in range(i % 9):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            t = " ".join(w)
        elif i % 6 == 2:
            t = f"{t}\n{passage}\t{say(10)}"
        rows.append((i, t, "en", f"s{i % 4}" if i % 7 else None, len(t), "x"))
    rows += [(1000, None, None, None, None, None), (1001, "", "en", "s1", 0, None), (1002, " \t\n", "en", "s1", 3, None), (1003, say(20_000), "en", "s2", 1, None), (1004, "Uno", None, "s3", 3, None), (1005, "uno", None, "s3", 3, None)]
    rows += [(None, "sin id", "en", "s1", 6, None), (7, rows[7][1], "en", rows[7][3], 1, "again")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_words_are_the_pattern(rows):
    texts = [r[1] for r in rows] + ["á b c\x0bd\x1ce", "a" * 100_000]
    w = words.Words(pa.array(texts))
    raw = w.buf.tobytes()
    got = [[raw[s:e].decode() for s, e in zip(w.starts[a:b], w.ends[a:b])] for a, b in zip(w.first[:-1], w.first[1:])]
    assert got == [WORD.findall(t or "") for t in texts]
    flat = [x for g in got for x in g]
    assert len(set(flat)) == len(set(w.hashes().tolist()))
    assert words.Words(pa.array(["AbC é", "abc É"]), fold=True).hashes()[[0, 2]].tolist() == [words.Words(pa.array(["abc"]), fold=True).hashes()[0]] * 2


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(5000).selectExpr("xxhash64(id) AS h")
    field = bloom.build(keys, "h", bloom.size_for(5000)).value
    inside = np.array([r["h"] for r in keys.collect()]).view(np.uint64)
    assert bloom.has(field, inside).all()
    assert bloom.has(field, words.mixed(np.arange(20_000).astype(np.uint64))).mean() < 0.05


def test_components_both_ways(spark, monkeypatch):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (3, 1), (20, 21), (21, 5)]
    frame = spark.createDataFrame(edges, "u long, v long")
    want = {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 20: 5, 21: 5, 5: 5}
    assert {r["id"]: r["comp"] for r in graph.components(frame, Scratch(spark, "t"), "a").collect()} == want
    monkeypatch.setattr(graph, "LOCAL_LINKS", 0)
    assert {r["id"]: r["comp"] for r in graph.components(frame, Scratch(spark, "t"), "b").collect()} == want


# --- 1: decontamination


def test_decontamination(spark, docs, rows):
    r = random.Random(5)
    other = [" ".join(f"w{r.randrange(3000)}" for _ in range(30)) for _ in range(4)]
    edited = other[0].split()
    for i in (3, 11, 12, 20):
        edited[i] = "otra"
    del edited[25]
    leak = spark.createDataFrame(
        [(1, f"prefix {other[0]} suffix", "z"), (2, "uno dos " + " ".join(edited).upper() + " tres", "z"), (3, " ".join(other[1].split()[:9]), "z"), (4, other[2] + ". " + other[3], "z"), (5, None, "z"), (6, "Corto  texto!", "z"), (1, other[1], "z")],
        "doc_id long, text string, leaks string",
    )
    bench = spark.createDataFrame([(10 + i, t) for i, t in enumerate(other)] + [(20, None), (21, ""), (22, "corto texto"), (10, "nada que ver aqui nunca")], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x["score"] for x in decontaminate.leaks(leak, bench).collect()}
    assert set(got) == {(1, 10), (1, 11), (2, 10), (4, 12), (4, 13), (6, 22)}
    assert got[1, 10] == 1 and 0.6 < got[2, 10] < 0.9
    assert decontaminate.leaks(docs, bench).count() == 0
    assert decontaminate.leaks(leak.where("false"), bench).count() == 0 and decontaminate.leaks(leak, bench.where("false")).count() == 0
    marked = decontaminate.with_leaks(leak, bench)
    assert marked.count() == 7 and marked.columns.count("leaks") == 1
    small = {(x["doc_id"], y["item_id"]) for x in decontaminate.with_leaks(leak, bench, block_bytes=300).collect() for y in x["leaks"]}
    assert small == set(got)


def test_alignment_is_smith_waterman():
    def slow(a, b):
        h, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
                best = max(best, h[i][j])
        return best

    r = np.random.default_rng(3)
    pairs = [(r.integers(2, 9, r.integers(1, 30)).astype(np.uint64), r.integers(2, 9, r.integers(1, 50)).astype(np.uint64)) for _ in range(60)]
    best, _ = decontaminate.align([a for a, _ in pairs], [b for _, b in pairs])
    assert best.tolist() == [slow(a.tolist(), b.tolist()) for a, b in pairs]


def slow_score(a, b):
    """Best local alignment of two word lists (match +1, mismatch and gap -1)."""
    h, best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)], 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_decontamination_against_brute_force(spark):
    """All pairs of document and item aligned; edited, cut, stretched and shuffled copies among plain texts."""
    r = random.Random(12)
    items = [[f"v{r.randrange(700)}" for _ in range(r.choice([1, 2, 3, 9, 20, 40]))] for _ in range(14)]
    docs = []
    for i in range(120):
        w = [f"v{r.randrange(700)}" for _ in range(r.randrange(60))]
        if i % 2:
            copy = list(r.choice(items))
            for _ in range(r.randrange(1 + len(copy) // 2)):
                j = r.randrange(len(copy))
                copy[j : j + 1] = r.choice([[], ["nuevo"], [copy[j], "relleno"]])
                copy = copy or ["nada"]
            w[len(w) // 2 : len(w) // 2] = copy[: r.randrange(1 + len(copy))] if i % 3 == 0 else copy
        docs.append((i, " ".join(w)))
    stretched = [x for j, v in enumerate(items[-1]) for x in ([v, "y"] if j % 3 == 2 else [v])]
    docs += [(900, " ".join(stretched)), (901, (" ".join(items[5]) + " ") * 30), (902, "v1 " * 5000 + " ".join(items[6]))]
    want = {(d, 100 + i): s / len(item) for d, t in docs for i, item in enumerate(items) if (s := slow_score(item, t.split()) if d < 902 else len(item) * (i == 6)) >= 0.5 * len(item)}
    frame = spark.createDataFrame(docs, "doc_id long, Text string").withColumn("__text", F.lit(1))
    bench = spark.createDataFrame([(100 + i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(x["doc_id"], y["item_id"]): y["score"] for x in decontaminate.with_leaks(frame, bench).collect() for y in x["leaks"]}
    got = {k: v for k, v in got.items() if k[0] != 902 or k[1] == 106}
    at_edge = {k for k, v in want.items() if v <= 0.5 + 1 / len(items[k[1] - 100])}  # may hold no three words in a row
    assert set(got) <= set(want) and set(want) - set(got) <= at_edge and (900, 113) in got
    assert all(got[k] == pytest.approx(want[k]) for k in got)


def test_seed_choice_keeps_every_part_and_is_linear():
    import time

    r = random.Random(3)
    texts = [" ".join(f"w{r.randrange(50_000)}" for _ in range(60)) for _ in range(8000)]
    items = decontaminate.Items(list(range(8000)), texts)
    often = np.where(np.arange(len(items.keys)) % 3 == 0, 100_000, 1)
    began = time.time()
    items.choose(often, 1_000_000)
    assert time.time() - began < 5
    for i in range(0, 8000, 997):
        places = np.sort(items.place[items.item == i])
        assert np.diff(np.concatenate([[-1], places, [58]])).max() <= 16


# --- 2: substrings


@pytest.mark.parametrize("buckets", [1, 12, 999, 8_000_000])
def test_buckets_are_monotone_and_cheap(buckets):
    keys = np.sort(np.random.default_rng(1).integers(0, 2**64, 5000, np.uint64))
    full, edge = substring_dedup.by_bucket(keys, buckets)
    assert (np.diff(full) > 0).all() and edge[0] == 0 and edge[-1] == 5000 and len(edge) == len(full) + 1
    assert full.min() >= 0 and full.max() < buckets
    assert len(substring_dedup.by_bucket(keys[:0], buckets)[0]) == 0


def test_difference_covers():
    for v, d in substring_dedup.COVERS.items():
        assert {(a - b) % v for a in d for b in d} == set(range(v))


@pytest.mark.parametrize("window,period", [(35, 13), (20, 7), (30, 21)])
def test_substring_removal(spark, docs, rows, window, period):
    count, split = Counter(), [WORD.findall(r[1] or "") for r in rows]
    for w in split:
        count.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    want = []
    for r, w in zip(rows, split):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        want.append((str(r[0]), len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    out = substring_dedup.remove_repeats(docs.withColumnRenamed("extra", "kept_text"), window, period)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_words", "n_removed", "kept_text", "removed"]
    got = [(str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_text"]) for r in out.collect()]
    assert sorted(got) == sorted(want)
    assert all(sum(x["stop"] - x["start"] for x in r["removed"]) == r["n_removed"] for r in out.collect())


def test_substring_inside_one_document_and_empty(spark, docs):
    phrase = " ".join(f"p{i}" for i in range(40))
    one = spark.createDataFrame([(1, f"{phrase} medio {phrase}")], "doc_id long, text string")
    assert substring_dedup.remove_repeats(one).first()["kept_text"] == "medio"
    assert substring_dedup.remove_repeats(docs.where("false")).count() == 0


# --- 3, 4: classifiers


def labelled(spark, n=400):
    r = random.Random(2)
    good = [f"palabra{i}" for i in range(60)]
    docs, labels = [], []
    for i in range(n):
        toxic, junk = i % 5 == 0, i % 7 == 3
        w = [r.choice(good) for _ in range(40)]
        if toxic:
            w[r.randrange(40)] = "insulton"
        if junk:
            w = [x.upper() + "!!" for x in w[:5]] * 8
        docs.append((i, " ".join(w), "es", f"s{i % 3}"))
        labels.append((i, int(not junk), int(toxic and not junk)))
    docs += [(n, None, None, None), (n + 1, "", "es", "s1"), (None, "sin id", "es", None)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels + [(5, None, None), (99_999, 1, 1)], "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    docs, labels = labelled(spark)
    truth = {r["doc_id"]: r["toxic"] for r in labels.where("toxic IS NOT NULL").collect()}
    out = toxicity_fm.score(docs, toxicity_fm.fit(docs, labels)).collect()
    assert len(out) == 403
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert held and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in held)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    assert {r["score"] for r in toxicity_fm.score(docs, toxicity_fm.fit(docs, labels.where("false"))).collect()} == {0.5}
    assert toxicity_fm.score(docs.where("false"), toxicity_fm.fit(docs.where("false"), labels)).count() == 0


def test_factorization_learns_a_pair():
    r = np.random.default_rng(0)
    rows, y = [], []
    for i in range(3000):
        a, b = r.random() < 0.5, r.random() < 0.5
        rows.append(np.array(sorted({*([1] if a else []), *([2] if b else []), *r.integers(10, 40, 3).tolist()})))
        y.append(float(a and b))
    y = np.array(y)
    model = toxicity_fm.train(rows, y)
    doc = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    right = (toxicity_fm.margins(model, doc, np.concatenate(rows), len(rows)) > 0) == (y > 0)
    assert right.mean() > 0.9 and np.abs(model[2][[1, 2]]).max() > 0.05


def test_quality(spark):
    docs, labels = labelled(spark)
    truth = {r["doc_id"]: r["quality"] for r in labels.where("quality IS NOT NULL").collect()}
    out = cotrain.score(docs.withColumn("score", docs["lang"]), cotrain.fit(docs, labels))
    assert out.columns == ["doc_id", "text", "lang", "source", "text_score", "page_score", "score", "keep"]
    got = {r["doc_id"]: r["keep"] for r in out.collect()}
    assert np.mean([got[i] == bool(q) for i, q in truth.items() if i in got]) > 0.97
    assert all(r["keep"] for r in cotrain.score(docs, cotrain.fit(docs, labels.where("false"))).collect())
    assert cotrain.score(docs.where("false"), cotrain.fit(docs, labels)).count() == 0


def test_shares_of_classes_survive_the_sample(spark):
    r = random.Random(6)
    docs = [(i, " ".join(r.choice("abcdefgh") * 3 for _ in range(20)), "es", "s0") for i in range(2500)]
    labels = [(i, int(i % 10 != 0), int(i % 10 == 0)) for i in range(2500)]
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for bound in (100, 5000):
        toxic = toxicity_fm.score(docs, toxicity_fm.fit(docs, labels, per_class=bound)).collect()
        assert 0.03 < np.mean([x["score"] for x in toxic]) < 0.2 and np.mean([x["predicted"] for x in toxic]) < 0.05
        good = cotrain.score(docs, cotrain.fit(docs, labels, per_class=bound, pool=200)).collect()
        assert all(0.8 < np.mean([x[c] for x in good]) < 0.97 for c in ("score", "text_score", "page_score")) and np.mean([x["keep"] for x in good]) > 0.95


def test_samples_are_bounded_and_pool_is_unlabelled(spark):
    docs, labels = labelled(spark)
    many = docs.union(spark.createDataFrame([(8, f"otro texto {i % 3}", "es", "s1") for i in range(3000)], docs.schema))
    for view in (toxicity_fm.fit(many, labels, per_class=50), toxicity_fm.fit(many.repartition(5), labels, per_class=50)):
        first = locals().get("first", view)
        assert all(np.array_equal(a, b) for a, b in zip(first, view))
    ids, stands = features.labelled_ids(labels, "toxic", 50)
    got = ids.groupBy("y").count().collect()
    assert all(r["count"] <= 50 for r in got) and stands[0] > 1
    for pool in (20, 4000):
        rows, _ = cotrain.sample_of(many, labels, "quality", ("source", "lang"), 60, pool)
        free = {r["doc_id"] for r in rows.where("y = -1").collect()}
        assert len(free) <= pool and not free & {r["doc_id"] for r in labels.collect()}
    with_free = docs.union(spark.createDataFrame([(10_000 + i, f"libre {i}", "es", "s1") for i in range(200)], docs.schema))
    rows, _ = cotrain.sample_of(with_free, labels, "quality", ("source", "lang"), 60, 50)
    free = [r["doc_id"] for r in rows.where("y = -1").collect()]
    assert len(free) == len(set(free)) == 50
    made = features.one_row_an_id(many.select("doc_id", F.xxhash64("text").alias("h"), "text")).where("doc_id = 8").collect()
    assert len(made) == 1


def test_least_hashes_is_the_exact_cut(spark):
    ids = features.hashed(spark.range(3000).withColumnRenamed("id", "__id"), 7)
    want = sorted((r["__h"], r["__id"]) for r in ids.collect())[:100]
    assert sorted((r["__h"], r["__id"]) for r in ids.where(features.below(features.least_hashes(ids, 100, 3000))).collect()) == want


def test_both_quality_views_count(spark):
    """The page tells something of its own, so its weight is above 0 and scores change without it."""
    r = random.Random(4)
    docs, labels = [], []
    for i in range(1200):
        good = r.random() < 0.6
        text = " ".join(r.choice(["claro", "sereno", "pleno"] if good == (r.random() < 0.85) else ["gratis", "oferta", "ya"]) if j == 3 else f"w{r.randrange(50)}" for j in range(12))
        docs.append((i, text, "es", ("sA" if good == (r.random() < 0.8) else "sB")))
        labels.append((i, int(good), 0))
    docs, labels = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    labels = labels.where("doc_id < 900")
    model = cotrain.fit(docs, labels)
    assert model["both"][1] > 0.05 and model["both"][2] > 0.05
    alone = {**model, "both": np.array([model["both"][0], model["both"][1], 0.0])}
    a, b = ({x["doc_id"]: x["score"] for x in cotrain.score(docs, m).collect()} for m in (model, alone))
    assert sum(abs(a[i] - b[i]) > 0.01 for i in a) > 300
    names = docs.selectExpr("doc_id", "text AS Text", "lang AS LANG", "source AS Source", "1 AS y", "2 AS h", "3 AS m_source", "4 AS KEEP")
    again = cotrain.score(names, cotrain.fit(names, labels)).collect()
    assert {x["doc_id"]: round(x["score"], 9) for x in again} == {i: round(v, 9) for i, v in a.items()}


def test_classifier_cases(spark):
    """Repeated rows, very long texts and ties get defined scores; other columns don't matter."""
    docs, labels = labelled(spark)
    odd = spark.createDataFrame([(5000, "palabra1 " * 200_000, "es", "s1"), (5001, "palabra1 insulton", "es", "s1"), (5001, "palabra1 insulton", "es", "s1"), (5002, "\x00 \u2028", None, None)], docs.schema)
    every = docs.union(odd).withColumns({"y": F.lit(3), "terms": F.lit(1), "held_out": F.lit("x"), "Predicted": F.lit(None).cast("int")})
    out = toxicity_fm.score(every, toxicity_fm.fit(every, labels)).where("doc_id >= 5000").collect()
    plain_out = toxicity_fm.score(docs.union(odd), toxicity_fm.fit(docs.union(odd), labels)).where("doc_id >= 5000").collect()
    assert len(out) == 4 and sorted(map(tuple, out)) == sorted(map(tuple, plain_out))
    assert len({r["score"] for r in out if r["doc_id"] == 5001}) == 1
    kept = cotrain.score(every, cotrain.fit(every, labels)).where("doc_id >= 5000").collect()
    assert len(kept) == 4 and len({r["score"] for r in kept if r["doc_id"] == 5001}) == 1


# --- 5: mixing


def test_mixing(spark, docs, rows):
    clashing = docs.withColumnRenamed("extra", "size").withColumns({c: docs["lang"] for c in ("whole", "part", "seed", "weight", "level")})
    assert {"whole", "part", "seed", "copies", "target"} < set(mixing.copies(clashing).columns)
    out = mixing.copies(clashing).collect()
    assert len(out) == len(rows)
    size, total = defaultdict(int), 0
    for r in rows:
        size[r[3]] += len(WORD.findall(r[1] or ""))
    total = sum(size.values())
    names = sorted([s for s in size if s is not None]) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, free = {}, set(size)
    while True:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * size[s]}
        if not over:
            target.update(share)
            break
        target.update({s: 3 * size[s] for s in over})
        free -= over
    for r in out:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["copies"] <= 3
    again = mixing.copies(docs).collect()
    assert sorted((str(r["doc_id"]), r["copies"]) for r in out) == sorted((str(r["doc_id"]), r["copies"]) for r in again)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in out)
    assert mixing.copies(docs.where("false")).count() == 0
    assert {r["copies"] for r in mixing.copies(docs.where("text IS NULL")).collect()} == {0}


def test_mixing_salted_join_is_the_same(spark, docs, monkeypatch):
    want = sorted((str(r["doc_id"]), r["copies"]) for r in mixing.copies(docs).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted((str(r["doc_id"]), r["copies"]) for r in mixing.copies(docs).collect()) == want


# --- 6: near duplicates


def brute_components(rows, k, percent=80):
    sets = {}
    for i, t in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.setdefault(i, set()).update({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in sets}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, docs, rows, k):
    want = brute_components([(r[0], r[1]) for r in rows if r[0] is not None], k)
    out = fast_minhash.near_duplicates(docs, k=k).collect()
    assert len(out) == len(rows)
    for r in out:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])


def test_near_duplicates_chain_and_blocks(spark, monkeypatch):
    """Copies that are alike only through others, compared in blocks of a few documents; hubs dealt out."""
    monkeypatch.setattr(fast_minhash, "BLOCK", 4)
    monkeypatch.setattr(fast_minhash, "HUB", 3)
    r = random.Random(9)
    w = [f"w{r.randrange(900)}" for _ in range(120)]
    rows = []
    for i in range(40):
        for _ in range(60 if i % 13 == 12 else 5):
            w[r.randrange(len(w))] = f"n{r.randrange(10_000)}"
        rows.append((i, " ".join(w)))
    want = brute_components(rows, 2)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in fast_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=2).collect()}
    assert got == want and len({c for _, c in want.values()}) > 1
    assert fast_minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string"), k=2).count() == 0


def test_repeated_ids_with_different_texts(spark, monkeypatch):
    r = random.Random(11)
    say = lambda: [f"w{r.randrange(5000)}" for _ in range(80)]
    A, B, C, D = say(), say(), say(), say()
    near = lambda w: " ".join([*w[:40], "otra", *w[41:]])
    rows = [(2, " ".join(A)), (3, " ".join(B)), (5, " ".join(A)), (5, " ".join(B)), (7, " ".join(C)), (7, " ".join(D)), (8, near(C)), (9, near(D)), (9, near(D)), (11, "solo"), (11, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(9) for c in ("rep", "bands", "k1", "comp", "n")})
    want = {2: 2, 3: 2, 5: 2, 7: 7, 8: 7, 9: 7, 11: 11}
    for small in (fast_minhash.BROADCAST_IDS, 0):
        monkeypatch.setattr(fast_minhash, "BROADCAST_IDS", small)
        got = fast_minhash.near_duplicates(frame, k=2).collect()
        assert len(got) == len(rows) and {x["doc_id"]: x["component_id"] for x in got} == want
        assert all(len({x["component_id"] for x in got if x["doc_id"] == i}) == 1 for i in want)


def test_sketch_fills_and_estimates():
    r = np.random.default_rng(1)
    a = r.integers(0, 2**63, 400).astype(np.uint64)
    sets = [np.unique(x) for x in (a, np.concatenate([a[:360], r.integers(0, 2**63, 40).astype(np.uint64)]), a[:1])]
    s = fast_minhash.sketches(np.concatenate(sets), np.array([len(x) for x in sets]), 300)
    assert (s != np.uint64(2**64 - 1)).all()
    assert abs((s[0] == s[1]).mean() - 360 / 440) < 0.1


# --- 7: chats


def test_chat_round_trip(spark):
    odd = ["<|im_end|><|im_start|>assistant ok", "<\\|x|> \\ <|", "", None, "a\n<|im_start|>user\nb", "é" * 3000, "\\n<\\\\|"]
    rows = [(c, t, role, text) for c in (1, 2) for t, (role, text) in enumerate(zip(["user", "assistant"] * 4, odd))]
    rows += [(3, t, "assistant" if t % 2 else "us\ner<|", f"turno {t} <|im_end|>") for t in range(80)]
    rows += [(5, t, "user" if t % 2 else "assistant", f"largo {t % 7}") for t in range(1500)] + [(6, 0, "assistant", "muy largo <|x|> " * 100_000)]
    rows += [(4, 0, None, None), (4, 0, "assistant", "b"), (4, 0, "assistant", "a"), (None, None, "assistant", "sin id")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    frame = frame.withColumns({c: F.lit("otra") for c in ("formatted", "spans", "loss", "n_turns")})
    by = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda x: (str(x[0]), -1 if x[1] is None else x[1], x[2] or "", x[3] or "")):
        by[c].append((role or "", text or ""))
    got = {r["conv_id"]: r for r in chat_format.digests(chat_format.format_chats(frame)).collect()}
    assert set(got) == set(by)
    for c, turns in by.items():
        said = "".join(t for r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["loss_chars"] == len(said) and not got[c]["rewrites_history"]
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert got[c]["formatted_chars"] == len(chat_format.chatml(turns))
    assert chat_format.digests(chat_format.format_chats(frame.where("false"))).count() == 0


def test_rewriting_template_is_found():
    drops_thoughts = lambda turns: "".join(f"[{r}:{'' if i < len(turns) - 1 and r == 'assistant' else t}]" for i, (r, t) in enumerate(turns))
    turns = [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")]
    assert chat_format.formatted(turns, drops_thoughts)[2:] == ([], True)
    for n in (24, 26, 27, 60):  # history is rewritten at one length only, or at odd lengths from three on
        at_ten = lambda turns: ("!" if len(turns) == 10 else "") + "".join(f"[{t}]" for _, t in turns)
        at_odd = lambda turns: ("!" if len(turns) % 2 and len(turns) > 2 else "") + "".join(f"[{t}]" for _, t in turns)
        assert all(chat_format.formatted((turns * 15)[:n], f)[2:] == ([], True) for f in (at_ten, at_odd))
    plain = lambda turns: "<s>" + "".join(f"[{r}:{t}]" for r, t in turns)
    for n in (4, 60):
        whole, spans, loss, rewrites = chat_format.formatted(turns * (n // 4), plain)
        assert not rewrites and [whole[a:b] for a, b in loss] == ["b", "d"] * (n // 4) and "".join(whole[a:b] for a, b in spans) == whole


# --- 8: neighbours


def test_nearest(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(1500, 16))
    x[100:400] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] * 16), (2004, [None] * 16), (2005, [1.0] * 15), (None, [1.0] * 16)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = perm_index.search(frame.withColumns({c: F.lit(1) for c in ("id", "v", "block", "copy", "kind")}), frame.where("vec_id % 100 = 0"), k=10, reach=0.3).collect()
    by = defaultdict(list)
    for o in sorted(out, key=lambda o: (o["query_id"], o["rank"])):
        by[o["query_id"]].append((o["vec_id"], o["score"]))
    hits = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(x)), d))[:10]
        hits += len(set(best) & {v for v, _ in by[q]})
        assert all(s == pytest.approx(d[v]) for v, s in by[q]) and len(by[q]) == 10
    assert hits / 150 >= 0.9
    assert [v for v, _ in by[100]] == [50, *range(101, 110)]
    assert perm_index.search(frame.where("vec_id < 4"), frame.where("vec_id = 0")).count() == 3
    assert perm_index.search(frame.where("false"), frame).count() == 0


def recall(frame, queries, k=10):
    """Mean recall of the ids at distances up to the exact k-th, and the rows of each query."""
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in frame.collect()]
    ids, x = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    by = defaultdict(list)
    for r in perm_index.search(frame, queries, k).collect():
        by[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    share = []
    for q in {r["vec_id"] for r in queries.collect()}:
        d = np.sqrt(((x - x[np.flatnonzero(ids == q)[0]]) ** 2).sum(1))
        near = np.sort(d[ids != q])[:k]
        share.append(np.mean([s <= near[-1] for _, _, s in by[q]] + [False] * (len(near) - len(by[q]))))
        assert [r for r, _, _ in sorted(by[q])] == list(range(1, len(near) + 1))
    return float(np.mean(share))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_with_production_parameters(spark, sf):
    frame = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding")
    assert recall(frame, frame.where("vec_id % 20 = 0")) >= 0.9


def test_recall_beside_a_hot_vector(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(3000, 24))
    hashes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>").select("i", F.xxhash64("v").alias("h")).orderBy("h").collect()
    hot = x[hashes[0]["i"]].tolist()
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(10_000 + i, hot) for i in range(6000)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert len(perm_index.pivots_of(perm_index.usable(frame, "vec_id", "embedding"))) == perm_index.PIVOTS
    assert recall(frame, frame.where("vec_id % 100 = 0 AND vec_id < 10000")) >= 0.9


def test_nearest_of_repeated_ids_and_lengths(spark):
    rows = [(1, [0.0, 1.0])] * 15 + [(2, [0.0, 1.0]), (3, [0.0, 1.1]), (4, [5.0, 1.0]), (4, [0.0, 1.05]), (5, [1.0, 2.0, 3.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in perm_index.search(frame, frame.where("vec_id = 1"), k=2).orderBy("rank").collect()]
    assert [g[:3] for g in got] == [(1, 1, 2), (1, 2, 4)] and got[0][3] == 0 and got[1][3] == pytest.approx(0.05)
    assert perm_index.search(frame, frame.where("vec_id = 5"), k=2).count() == 0


# --- 9: shards


def test_shards(spark, docs, rows):
    out = sharding.shard(docs.withColumnRenamed("extra", "shard"), 5, piece_bytes=8000)
    got = out.collect()
    assert len(got) == len(rows) and out.columns.count("shard") == 1
    slots, size = defaultdict(list), defaultdict(int)
    for r in got:
        assert r["size"] == len((r["text"] or "").encode()) + 16
        slots[r["shard"]].append(r["slot"])
        size[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    biggest, ideal = max(r["size"] for r in got), sum(size.values()) / 5
    assert all(abs(size[s] - ideal) <= biggest for s in size)
    assert sharding.shard(docs.where("false"), 5).count() == 0


def brute_shards(rows, n):
    """Splitters by sorting everything: the boundary key nearest each ideal, in bytes."""
    keys = sorted(((h, -(1 << 63) if i is None else i), z) for h, i, z in rows)
    edge, at = {}, 0
    for k, z in keys:
        edge.setdefault(k, at)
        at += z
    edges = [*edge.items(), ((1 << 63, 0), at)]
    return [min(edges, key=lambda e: abs(e[1] - at * j / n))[1] for j in range(1, n)]


def test_shards_against_sorting_everything(spark, docs, monkeypatch):
    """Hot text, repeated identical rows, inner names taken, small tolerance: bytes below each boundary are the best."""
    hot = spark.createDataFrame([(3000 + i, "siempre lo mismo " * 20, "en", "s0", 1, None) for i in range(200)] + [(4000, "igual", "en", "s0", 1, None)] * 30, SCHEMA)
    every = docs.union(hot).withColumns({c: F.col("lang") for c in ("key1", "PLACE", "piece", "first", "of", "inside", "n")}).repartition(5)
    got = sharding.shard(every, 7, tolerance=1e-9, piece_bytes=9000).withColumn("h", F.xxhash64("text")).collect()
    want = brute_shards([(r["h"], r["doc_id"], r["size"]) for r in got], 7)
    below, slots = Counter(), defaultdict(list)
    for r in got:
        below.update({j: r["size"] for j in range(r["shard"], 6)})
        slots[r["shard"]].append(r["slot"])
        assert r["PLACE"] == r["lang"] == r["n"]
    total, biggest = sum(r["size"] for r in got), 30 * (5 + 16)
    for j in range(6):
        ideal = total * (j + 1) / 7
        assert abs(below[j] - ideal) <= max(abs(want[j] - ideal), 1) + 1e-6 or abs(below[j] - ideal) <= biggest
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(got) == every.count()
    again = sharding.shard(every.repartition(2), 7, tolerance=1e-9, piece_bytes=50_000).collect()
    shown = lambda rows: Counter((r["doc_id"], r["text"], r["shard"]) for r in rows)
    assert shown(got) == shown(again)
    monkeypatch.setattr(sharding, "BROADCAST_PIECES", 0)
    assert shown(sharding.shard(every, 7, tolerance=1e-9, piece_bytes=9000).collect()) == shown(got)


def test_histogram_counts_are_exact():
    r = np.random.default_rng(2)
    k1, k2 = r.integers(0, 4, 500).astype(np.uint64), r.integers(0, 2**60, 500).astype(np.uint64)
    probes = sorted({int(a) << 64 | int(b) for a, b in zip(r.integers(0, 5, 40), r.integers(0, 2**60, 40))})
    keys = [int(a) << 64 | int(b) for a, b in zip(k1, k2)]
    assert sharding.bins(k1, k2, probes).tolist() == [sum(p <= k for p in probes) for k in keys]


# --- 10: tokens


def test_tokens(spark, docs, rows):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tk = Tokenizer.from_file(path)
    odd = ["Straße ñandú ÿ ßa, é́ x", "İstanbul ſ don't I'LL 3,14 <|endoftext|> <|ENDOFTEXT|>x", "a b c\x1cd\x85e", "日本語 ́a", "ǘ: á. é,", "'s l's."]
    more = spark.createDataFrame([(5000 + i, t, None, None, None, None) for i, t in enumerate(odd)], SCHEMA)
    store = token_store.write_tokens(docs.union(more), path)
    got = token_store.read_documents(spark, store).collect()
    every = [(r[0], r[1]) for r in rows] + [(5000 + i, t) for i, t in enumerate(odd)]
    want = sorted((-1 if i is None else i, tk.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in every)
    got = sorted(got, key=lambda r: r["start"])
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["ids"]) for r in got) == want
    assert [r["start"] for r in got] == np.append(0, np.cumsum([r["n_tokens"] for r in got]))[:-1].tolist()
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert ids == sorted(ids)
    digests = {r["doc_id"]: r["ids_crc32"] for r in token_store.read_documents(spark, store, digest="crc32").collect()}
    assert digests[1003] == zlib.crc32(np.array(dict(want)[1003], "<u4").tobytes())
    empty = token_store.write_tokens(docs.where("false"), path)
    assert token_store.read_documents(spark, empty).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_any_tokenizer_of_the_library(spark, name, tmp_path):
    import json

    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    texts = ["Hello World again, don't stop  now", " \t two  spaces\n", "<|endoftext|> a<|EndOfText|>b", "Ñandú ÉL İ ſ 3.14 it's IT'S", "", "x" * 3000, "[NEW] word [new]"]
    spec = json.load(open(P.path(name)))
    spec["added_tokens"].append({"id": spec["added_tokens"][-1]["id"] + 1, "content": "[NEW]", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True})
    with open(tmp_path / "added.json", "w") as f:
        json.dump(spec, f)
    for path in (P.path(name), str(tmp_path / "added.json")):
        tk = Tokenizer.from_file(path)
        got = token_store.Encoder(path)
        assert got.by_piece == (name == "word_bpe_49k.json")
        assert [x.tolist() for x in got.encode(texts, 2)] == [tk.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r["ids"] for r in token_store.read_documents(spark, token_store.write_tokens(frame, path)).collect()}
    assert out == {i: tk.encode(t, add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}


def test_tokens_of_one_id_many_times(spark, monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(token_store, "RANGE_BYTES", 20_000)
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 != 0, F.lit(7)).alias("doc_id"), F.concat(F.lit("texto "), F.col("id") % 4).alias("text"), F.lit("x").alias("h"), F.lit("y").alias("frame"))
    store = token_store.write_tokens(rows, P.path("word_bpe_49k.json"))
    out = token_store.read_documents(spark, store).select("doc_id", "start", "n_tokens", "ids").orderBy("start").collect()
    assert len(out) == 20_000 and spark.read.parquet(f"{store}/manifest").count() > 2
    assert [r["doc_id"] for r in out] == [None] * 6667 + [7] * 13_333
    assert [r["start"] for r in out] == np.append(0, np.cumsum([r["n_tokens"] for r in out]))[:-1].tolist()
    again = token_store.read_documents(spark, token_store.write_tokens(rows.repartition(7), P.path("word_bpe_49k.json"))).orderBy("start").collect()
    assert [r["ids"] for r in again] == [r["ids"] for r in out]


def test_pieces_are_words_without_case_and_stops():
    """One word in capitals, with accents and before stops is one piece, so it is encoded once."""
    P = pytest.importorskip("public_tokenizers")
    enc = token_store.Encoder(P.path("word_bpe_49k.json"))
    out = enc.encode(["Être être, ÊTRE. être;", None, "", " \t", "être"], 2)
    assert set(enc.pieces) == {"être".encode(), b",", b".", b";"}
    assert [len(x) for x in out[1:4]] == [1, 1, 1] and enc.encode([], 2) == [] and [x.tolist() for x in enc.encode([None], 2)] == [[2]]


def test_cut_pieces_against_the_library(monkeypatch):
    """Letters before marks (a capital may not compose where the small letter does), stops in odd places, few pieces kept."""
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tk, r = Tokenizer.from_file(path), np.random.default_rng(10)
    parts = [*"aZéÉßÿÞ÷×ªĀıİſΣς日1٣_*-'<|>,.!?;: \t\n\x0b\x1c\x85\xa0\u2028", "\u0301", "\u0331", "\u0308", "\u1dc0", "\u0345", "\u037e", "\u212a", "\u200d", "'s", "'LL", "don't", "the", "THE", "<|endoftext|>", "<|EndOfText|>", "😀"]
    texts = ["H\u0331 T\u0308, W\u030a. Y\u030a J\u030c;", "H\u1dc0\u0331x", "É\u0331 É\u0323", "a,\u0301b é.\u0331", "x,'s y.'LL", "É", "E\u0301,", "ÿ.Ÿ"]
    texts += ["".join(parts[i] for i in r.integers(0, len(parts), n)) for n in r.integers(0, 30, 3000)]
    want = [tk.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    enc = token_store.Encoder(path)
    assert [t for t, x, w in zip(texts, enc.encode(texts, 2), want) if x.tolist() != w] == []
    monkeypatch.setattr(token_store, "MOST_PIECES", 50)
    monkeypatch.setattr(token_store, "KEPT_PIECES", 20)
    for a in range(0, len(texts), 500):
        got = enc.encode(pa.array(["", *texts])[1:][a : a + 500], 2)
        assert [x.tolist() for x in got] == want[a : a + 500]


def test_more_pieces_than_are_kept():
    """At the real limits: the pieces of most uses stay, all others are learnt again."""
    P = pytest.importorskip("public_tokenizers")
    enc = token_store.Encoder(P.path("word_bpe_49k.json"))
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(letters[i // 26**k % 26] for k in range(5)) for i in range(token_store.MOST_PIECES + 1000)]
    enc.encode([" ".join(words[:-1000]), " ".join(words[:500])], 2)
    enc.encode([" ".join(words[-1000:])], 2)
    assert len(enc.pieces) > token_store.MOST_PIECES
    some = [" ".join(words[a : a + 100]) for a in (0, 400, 150_000, 350_000, len(words) - 100)]
    want = [e.ids + [2] for e in enc.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
    assert [x.tolist() for x in enc.encode(some, 2)] == want
    assert token_store.KEPT_PIECES <= len(enc.pieces) <= token_store.KEPT_PIECES + 500 and {w.encode() for w in words[:500]} <= set(enc.pieces)


def test_tokens_refuse_another_dictionary(spark, docs):
    P = pytest.importorskip("public_tokenizers")
    store = token_store.write_tokens(docs.limit(5), P.path("word_bpe_49k.json"))
    files, root = token_store.open_fs(store)
    with files.open_output_stream(f"{root}/dictionary.zdict") as f:
        f.write(b"other")
    with pytest.raises(Exception):
        token_store.read_documents(spark, store).collect()


# --- the pipeline


def test_pipeline_stages(spark, tmp_path, docs):
    import corpus_pipeline

    _, labels = labelled(spark)
    bench = spark.createDataFrame([(1, docs.where("doc_id = 9").first()["text"]), (2, None)], "item_id long, text string")
    for name, frame in (("documents", docs), ("labels", labels.where("false")), ("benchmark", bench)):
        frame.write.parquet(f"{tmp_path}/{name}.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        now = Scratch(spark, "t").save(stage(spark, now, str(tmp_path)), name)
        seen[name] = now
    assert [n for n, _ in corpus_pipeline.STAGES] == list(seen) and seen["mixing"].columns == docs.columns
    kept = {r["doc_id"] for r in fast_minhash.near_duplicates(docs, k=5).where("kept").collect()}
    assert {r["doc_id"] for r in seen["near_duplicates"].collect()} == kept
    assert seen["near_duplicates"].where("doc_id = 7").count() <= 1
    assert 9 in kept and seen["decontamination"].where("doc_id = 9").count() == 0
    assert seen["decontamination"].count() == seen["near_duplicates"].count() - 1
    assert seen["sharding"].count() == seen["mixing"].count() == corpus_pipeline.run(spark, str(tmp_path)).count()


def test_repeated_ids_keep_the_same_row(spark):
    import corpus_pipeline

    r = random.Random(21)
    words_ = [" ".join(f"w{r.randrange(900)}" for _ in range(30)) for _ in range(8)]
    rows = [(1, w, "en", "s1", i, "x") for i, w in enumerate(words_)] + [(2, "a b c d e f g", "en", "s1", 1, "x"), (None, "a", None, None, None, None), (None, "a", None, None, None, None)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("kept", "n", "h", "row", "__h")})
    seen = set()
    for n in (1, 3, 7):
        out = corpus_pipeline.near_duplicates(spark, frame.repartition(n), "").orderBy("doc_id", "text").collect()
        seen.add(tuple((x["doc_id"], x["text"]) for x in out))
    assert len(seen) == 1 and [x[0] for x in seen.pop()] == [None, None, 1, 2]


def test_every_stage_with_odd_rows_and_empty_tables(spark, tmp_path, docs):
    """Nulls in any column, repeats and clashing names pass each stage; kept rows are those of a plain reading."""
    import corpus_pipeline

    _, labels = labelled(spark)
    bench = spark.createDataFrame([(1, docs.where("doc_id = 9").first()["text"]), (None, None), (3, "")], "item_id long, text string")
    for name, frame in (("labels", labels), ("benchmark", bench)):
        frame.write.parquet(f"{tmp_path}/{name}.parquet")
    odd = docs.union(docs.where("doc_id IS NULL OR doc_id = 1000")).withColumns({c: F.lit("z") for c in ("keep", "leaks", "size", "copies", "shard", "target")})
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in stages.items():
        out = stage(spark, odd, str(tmp_path))
        if name != "sharding":
            assert sorted(out.columns) == sorted(odd.columns), name
        n = out.count()
        assert stage(spark, odd.where("false"), str(tmp_path)).count() == 0, name
        if name == "decontamination":
            assert {r["doc_id"] for r in odd.collect()} - {r["doc_id"] for r in out.collect()} == {9}
        elif name == "mixing":
            assert n == sum(r["copies"] for r in mixing.copies(odd).collect())
        elif name == "sharding":
            assert n == odd.count() and {r["shard"] for r in out.collect()} == {*map(int, range(40))} & {r["shard"] for r in out.collect()}
        elif name == "quality":
            kept = cotrain.score(odd, cotrain.fit(odd, labels)).where("keep")
            assert n == kept.count() and {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in kept.collect()}
        else:
            comp = {i: c for i, (_, c) in brute_components([(r["doc_id"], r["text"]) for r in odd.collect() if r["doc_id"] is not None], 5).items()}
            assert sorted(r["doc_id"] for r in out.collect() if r["doc_id"] is not None) == sorted(i for i, c in comp.items() if i == c)
            assert out.where("doc_id IS NULL").count() == odd.where("doc_id IS NULL").count()

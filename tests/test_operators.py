"""Operators without a SQL form: fuzzy names, HTML candidates, streams."""

import random
import time
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from plazamill.operators import fuzzy
from plazamill.sources import html
from plazamill.streaming import state


def test_fuzzy_match_finds_what_brute_force_finds(spark):
    r = random.Random(4)
    words = ["servicio", "salud", "municipalidad", "hospital", "norte", "regional", "direccion", "central", "obras", "aguas"]
    catalog = [(i, " ".join(r.sample(words, 4))) for i in range(60)]
    names = []
    for i, (_, n) in enumerate(catalog[:40]):
        t = list(n)
        for _ in range(i % 4):
            t[r.randrange(len(t))] = r.choice("aeiou")
        names.append((i, "".join(t).upper()))
    names += [(98, None), (99, ""), (100, "nada parecido")]
    out = fuzzy.best_match(spark.createDataFrame(names, "id int, nombre string"), spark.createDataFrame(catalog, "k long, n string"), "nombre", "k", "n").collect()
    got = {x["id"]: (x["match_id"], x["match_ratio"]) for x in out}
    assert len(out) == len(names)
    for i, n in names:
        scored = [(SequenceMatcher(None, (n or "").lower(), c).ratio(), -k) for k, c in catalog]
        best = max(scored)
        if best[0] >= 0.88:
            assert got[i][0] is not None and abs(got[i][1] - best[0]) < 1e-9
        else:
            assert got[i] == (None, None)


def test_fuzzy_match_survives_edits_of_all_rare_trigrams(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("bcdfgklmnprst") + r.choice("aeio") for _ in range(5))
    catalog = [(i, f"municipalidad de {word()}") for i in range(120)] + [(200, "municipalidad de blediranno"), (201, "abcd"), (202, "aaaaaaaaaaaaaaaaaa")]
    names = [(900, "municipalidad de blekikaono"), (901, "abcde"), (902, "aaaaaaaabaaaaaaaaa"), (903, "zz")]
    for i, n in catalog[:100]:
        t = list(n)
        for p in r.sample(range(17, len(n)), 3):
            t[p] = r.choice("aeiobcdf")
        names.append((i, "".join(t)))
    out = fuzzy.best_match(spark.createDataFrame(names, "id int, nombre string"), spark.createDataFrame(catalog, "k long, n string"), "nombre", "k", "n").collect()
    got = {x["id"]: (x["match_id"], x["match_ratio"]) for x in out}
    assert len(out) == len(names)
    for i, n in names:
        best, k = max((SequenceMatcher(None, n, c).ratio(), -k) for k, c in catalog)
        assert got[i] == ((-k, best) if best >= 0.88 else (None, None))


def test_html_candidates(spark):
    page = """<html><script type="application/ld+json">{"@graph": [{"@type": "JobPosting", "title": "Analista", "url": "/a"}]}</script><style>h1{}</style>
    <h1>Concurso <b>público</b></h1><table><tr><td>Cargo</td><td><a href="/x">Ver</a></td></tr></table><a href="/x">Ver de nuevo</a><a href="/y">Otro</a>"""
    rows = [(1, page), (2, None), (3, ""), (4, "<a href='z'>sin cerrar <tr>"), (5, "<script type='application/ld+json'>{mal</script>")]
    got = {(r["page_id"], r["kind"], r["title"], r["url"]) for r in html.candidates(spark.createDataFrame(rows, "page_id long, html string")).collect()}
    assert got == {(1, "jsonld", "Analista", "/a"), (1, "heading", "Concurso público", None), (1, "link", "Ver", "/x"), (1, "row", "Cargo Ver", None), (1, "link", "Otro", "/y")}


def files(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


EVENT = "k string, ts timestamp, n long"


def test_streams_agree_with_batch(spark, tmp_path):
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    rows = [(f"k{i % 5}", t0 + timedelta(minutes=3 * i), i) for i in range(200)]
    files(spark, tmp_path / "in", rows, EVENT)

    def run(make, name, mode="complete"):
        q = make(spark.readStream.schema(EVENT).parquet(str(tmp_path / "in"))).writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    batch = spark.read.parquet(str(tmp_path / "in"))
    want = batch.groupBy(F.window("ts", "1 day").alias("w"), "k").count().select("w.start", "k", "count")
    assert sorted(map(tuple, run(lambda s: state.counts(s, "ts", "k"), "t_counts").collect())) == sorted(map(tuple, want.collect()))
    assert run(lambda s: state.first_seen(s, "k", "ts", "30 days"), "t_first", "append").count() == 5
    hot = run(lambda s: state.failures(s, "ts", "k", size="1 hour", limit=4), "t_fail").collect()
    assert hot and all(r["fallos"] >= 4 for r in hot)


def test_stream_merges_into_state(spark, tmp_path):
    source, kept, seen = tmp_path / "in", tmp_path / "state", []
    for part in ([("a", 1), ("b", 2)], [("b", 3), ("c", None)]):
        files(spark, source, part, "k string, n long")
        time.sleep(1)
    stream = spark.readStream.schema("k string, n long").option("maxFilesPerTrigger", 1).parquet(str(source))
    q = state.merged_into(stream, str(kept), "k", ["n"], str(tmp_path / "cp"), after=lambda snap, epoch: seen.append(snap.count()))
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(f"{kept}/v2").collect())) == [("a", 1), ("b", 3), ("c", None)] and seen == [2, 2]

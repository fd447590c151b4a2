"""Divergence audit, importance resampling and robust rules against brute force and SQL, with the defined odd cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plazamill.llm import divergence, queries, resampling, robust_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, Term string, `key` string, score string"
SF = "/root/testdata/sf0.001"


def corpus():
    r = random.Random(4)
    vocabulary = ["".join(r.choice("abcdeéñßio") for _ in range(r.randint(1, 5))) for _ in range(120)]
    rows = []
    for i in range(160):
        own = vocabulary[i % 5 * 10 :]
        text = r.choice([" ", "\n", ". ", "-"]).join(r.choice(own).capitalize() if r.random() < 0.1 else r.choice(own) for _ in range(r.randint(0, 90)))
        rows.append((i, text, r.choice(["en", "es", None]), f"s{i % 5}" if i % 11 else None, 1, "t", "k", "z"))
    rows += [(500, None, None, None, None, None, None, None), (501, "", "en", "empty", 0, "", "", ""), (502, " \t\n;;", "xx", "s1", 1, "", "", ""), (503, "uno", "xx", "s2", 1, "", "", "")]
    rows += [(None, rows[3][1], "en", "s1", 1, "", "", ""), rows[7], rows[7], (504, " ".join(r.choice(vocabulary) for _ in range(20_000)), "en", "s9", 1, "", "", "")]
    rows += [(505, "x" * 300_000 + " y", "en", "s9", 1, "", "", ""), (506, "a.b.c " * 30, "es", "s2", 1, "", "", ""), (507, "a.b.c " * 30, "es", "s2", 1, "", "", "")]
    return rows


ROWS = corpus()
ITEMS = [(1, "abc éa Bad ñ12 oi", "x"), (2, None, "x"), (3, "", "x"), (4, "ea io ab ab ab", "x")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(4).cache()


def plain_audit(rows, least):
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    counts, holds = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, *_ in rows:
        found = term.findall((text or "").translate(lower))
        counts[lang or "", source or ""].update(found)
        holds[lang or ""].update(set(found))
    kept = {lang: {t for t, n in c.items() if n >= least} for lang, c in holds.items()}

    def shares(lang, c):
        total = sum(c[t] for t in kept[lang])
        return {t: 1 + math.floor(Fraction(10**9 * (c[t] + 5), total + 5 * len(kept[lang]))) for t in kept[lang]}

    p = {g: shares(g[0], c) for g, c in counts.items()}
    out = set()
    for lang, source in counts:
        usual = shares(lang, sum((c for g, c in counts.items() if g[0] == lang), Counter()))
        mine = p[lang, source]
        pairs = [(-sum(abs(mine[t] - q[t]) for t in mine), other) for (l, other), q in p.items() if l == lang and other != source]
        terms = [(usual[t] - mine[t], t) for t in mine if counts[lang, source][t] and mine[t] > usual[t]]
        for part, found in (("pair", pairs), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:50])):
            out |= {(lang, source, part, item, -v, k) for k, (v, item) in enumerate(sorted(found, key=lambda x: (x[0], x[1].encode())), 1)}
    return out


@pytest.mark.parametrize("sizes", [{}, {"block_bytes": 120, "chunk_rows": 60, "width": 2}])
def test_divergence_is_the_plain_rule(docs, sizes):
    out = divergence.audit(docs, least_docs=6, **sizes)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == plain_audit(ROWS, 6)
    assert {g[2] for g in got} == {"pair", "term"} and ("xx", "s1", "pair", "s2", 0, 1) in got


def test_divergence_of_nothing(spark, docs):
    assert divergence.audit(docs.limit(0)).count() == 0
    alone = divergence.audit(spark.createDataFrame([("a b", None, None)], "text string, lang string, source string"), least_docs=1)
    assert alone.count() == 0


def plain_features(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain_draw(rows, items, percent=5):
    source, target = Counter(), Counter()
    for r in rows:
        source.update(plain_features(r[1])[1])
    for r in items:
        target.update(plain_features(r[1])[1])
    s, t = sum(source.values()), sum(target.values())
    gain = {b: math.floor(1000 * math.log((target[b] + 1.0) * (s + 10_000.0) / ((source[b] + 1.0) * (t + 10_000.0)))) for b in source}
    out = []
    for doc_id, text, *_ in rows:
        n, found = plain_features(text)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        out.append([doc_id, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], -1 if r[0] is None else r[0]))
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        r[5] = k
    return sorted((tuple(r) for r in out), key=str)


@pytest.mark.parametrize("percent", [5, 60, 100])
def test_resampling_is_the_plain_rule(spark, docs, percent):
    target = spark.createDataFrame(ITEMS, "item_id long, text string, score string")
    out = resampling.draw(docs, target, percent=percent)
    assert sorted((tuple(r) for r in out.collect()), key=str) == plain_draw(ROWS, ITEMS, percent)


def test_offsets_over_many_levels(spark):
    r = random.Random(3)
    scores = [r.randrange(-(10**9), 10**9) for _ in range(500)] + [7] * 400 + [r.randrange(100) for _ in range(300)]
    frame = spark.createDataFrame([(s,) for s in scores], "score long")
    got = {x["score"]: x["above"] for x in resampling.offsets(frame, max(scores), min(scores)).collect()}
    assert got == {s: sum(y > s for y in scores) for s in set(scores)}


def test_resampling_of_nothing(spark, docs):
    target = spark.createDataFrame(ITEMS, "item_id long, text string, score string")
    assert resampling.draw(docs.limit(0), target).count() == 0
    none = resampling.draw(docs.where("doc_id = 506"), target.limit(0)).collect()
    assert [r["rank"] for r in none] == [None]


def test_crc_of_long_words():
    texts = ["ab " + "é" * 500 + " z" * 3, "", None, "x" * 47 + " " + "y" * 48 + " " + "w" * 49]
    doc, found, n = resampling.features(pa.array(texts))
    assert n.tolist() == [5, 0, 0, 3]
    for i, t in enumerate(texts):
        assert sorted(found[doc == i].tolist()) == sorted(plain_features(t)[1])


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_importance_resampling"])
def test_registered_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, out = con.sql(queries.SQL[name]), queries.QUERIES[name](spark, SF)
    assert sorted(out.columns) == sorted(want.columns)
    assert sorted(map(str, (tuple(r) for r in out.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))


def plain_statistics(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            again += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), again, len(covered)]


def odd_texts():
    r = random.Random(8)
    say = lambda n: " ".join(r.choice(["casa", "río", "sol", "mar#", "ñandú", "de", "la"]) for _ in range(n))
    return [None, "", "\n\n", "a\na\n a\na \nb\r\na\r\n", say(4), say(5), say(400), "x y z w v " * 3, (say(9) + "\n") * 3 + say(5), "### $$$ | <b>\n\n### $$$ | <b>", "é" * 70_000, say(20_000), " \x0b\x0c\nq\n", "fin\nfin"]


def test_statistics_are_the_plain_ones(docs):
    texts = odd_texts() + [r[1] for r in ROWS]
    got = np.stack(robust_rules.statistics(pa.array(texts)), 1).tolist()
    assert got == [plain_statistics(t) for t in texts]


def plain_judge(rows, cut=robust_rules.CUT):
    """(id, statistics, base_failed, kept) with the concentration steps over whole groups in plain numpy."""
    R = robust_rules
    stats = [plain_statistics(r[1]) for r in rows]
    failed = [s[0] < 10 or 100 * s[4] > 20 * s[0] for s in stats]
    x = [np.round(np.array([math.log((s[1] + 100) / (s[0] + 20)), *(math.sqrt(v / (s[0] + 20)) for v in s[2:])]) * R.ONE) for s in stats]
    own = Counter((r[2], r[3]) for r, f in zip(rows, failed) if not f)
    by_lang = Counter()
    for (lang, _), n in own.items():
        by_lang[lang] += n * (n < R.LEAST_ROWS)

    def key(r):
        n = own.get((r[2], r[3]), 0)
        return None if not n else (r[2], r[3]) if n >= R.LEAST_ROWS else (r[2],) if by_lang[r[2]] >= R.LEAST_ROWS else ()

    groups = defaultdict(list)
    for i, r in enumerate(rows):
        if not failed[i]:
            groups[key(r)].append(i)
    far = {}
    for k, at in groups.items():
        if len(at) < R.LEAST_ROWS:
            continue
        part = np.array([x[i] for i in at])
        assert len(at) <= R.SAMPLE  # so the sample is the group, in whatever order
        mean, cov = R.start(part / R.ONE)
        for _ in range(R.STEPS):
            bins = np.floor(np.log2(1 + R.squared(part / R.ONE, mean, cov)) * R.BINS)
            limit = np.sort(bins)[int(len(bins) * R.SHARE)]
            inner = part[bins <= limit] / R.ONE
            mean, cov = inner.mean(0), np.cov(inner.T, bias=True) / R.consistency() + np.diag(R.FLOOR)
        far |= dict(zip(at, R.squared(part / R.ONE, mean, cov)))
    return [(r[0], *s, f, not f and far.get(i, 0) <= cut) for i, (r, s, f) in enumerate(zip(rows, stats, failed))]


def planted():
    r = random.Random(6)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(500)]
    rows = []
    for i in range(300):
        t = [r.choice(words) + ("," if r.random() < 0.1 else "") for _ in range(r.randint(30, 300))]
        lang, source = ("en", "big") if i < 130 else ("en", f"s{i % 7}") if i < 220 else (None, None) if i < 290 else ("fr", "few")
        if i % 13 == 5:
            t = [w + "###" for w in t]
        elif i % 13 == 7:
            t = [w * 6 for w in t]
        rows.append((i, " ".join(t), lang, source, 1, "", "", ""))
    return rows + [(900, None, "en", "big", 1, "", "", ""), (901, "a b", "en", "none", 1, "", "", ""), (902, words[0], "zz", None, 1, "", "", "")] + [rows[3], rows[5]]


def test_robust_rules_against_plain_numpy(spark):
    rows = planted()
    out = robust_rules.judge(spark.createDataFrame(rows, SCHEMA).repartition(5))
    got = sorted(map(str, (tuple(r) for r in out.select("doc_id", *robust_rules.COUNTS, "base_failed", "kept").collect())))
    mine = [(r[0], *plain_statistics(r[1])) for r in rows]
    assert [x.rsplit(", ", 2)[0] for x in got] == sorted(str(m)[:-1] for m in mine)
    verdict = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in out.collect()}
    want = {r[0]: tuple(r[-2:]) for r in plain_judge(rows)}
    assert verdict == want
    for i in range(290):
        if i % 13 in (5, 7):
            assert verdict[i] == (False, False)
        else:
            assert verdict[i] == (False, True)


def test_concentration_step_does_not_raise_the_determinant(spark):
    rows = spark.createDataFrame(planted(), SCHEMA)
    points = robust_rules.measured(rows).where("NOT base_failed").withColumn("key", F.lit("one")).select("*", *robust_rules.vector()).cache()
    known, last = robust_rules.sample_starts(points), math.inf
    for _ in range(3):
        known = robust_rules.concentrated(points, known).cache()
        r = known.first()
        inverse = np.array([[r[f"a{min(i, j)}{max(i, j)}"] for j in range(4)] for i in range(4)])
        assert 1 / np.linalg.det(inverse) <= last * 1.02  # bins are whole: a bin's width of slack
        last = 1 / np.linalg.det(inverse)


def test_robust_rules_of_nothing(spark, docs):
    assert robust_rules.judge(docs.limit(0)).count() == 0
    alone = robust_rules.judge(docs.where("doc_id IN (500, 504)")).collect()
    assert {r["doc_id"]: (r["base_failed"], r["kept"]) for r in alone} == {500: (True, False), 504: (False, True)}

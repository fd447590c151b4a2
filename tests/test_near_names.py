"""Names that differ by a letter or two, against all pairs; containment against all pairs."""

import random
import time
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from plazamill.operators import catalog as C
from plazamill.operators import fuzzy


def edited(rng, name):
    for _ in range(rng.randint(0, 4)):
        at, kind = rng.randrange(len(name) + 1), rng.randrange(3)
        name = name[:at] + rng.choice(["", "x", "e"])[: kind > 0] + name[at + (kind < 2) :]
    return name


@pytest.mark.parametrize("threshold", [0.8, 0.88, 0.95])
def test_best_match_equals_all_pairs(spark, threshold):
    rng = random.Random(7)
    syllables = ["ca", "le", "ra", "mu", "ni", "os"]
    catalog = [(i, "".join(rng.choice(syllables) for _ in range(rng.randint(1, 9)))) for i in range(120)] + [(200 + i, f"cliente#{i:05d}") for i in range(60)] + [(300, ""), (301, "q")]
    names = [(i, edited(rng, rng.choice(catalog)[1])) for i in range(300)] + [(400, "klient#00012"), (401, ""), (402, None), (403, "qq")]
    out = fuzzy.best_match(spark.createDataFrame(names, "id int, nombre string"), spark.createDataFrame(catalog, "k int, b string"), "nombre", "k", "b", threshold).collect()
    for r in out:
        a = r["nombre"] or ""
        best = max(((SequenceMatcher(None, a, b).ratio() if a != b else 1.0), -k) for k, b in catalog)
        want = (-best[1], round(best[0], 9)) if best[0] >= threshold else (None, None)
        assert (r["match_id"], r["match_ratio"] and round(r["match_ratio"], 9)) == want, a
    assert len(out) == len(names)


def test_numbered_names_meet_few_of_their_kind(spark):
    """All trigrams of such names are frequent: only what is left of a name without a letter is rare."""
    catalog = spark.range(20_000).select("id", F.format_string("Customer#%09d", "id").alias("b"))
    names = catalog.select("id", F.regexp_replace("b", "Customer", "Custumer").alias("nombre"))
    began = time.time()
    out = fuzzy.best_match(names, catalog.withColumnRenamed("id", "k"), "nombre", "k", "b")
    assert out.where("match_id = id").count() == 20_000
    assert time.time() - began < 90


def test_contained_equals_all_pairs(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abñ ") for _ in range(rng.randint(0, 14))) for _ in range(150)] + ["", None, "ab", "abab"]
    keys = ["".join(rng.choice("abñ ") for _ in range(rng.randint(1, 6))) for _ in range(80)] + ["", None, "ab", "aba", "aba"]
    out = C.contained(spark.createDataFrame([(t,) for t in texts], "t string"), spark.createDataFrame([(k,) for k in keys], "k string")).collect()
    assert sorted(map(tuple, out)) == sorted({(t, k) for t in texts if t for k in keys if k and len(k) >= 3 and k in t})


def test_cascade_of_numbered_names(spark):
    """Such names share all their parts; none of their joins may take a side for small by the size of its file."""
    catalog = spark.range(20_000).select("id", F.format_string("Customer#%09d", "id").alias("b"))
    kinds = F.when(F.col("id") % 3 == 0, F.concat(F.lit("zz"), "b")).when(F.col("id") % 3 == 1, F.regexp_replace("b", "Customer", "Custumer")).otherwise(F.upper("b"))
    began = time.time()
    out = C.name_cascade(catalog.select("id", kinds.alias("nombre")), catalog.withColumnRenamed("id", "k"), "nombre", "k", "b")
    plan = out._jdf.queryExecution().executedPlan().toString().split("\n")
    assert all("[length(a#" in line for line in plan if "BroadcastHashJoin" in line)  # of one row a length
    assert {(r["stage"], r["n"]) for r in out.where("match_id = id").groupBy("stage").agg(F.count("*").alias("n")).collect()} == {("contained", 6667), ("close", 6667), ("exact", 6666)}
    assert time.time() - began < 90

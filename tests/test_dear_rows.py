"""Expressions that cost much a row: each part is worked out once, and rows of one file keep all cores busy."""

import re
import time

import pytest
from pyspark.sql import functions as F

from plazamill import registry
from plazamill.functions import lookups as L
from plazamill.functions import sections as S
from plazamill.functions import titles as TT
from plazamill.functions.context import matches
from plazamill.operators import page_rules as PR

from .test_queries import SF



def test_short_title_reads_the_start_only(spark):
    docs = spark.createDataFrame([(i, "Palabras largas del texto " + "a. " * 30_000) for i in range(8)], "id int, text string")
    began = time.time()
    out = docs.select(TT.short_title(F.col("text")).alias("t")).collect()
    assert {r["t"] for r in out} == {"Palabras largas del texto a"}
    assert time.time() - began < 30


@pytest.mark.parametrize("text, title", [
    ("a" * 100 + "; " + "b" * 50, "a" * 100), ("a" * 119 + ", b", "a" * 119), ("a" * 120 + ", b", "a" * 90 + "…"), ("w " * 40 + "x" * 38 + ". y", "w " * 40 + "x" * 38), ("c" * 119 + ".", "c" * 119), ("c" * 119 + ".d", "c" * 90 + "…"),
])
def test_short_title_at_the_edge(spark, text, title):
    assert spark.range(1).select(TT.short_title(F.lit(text)).alias("t")).first()["t"] == title


def test_mails_of_a_long_list(spark):
    text = " ".join(f"postular a uno{i}@correo.cl o consultas a dos{i}@correo.cl" for i in range(400)) + " y postular a uno1@correo.cl"
    docs = spark.createDataFrame([(i, text) for i in range(12)], "id int, text string")
    began = time.time()
    rows = docs.select(S.mails(F.col("text")).alias("m")).collect()
    assert time.time() - began < 60
    for r in rows:
        assert [a["address"] for a in r["m"]["addresses"]] == [f"{n}{i}@correo.cl" for i in range(400) for n in ("uno", "dos")]
        assert r["m"]["channel"] == "postulacion_mixta" and r["m"]["asks"]


def test_matches_know_their_places(spark):
    texts = ["", None, "ab", "xxabxab", "ñab😀ab", "ab" * 500]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", matches(F.col("t"), "ab").alias("m")).collect()
    assert {r["t"]: [(x["value"], x["start"]) for x in r["m"]] for r in rows} == {t: [("ab", m.start()) for m in re.finditer("ab", t or "")] for t in texts}


def test_rows_of_one_file_are_spread(spark):
    out = registry.QUERIES["l11_mails"](spark, SF)
    assert out.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("pattern, texts", [
    ("noticias?", ["noticia"]), ("a{0,2}bc", ["bc"]), ("\\bfondos? concursables?\\b", [" concursable"]), ("x+y", ["x"]), ("sala\\-de\\.p", ["sala-de.p"]), ("ab|c(de)?f", ["ab", "c"]), ("a|[bc]", None), ("(?i)abc", None),
    ("(a(b|c)[)]d)?efg", ["efg"]), ("concurso (?:de )?cuentos?", ["concurso "]),
])
def test_literals_of_a_pattern(pattern, texts):
    assert L.literals(pattern) == texts


def test_rules_hold_where_their_patterns_do(spark):
    rules = PR.positive_rules() + PR.negative_rules()
    words = [w for r in rules for w in (L.literals(r[1]) or [])]
    texts = [f"{a} {b} del {c}" for a, b, c in zip(words, words[7:] + words[:7], words[31:] + words[:31])] + ["", "resultados del concurso", "enviar a uno@correo.cl", "concurso  publico", "renta y cargo", "cargo x renta y cierre", "bases"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    out = rows.select("t", F.array(*[L.fits(F.col("t"), r[1]) for r in rules]).alias("a"), F.array(*[F.col("t").rlike(r[1]) for r in rules]).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in out) and sum(map(sum, (r["a"] for r in out))) > 200


def test_pages_of_one_file_are_spread(spark):
    out = registry.QUERIES["v12_page_pipeline"](spark, SF)
    assert out.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_simple_sites_parse_a_page_once_a_shape(spark):
    plan = registry.QUERIES["x26_simple_sites"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"ArrowEvalPython \[_trees", plan)) == 2
    assert len(re.findall(r"RepartitionByExpression \[page_id", plan)) == 2


def test_evaluated_pages_are_spread(spark):
    plan = registry.QUERIES["v20_source_evaluation"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"RepartitionByExpression \[page_id", plan)) == 1

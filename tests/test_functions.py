"""Boundary cases of scalar functions, rules and merges."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from plazamill.context import Clock
from plazamill.functions import dates, money, text
from plazamill.operators import merge, offers, rules

CLOCK = Clock(date(2024, 3, 10), datetime(2024, 3, 10, 9, 0))


def one(spark, column, **values):
    kinds = {"str": "string", "int": "long", "date": "date", "bool": "boolean", "NoneType": "string"}
    schema = ", ".join(f"{k} {kinds[type(v).__name__]}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(
    "raw,want",
    [
        ("http://WWW.Sitio.cl/a/b/?utm_source=x&b=2&a=1#top", "http://sitio.cl/a/b?a=1&b=2"),
        ("https://sitio.cl", "https://sitio.cl/"),
        ("https://sitio.cl/?a=", "https://sitio.cl/"),
        (None, None),
    ],
)
def test_canonical_url(spark, raw, want):
    assert one(spark, text.canonical_url(F.col("u")), u=raw) == want


@pytest.mark.parametrize(
    "raw,want",
    [
        ("cierra 31/02/2024 o 2024-03-05", date(2024, 3, 5)),
        ("el 5 de Marzo de 2024", date(2024, 3, 5)),
        ("el 5 de brumario de 2024", None),
        ("1.2.2024 y 03-04-2025", date(2025, 4, 3)),
        ("", None),
        (None, None),
    ],
)
def test_first_date(spark, raw, want):
    assert one(spark, dates.first_date(F.col("t")), t=raw) == want


@pytest.mark.parametrize(
    "low,high,context,want",
    [
        (249_999, None, "", (None, None, "renta_descarte_monto_irrelevante")),
        (250_000, None, "", (250_000, 250_000, None)),
        (100_000, 900_000, "", (900_000, 900_000, None)),
        (900_000, 300_000, "", (300_000, 900_000, None)),
        (9_999_999, None, "", (9_999_999, 9_999_999, None)),
        (10_000_000, None, "", (None, None, "renta_no_confiable_sin_contexto")),
        (10_000_000, None, "Remuneración", (10_000_000, 10_000_000, None)),
        (15_000_000, None, "sueldo", (None, None, "renta_descarte_monto_inverosimil")),
    ],
)
def test_assessed_pay(spark, low, high, context, want):
    rows = spark.createDataFrame([(low, high, context)], "low long, high long, c string")
    assert tuple(rows.select(money.assessed(F.col("low"), F.col("high"), F.col("c")).alias("p")).first()["p"]) == want


@pytest.mark.parametrize("age,want", [(90, (False, False)), (91, (False, True)), (180, (False, True)), (181, (True, False)), (365, (True, False)), (366, (True, False))])
def test_vigency_by_age(spark, age, want):
    published = date.fromordinal(CLOCK.today.toordinal() - age)
    v = one(spark, rules.vigency(F.col("p"), F.lit(None).cast("date"), CLOCK.day), p=published)
    assert (v["discard"], v["review"]) == want


def test_status_order(spark):
    rows = [
        (1, False, "", None, None, None), (2, True, "CERRADA", None, None, None), (3, True, None, date(2024, 3, 11), None, date(2024, 3, 1)), (4, True, None, None, None, date(2024, 3, 9)),
        (5, True, None, None, None, date(2024, 3, 10)), (6, None, None, None, None, None),
    ]
    frame = spark.createDataFrame(rows, "id int, activa boolean, estado string, fecha_inicio date, fecha_publicacion date, fecha_cierre date")
    got = {r["id"]: r["s"] for r in frame.select("id", offers.status(CLOCK).alias("s")).collect()}
    assert got == {1: "closed", 2: "closed", 3: "upcoming", 4: "closed", 5: "closing_today", 6: "active"}


def test_upsert_twice_is_the_same(spark):
    state = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, x string, n int")
    delta = spark.createDataFrame([(2, "", 3), (3, "c", None), (3, "d", None)], "id int, x string, n int")
    once = merge.upsert(state, delta, "id", ["x", "n"], "if_not_empty").drop("es_insert", "es_update")
    twice = merge.upsert(once, delta, "id", ["x", "n"], "if_not_empty").drop("es_insert", "es_update")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [(1, "a", 1), (2, "b", 3), (3, "c", None)]
    assert merge.history(once, merge.upsert(once, once, "id", ["x", "n"]), "id", ["x", "n"]).count() == 0


def test_close_missing_without_seen_changes_nothing(spark):
    state = spark.createDataFrame([(1, True, None), (2, True, None)], "id int, activa boolean, cerrada_en timestamp")
    none = state.where("id < 0").select("id")
    assert [r["activa"] for r in merge.close_missing(state, none, "id", CLOCK.instant).collect()] == [True, True]
    assert sorted((r["id"], r["activa"]) for r in merge.close_missing(state, state.where("id = 1").select("id"), "id", CLOCK.instant).collect()) == [(1, True), (2, False)]


def test_year_inference(spark):
    f = lambda d, m: one(spark, dates.with_year(F.lit(d), F.lit(m), CLOCK.day))
    assert f(15, 3) == date(2024, 3, 15) and f(1, 3) == date(2025, 3, 1) and f(29, 2) == date(2024, 2, 29) and f(31, 2) is None

"""Sections of a notice: functions, requirements, documents, mail addresses, amounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as TB
from .context import around, first_seen, let, matches
from .lookups import contains_any, count_of

#: Heads of sections.
FUNCTIONS = "funciones(?:\\s+del\\s+cargo)?|principales funciones|objetivo del cargo|prop[óo]sito del cargo|descripci[óo]n del cargo|responsabilidades"
REQUIRED, DESIRABLE = "requisitos(?: del cargo)?|requisitos exigibles", "requisitos deseables|deseable|plus"
DOCUMENTS = "cv|certificad|t[ií]tulo|anexo|declaraci[oó]n jurada|c[eé]dula"
HEADER = "^[A-ZÁÉÍÓÚ].{0,40}:$"
ADDRESS = "(?i)\\b[a-z0-9._%+\\-]+@[a-z0-9.\\-]+\\.[a-z]{2,}\\b"
AMOUNT = "(?i)(?:\\$|clp|pesos?)\\s*[0-9.,]{4,}"
PLAIN_AMOUNT = "\\$?\\s*[0-9]{1,3}(?:[.,][0-9]{3})+"
#: Words near an amount that is no pay, in blog posts.
NO_PAY = ("presupuesto", "monto total", "convenio", "proyecto", "anual", "global")
BULLET = "^[ \\-*\\t]+|[ \\-*\\t]+$"


def _lines(text: Column) -> Column:
    trimmed = F.transform(F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\r"), F.lit("\n")), "\n"), lambda x: F.regexp_replace(x, "^\\s+|\\s+$", ""))
    return F.filter(trimmed, lambda x: x != "")


def _wide(x: Column) -> Column:
    return F.size(F.filter(F.split(x, "\\s+"), lambda w: w != "")) >= 2


def functions(text: Column) -> Column:
    """Up to 12 lines of two words or more among the seven after a head."""

    def found(lines: Column) -> Column:
        after = F.transform(lines, lambda x, i: F.when(x.rlike(f"(?iu){FUNCTIONS}"), F.slice(lines, i + 2, F.lit(7))).otherwise(F.array().cast("array<string>")))
        return F.slice(first_seen(F.filter(F.flatten(after), _wide)), 1, 12)

    return let(F.transform(_lines(text), lambda x: F.regexp_replace(x, BULLET, "")), found)


def _section(lines: Column, pattern: str) -> Column:
    def block(window: Column) -> Column:
        stop = F.array_position(F.transform(window, lambda x: x.rlike(HEADER)), True)
        return let(stop, lambda n: F.when(n > 0, F.slice(window, F.lit(1), n.cast("int") - 1)).otherwise(window))

    after = F.transform(lines, lambda x, i: F.when(x.rlike(f"(?iu){pattern}"), let(F.slice(lines, i + 2, F.lit(10)), block)).otherwise(F.array().cast("array<string>")))
    return first_seen(F.transform(F.filter(F.flatten(after), _wide), lambda x: F.regexp_replace(x, BULLET, "")))


def requirements(text: Column) -> Column:
    """struct(required, desirable, documents), at most 12, 10 and 10 lines."""

    def found(lines: Column) -> Column:
        documents = F.filter(lines, lambda x: x.rlike(f"(?iu){DOCUMENTS}"))
        return F.struct(F.slice(_section(lines, REQUIRED), 1, 12).alias("required"), F.slice(_section(lines, DESIRABLE), 1, 10).alias("desirable"), F.slice(documents, 1, 10).alias("documents"))

    return let(_lines(text), found)


def mail_kind(context: Column) -> Column:
    """The kinds of an address by what stands around it."""

    def kind(c: Column) -> Column:
        apply, ask = contains_any(c, TB.APPLY_HINTS), contains_any(c, TB.ASK_HINTS)
        loose = F.when(F.contains(c, F.lit("postul")), "P").when(contains_any(c, ("consulta", "informaci", "contact")), "C").otherwise("I")
        return let(F.struct(apply.alias("apply"), ask.alias("ask")), lambda x: F.when(x["apply"] & x["ask"], "PC").when(x["apply"], "P").when(x["ask"], "C").otherwise(loose))

    return let(F.lower(context), kind)


def mails(text: Column) -> Column:
    """struct(addresses array<struct<address, kinds>>, channel, asks). Kinds of one address are merged; P: for
    applications, C: for questions, I: unclear."""
    t = F.coalesce(text, F.lit(""))
    every = F.transform(matches(t, ADDRESS), lambda m: F.struct(F.lower(m["value"]).alias("address"), mail_kind(around(t, m, 100)).alias("kinds")))

    def merged(every: Column) -> Column:
        kinds = lambda a: F.array_join(F.transform(F.filter(every, lambda m: m["address"] == a), lambda m: m["kinds"]), "")
        named = lambda k: F.concat(*[F.when(F.contains(k, F.lit(x)), x).otherwise("") for x in "PCI"])
        return F.transform(F.array_distinct(F.transform(every, lambda m: m["address"])), lambda a: F.struct(a.alias("address"), let(kinds(a), named).alias("kinds")))

    def told(x: Column) -> Column:
        channel = (
            F.when(x["p"] & x["c"], "postulacion_mixta").when(x["p"], "postulacion_por_email").when(x["low"].rlike("postular|formulario|portal de empleo|trabajando\\.cl|bne\\.cl"), "postulacion_por_portal_externo")
            .when(x["low"].rlike("presencial|oficina de partes|entrega presencial"), "postulacion_presencial").otherwise("canal_no_determinado")
        )
        return F.struct(x["addresses"].alias("addresses"), channel.alias("channel"), x["c"].alias("asks"))

    some = lambda found, k: F.exists(found, lambda m: F.contains(m["kinds"], F.lit(k)))
    return let(let(every, merged), lambda found: let(F.struct(found.alias("addresses"), some(found, "P").alias("p"), some(found, "C").alias("c"), F.lower(t).alias("low")), told))


def pay_in_context(text: Column) -> Column:
    """struct(amount, raw, confidence, status): amounts of 250 000 or more, scored by the words within 80 characters
    (3 a good one, -2 a bad one); the best by score, surplus of good words and least amount is judged."""
    t = F.coalesce(text, F.lit(""))

    def judged(m: Column) -> Column:
        return let(F.struct(F.lower(around(t, m, 80)).alias("near"), F.regexp_replace(m["value"], "[^0-9]", "").try_cast("long").alias("amount")), lambda x: let(
            F.struct(count_of(x["near"], TB.PAY_GOOD).alias("good"), count_of(x["near"], TB.PAY_BAD).alias("bad")),
            lambda n: F.struct((n["good"] * 3 - n["bad"] * 2).alias("score"), (n["good"] - n["bad"]).alias("surplus"), (-x["amount"]).alias("least"), m["value"].alias("raw"), n["good"].alias("good"), n["bad"].alias("bad")),
        ))

    def decided(best: Column) -> Column:
        amount = -best["least"]
        status = (
            F.when(amount >= 15_000_000, "remuneracion_descartada").when((amount >= 10_000_000) & ((best["good"] == 0) | (best["bad"] > best["good"])), "remuneracion_no_confiable")
            .when(amount >= 10_000_000, "remuneracion_sospechosa").when(best["bad"] > best["good"], "remuneracion_no_confiable")
        )

        def shown(status: Column) -> Column:
            refused = F.coalesce(status.isin("remuneracion_descartada", "remuneracion_no_confiable"), F.lit(False))
            confidence = F.when(best.isNull(), None).when(refused, "low").when(status.isNull(), "high").otherwise("medium")
            return F.struct(F.when(~refused, amount).alias("amount"), best["raw"].alias("raw"), confidence.alias("confidence"), status.alias("status"))

        return let(status, shown)

    return let(F.array_max(F.filter(F.transform(matches(t, AMOUNT), judged), lambda x: x["least"] <= -250_000)), decided)


def pay_span(text: Column) -> Column:
    """struct(low, high) of the amounts in [300 000, 15 000 000) that no other matter's words stand near (60 characters)."""
    t = F.coalesce(text, F.lit(""))
    amount = lambda m: F.regexp_replace(m["value"], "[^0-9]", "").try_cast("long")
    kept = F.filter(F.transform(F.filter(matches(t, PLAIN_AMOUNT), lambda m: ~contains_any(F.lower(around(t, m, 60)), NO_PAY)), amount), lambda n: (n >= 300_000) & (n < 15_000_000))
    return F.struct(F.array_min(kept).alias("low"), F.array_max(kept).alias("high"))

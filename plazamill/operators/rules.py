"""Decision rules as column expressions: ordered, first failure wins, with reason codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hours between two runs of a source, by tier.
TIER_HOURS = {"critical": 3, "high": 6, "medium": 12, "low": 48, "eventual": 168, "exploratory": 720}
#: Sector names (like-pattern on the folded name, in order) and their codes.
SECTORS = (
    (("%judic%",), "JUD"), (("%municip%",), "MUN"), (("%salud%",), "SAL"), (("%universidad%", "%educa%"), "EDU"), (("%gobierno%regional%",), "GOR"), (("%empresa%",), "EMP"),
    (("%ff.aa%", "%fuerza%armad%", "%orden%"), "FFA"), (("%legislat%",), "LEG"), (("%ejecut%",), "EJE"), (("%adp%", "%alta direcc%"), "ADP"), (("%auton%",), "AUT"),
)


def sector_code(folded: Column) -> Column:
    out = None
    for patterns, code in SECTORS:
        hit = folded.like(patterns[0])
        for p in patterns[1:]:
            hit = hit | folded.like(p)
        out = F.when(hit, code) if out is None else out.when(hit, code)
    return out.otherwise("OTR")


def vigency(published: Column, closes: Column, today: Column) -> Column:
    """struct(discard, reason, review): a known closing date decides, else the age of the publication."""
    age = F.datediff(today, published)
    row = lambda d, r, v: F.struct(F.lit(d).alias("discard"), F.lit(r).cast("string").alias("reason"), F.lit(v).alias("review"))
    return (
        F.when(closes < today, row(True, "fecha_cierre_vencida", False))
        .when(closes >= today, row(False, None, False))
        .when(age > 365, row(True, "publicacion_excede_365_dias", False))
        .when(age > 180, row(True, "publicacion_excede_180_dias_sin_cierre", False))
        .when(age > 90, row(False, None, True))
        .otherwise(row(False, None, False))
    )


def minimum_fields(title: Column, url: Column) -> Column:
    """The first missing field, or null."""
    t, u = F.trim(F.coalesce(title, F.lit(""))), F.trim(F.coalesce(url, F.lit("")))
    return F.when(t == "", "sin_cargo").when(u == "", "sin_url").when(F.length(t) < 5, "cargo_demasiado_corto")


def policy(blob: Column, url: Column, positives: list[str], negative_text: str, negative_url: str, internal: str) -> Column:
    """struct(score, accept, reasons) over folded text: 0.10 a positive word up to 0.75, less 0.45, 0.35, 0.60 and 0.25
    for a bad URL, bad text, an internal call and too little text.

    The signs are found once, as the one element of an array, and judged from there: used side by side they would be
    looked for again in every place that names them.
    """
    words = F.array(*[F.lit(p) for p in dict.fromkeys(positives)])
    hits = F.size(F.filter(words, lambda w: F.contains(blob, w)))
    found = F.array(F.struct(hits.alias("hits"), url.rlike(negative_url).alias("url"), blob.rlike(negative_text).alias("text"), blob.rlike(internal).alias("inside"), (F.length(blob) < 8).alias("short")))

    def judged(x: Column) -> Column:
        score = F.least(F.lit(0.75), x["hits"] * 0.1) - x["url"].cast("int") * 0.45 - x["text"].cast("int") * 0.35 - x["inside"].cast("int") * 0.6 - x["short"].cast("int") * 0.25
        accept = (F.round(score, 4) >= 0.2) & (x["hits"] > 0) & ~x["inside"]
        reasons = F.array_compact(
            F.array(
                F.when(x["hits"] > 0, "positive_signals_detected"), F.when(x["url"], "negative_url_pattern"), F.when(x["text"], "negative_text_pattern"), F.when(x["inside"], "internal_only_signal"),
                F.when(x["short"], "insufficient_text"), F.when(accept, "policy_accept").otherwise("policy_reject"),
            )
        )
        return F.struct(F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score)), 4).alias("score"), accept.alias("accept"), reasons.alias("reasons"))

    return F.get(F.transform(found, judged), 0)


def cooldown_hours(tier: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in TIER_HOURS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(tier))), F.lit(TIER_HOURS["medium"]))


def due(tier: Column, last: Column, now: Column) -> Column:
    """Hours count to the microsecond: an evaluation that is a split second short of its cooldown isn't due."""
    hours = (F.unix_micros(now) - F.unix_micros(last.cast("timestamp"))) / 3_600_000_000
    return last.isNull() | (hours >= cooldown_hours(tier))


def quality(checks: list[tuple[Column, str, float]], reject: list[str], review: list[str]) -> Column:
    """struct(decision, primary, reasons, score): every failed check adds its reason and penalty; the first reason
    alone decides, and review needs a score of 0.35."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(r).alias("reason"), F.lit(p).alias("penalty"))) for c, r, p in checks]))
    score = F.round(F.aggregate(found, F.lit(1.0), lambda a, x: a - x["penalty"]), 4)
    primary = F.get(found, 0)["reason"]
    decision = F.when(primary.isin(*reject), "reject").when(primary.isin(*review), F.when(score >= 0.35, "review").otherwise("reject")).otherwise("publish")
    return F.struct(decision.alias("decision"), primary.alias("primary"), F.array_join(F.transform(found, lambda x: x["reason"]), ",").alias("reasons"), F.greatest(F.lit(0.0), score).alias("score"))

"""Decisions about sources: status, tier, cooldown, thresholds, routing, validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import due

#: Smallest sample, good and poor precision and recall, and the shift of thresholds, by family.
FAMILIES = {
    "generic": (12, 0.8, 0.75, 0.55, 0.5, 0.05),
    "pdf_first_waf": (20, 0.85, 0.7, 0.6, 0.5, 0.05),
    "waf_protected": (20, 0.84, 0.68, 0.62, 0.48, 0.04),
    "wordpress": (16, 0.86, 0.74, 0.58, 0.5, 0.04),
    "external_ats": (16, 0.83, 0.72, 0.57, 0.52, 0.03),
    "trusted_portal": (10, 0.88, 0.78, 0.6, 0.52, 0.03),
}
COLUMNS = ("family", "floor", "good_precision", "good_recall", "poor_precision", "poor_recall", "delta")
#: Timeout, retries, pause, candidate URLs, PDFs, browser, by tier.
TIER_PROFILES = {
    "critical": (20, 3, 0.3, 10, True, True), "high": (15, 2, 0.5, 6, True, True), "medium": (12, 2, 1.0, 4, True, False), "low": (8, 1, 1.5, 3, False, False), "eventual": (6, 1, 2.0, 2, False, False),
    "exploratory": (10, 2, 2.0, 7, True, False),
}


def thresholds(rows: DataFrame) -> DataFrame:
    """rows: family, extract_threshold, manual_threshold, sample, precision, recall. Adds what history makes of the
    thresholds; an unknown family or too small a sample changes nothing. The family table has six rows."""
    table = rows.sparkSession.createDataFrame([(k, *v) for k, v in FAMILIES.items()], list(COLUMNS))
    j = rows.join(F.broadcast(table), "family", "left")
    c = F.col
    enough = F.coalesce(c("sample") >= c("floor"), F.lit(False))
    good = (c("precision") >= c("good_precision")) & (c("recall") >= c("good_recall"))
    poor = (c("precision") <= c("poor_precision")) | (c("recall") <= c("poor_recall"))
    shift = F.when(enough & good, -c("delta")).when(enough & poor, c("delta")).otherwise(0.0)
    band = F.when(c("floor").isNull(), "unknown").when(~enough, "insufficient_sample").when(good, "high_precision_recall").when(poor, "low_precision_or_recall").otherwise("stable")
    extract = F.when(enough, F.least(F.lit(0.95), F.greatest(F.lit(0.55), F.round(c("extract_threshold") + shift, 4)))).otherwise(c("extract_threshold"))
    j = j.withColumn("band", band).withColumn("shift", shift).withColumn("extract_applied", extract)
    manual = F.when(enough, F.least(c("extract_applied") - 0.05, F.greatest(F.lit(0.35), F.round(c("manual_threshold") + c("shift"), 4)))).otherwise(c("manual_threshold"))
    return j.withColumn("manual_applied", F.round(manual, 4)).drop(*COLUMNS[1:], "shift")


def tier(status: Column, kind: Column, sector: Column, central: Column, override: Column) -> Column:
    default = (
        F.when(status != "active", "exploratory").when(kind == "empleos_publicos", "critical").when(F.contains(F.lower(F.coalesce(sector, F.lit(""))), F.lit("municip")), "low")
        .when(kind.isin("custom_trabajando", "custom_hiringroom", "custom_buk"), "high").when(kind.isin("generic", "wordpress") & central, "low").otherwise("medium")
    )
    given = F.lower(F.trim(override))
    return F.when(given.isin(*TIER_PROFILES), given).otherwise(default)


def cooldown(institution: Column, known: Column, policy: Column, last: Column, zeros: Column, bypass_used: Column, now: Column) -> Column:
    """struct(reevaluate, reason): seven outcomes."""
    row = lambda b, r: F.struct(F.lit(b).alias("reevaluate"), F.lit(r).alias("reason"))
    return (
        F.when(institution.isNull(), row(True, "sin_institucion_id")).when(~known, row(True, "sin_historial")).when(due(policy, last, now), row(True, "cooldown_vencido"))
        .when((zeros > 3) & ~bypass_used, row(True, "cooldown_bypass_one_time_zero_threshold")).when(F.lower(F.coalesce(policy, F.lit(""))).isin("critical", "high"), row(True, "cooldown_light_recheck_high_priority"))
        .when(zeros > 0, row(True, "cooldown_light_recheck_zero_streak")).otherwise(row(False, "cooldown"))
    )


def intake(minimum: Column, policy_ok: Column, vigency: Column, pay_reason: Column, body_short: Column) -> Column:
    """struct(discard, reason, review): the first failure decides; pay that can't be believed and short bodies ask for review."""
    reason = F.coalesce(minimum, F.when(~policy_ok, "politica_rechaza"), F.when(vigency["discard"], vigency["reason"]))
    review = F.array_join(F.array_compact(F.array(F.when(vigency["review"], "publicacion_antigua"), pay_reason, F.when(body_short, "texto_insuficiente"))), ",")
    return F.struct(reason.isNotNull().alias("discard"), reason.alias("reason"), F.when(reason.isNull(), review).otherwise("").alias("review"))

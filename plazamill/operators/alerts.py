"""Alerts: of the operations view, by counters against fixed thresholds; of subscribers, by what they ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .catalog import contained


def alerts(expired: Column, broken: Column, review: Column, hours: Column, failing: Column) -> Column:
    """struct(level, alerts): alerts are "level:action" in a fixed order; without counts there are none."""
    rules = ((expired > 0, "warning", "bulk-desactivar"), (broken > 50, "warning", "revalidar-urls"), (review > 0, "info", "revision"), (hours > 26, "error", "scraper-runs"), (failing > 10, "warning", "evaluaciones"))
    any_at = lambda level: F.greatest(*[F.coalesce(c, F.lit(False)) for c, l, _ in rules if l == level], F.lit(False))
    found = F.array_compact(F.array(*[F.when(c, f"{level}:{action}") for c, level, action in rules]))
    return F.struct(F.when(any_at("error"), "error").when(any_at("warning"), "warning").otherwise("ok").alias("level"), found.alias("alerts"))


def matches(subscriptions: DataFrame, offers: DataFrame, criteria: dict[str, list[str]], order: list[Column], most: int = 20) -> DataFrame:
    """(sub_id, offer_id, pos): of each active subscription the first `most` offers that meet all its criteria.

    criteria: a subscription column and the offer columns of which one must contain its text, in any case; a null or
    empty criterion asks nothing. Texts are compared once per distinct pair: the distinct wanted texts meet the distinct
    texts of the offers through their trigrams (catalog.contained), all else is equi joins. Offers are ranked per
    distinct combination of criteria, so subscriptions that want the same share the work.
    """
    wants = list(criteria)
    folded = lambda c: F.lower(F.coalesce(c.cast("string"), F.lit("")))
    subs = subscriptions.select("sub_id", *[F.trim(folded(F.col(w))).alias(w) for w in wants])
    combos = subs.select(wants).distinct()
    hits = offers
    for w, columns in criteria.items():
        wanted = combos.select(F.col(w).alias("k")).where("k <> ''").distinct()
        texts = offers.select(F.explode(F.array(*[folded(F.col(c)) for c in columns])).alias("t")).distinct()
        pairs = contained(texts, wanted).union(brief(texts, wanted))
        own = hits.select(*hits.columns, F.explode(F.array_distinct(F.array(F.lit(None).cast("string"), *[folded(F.col(c)) for c in columns]))).alias("__t"))
        asked = own.join(pairs, own["__t"] == pairs["t"], "left").where(F.col("__t").isNull() | F.col("k").isNotNull())
        hits = asked.select(*hits.columns, F.coalesce("k", F.lit("")).alias(f"__{w}")).distinct()
    met = hits.join(combos, [hits[f"__{w}"] == combos[w] for w in wants])
    ranked = met.withColumn("pos", F.row_number().over(Window.partitionBy(*wants).orderBy(*order))).where(F.col("pos") <= most).select(*wants, "offer_id", "pos")
    return subs.join(ranked, wants).select("sub_id", "offer_id", "pos")


def brief(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Pairs for wanted texts of one or two letters: the texts' own pieces of that length meet them."""
    pieces = texts.select("t", F.explode(F.array_distinct(F.concat(*[F.transform(F.sequence(F.lit(1), F.greatest(F.length("t"), F.lit(1))), _piece(n)) for n in (1, 2)]))).alias("p"))
    return pieces.join(wanted.where(F.length("k") < 3), F.col("p") == F.col("k")).select("t", "k").distinct()


def _piece(n: int):
    return lambda i: F.substring(F.col("t"), i, F.lit(n))

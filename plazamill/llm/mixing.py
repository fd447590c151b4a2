"""Mixing sources to target weights.

Tokens are totalled per source (map-side partial sums, one row per source), a capped water level turns weights
into targets, and each document is emitted floor(rate) times plus one hash-seeded Bernoulli copy whose
probability is the fraction of the rate. Only built-in expressions run; nothing is collected but a count.

Every coin is a slice of md5(document id), so reruns agree. A plain coin leaves a source off its target by the
spread of its document sizes; therefore ``seeds`` independent coin sets are totalled in one aggregation and each
source uses the set that lands nearest its target (ties: the smallest number).

Defined cases: null text has size 0; null source is a source of its own, last in order; null ids share a coin;
rows that repeat an id share its coin; no words at all gives rate 0; very long texts count by all their words; an empty
table gives an empty table. Input
columns named like the outputs (size, source_size, target, copies) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, without

WORDS = r"[^\x20\x09-\x0D]+"
#: One row per source is broadcast up to this many sources; above, the join is salted.
BROADCAST_SOURCES = 20_000
SALTS = 32


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def coin(number: int, doc_id: Column) -> Column:
    """Uniform in [0, 1): 32 bits of md5("set:doc_id"); four numbers share a digest."""
    digest = F.md5(F.concat(F.lit(f"{number // 4}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1 + 8 * (number % 4), 8), 16, 10).cast("long") / F.lit(4294967296.0)


def targets(totals: DataFrame, weights=(1, 2, 3), cap: int = 3) -> DataFrame:
    """Source totals (source, source_size) with their targets and rates; one row per source, so one task suffices.

    target = min(cap * size, level * weight), the level such that targets share all sizes: with sources ordered by
    cap / weight, the level is that of the first source which stays at or below its own cap.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    by_cap = Window.orderBy((F.col("most") / F.col("weight")), F.col("source").isNull(), F.col("source"))
    before, after = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        totals.withColumn("weight", weight.cast("long"))
        .withColumn("most", F.col("source_size") * cap)
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(after))
        .withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), F.col("level")))).over(everything)["level"])
        .withColumn("target", F.least(F.col("most").cast("double"), F.col("level") * F.col("weight")))
        .withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        .select("source", "source_size", "target", F.floor("rate").alias("whole"), (F.col("rate") - F.floor("rate")).alias("part"))
    )


def with_source_row(rows: DataFrame, per_source: DataFrame, n_sources: int, source: Column) -> DataFrame:
    """Joins one row per source. A hot source never meets in one task: broadcast while small, salted beyond."""
    side = per_source.withColumnsRenamed({c: f"__mix_{c}" for c in ("source", "whole", "part", "seed")})
    if n_sources <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(side), source.eqNullSafe(F.col("__mix_source")), "left").drop("__mix_source")
    side = side.withColumn("__mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("__mix_key", F.pmod(F.xxhash64(*rows.columns[:2]), F.lit(SALTS)).cast("int"))
    on = source.eqNullSafe(F.col("__mix_source")) & (F.col("__mix_key") == F.col("__mix_salt"))
    return salted.join(side, on, "left").drop("__mix_source", "__mix_salt", "__mix_key")


def copies(docs: DataFrame, weights=(1, 2, 3), cap: int = 3, seeds: int = 16) -> DataFrame:
    """Each input row once, with size, source_size, target and the number of copies that the mix takes."""
    scratch = Scratch(docs.sparkSession, "mix")
    docs = without(docs, "size", "source_size", "target", "copies")
    slim = scratch.save(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    per_source = scratch.save(targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap), "targets")
    n_sources = per_source.count()
    joined = with_source_row(slim, per_source, n_sources, F.col("source"))
    sums = joined.groupBy("source").agg(
        F.first("target").alias("target"),
        *[F.sum(F.col("size") * (F.col("__mix_whole") + (coin(k, F.col("doc_id")) < F.col("__mix_part")).cast("long"))).alias(f"t{k}") for k in range(seeds)],
    )
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"t{k}") - F.col("target")).alias("off"), F.lit(k).alias("k")) for k in range(seeds)]))["k"]
    chosen = sums.select(F.col("source").alias("__source"), best.alias("seed"))
    per_source = scratch.save(per_source.join(F.broadcast(chosen) if n_sources <= BROADCAST_SOURCES else chosen, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source"), "chosen")
    scratch.drop("sizes"), scratch.drop("targets")
    out = with_source_row(docs.withColumn("size", n_words(F.col("text"))), per_source, n_sources, F.col("source"))
    flip = F.coalesce(*[F.when(F.col("__mix_seed") == k, coin(k, F.col("doc_id"))) for k in range(seeds)])
    return out.withColumn("copies", (F.col("__mix_whole") + (flip < F.col("__mix_part")).cast("long")).cast("int")).drop("__mix_whole", "__mix_part", "__mix_seed")


def mix(docs: DataFrame, weights=(1, 2, 3), cap: int = 3, seeds: int = 16) -> DataFrame:
    """The mixed corpus: the columns of the input, each row as often as the mix takes it."""
    taken = copies(docs, weights, cap, seeds).where("copies > 0")
    return taken.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col(f"`{c}`") for c in docs.columns if c in taken.columns])

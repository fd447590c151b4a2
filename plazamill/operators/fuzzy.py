"""Fuzzy name matching against a catalog.

The score is the matching-blocks ratio, 2 * M / T; it can't reach a threshold where 2 * min(len) / (sum of lengths) or
the shared letters stay below it, so those pairs are never scored. Names equal after folding are joined directly. The
rest first meets the catalog names that are equal to it once a letter at most is left out on either side: a join on
hashes of what is left, whose work grows with the names, not with their pairs. Any other pair leaves two letters or more
of one side unmatched, so M <= min(la, lb, max(la, lb) - 2); a name whose best ratio is above what that allows for any
length in the catalog is done. Only the others meet the catalog names of their length range and edit distance with one
of their rare trigrams in common. Pairs are scored in Python, one Arrow batch at a time.

A match of ratio t between names of la and lb letters leaves ua and ub letters unmatched, ua (2 - t) + ub t <=
2 (1 - t) la. An unmatched letter of the name breaks at most 3 of its trigrams, one that the catalog name has in
between at most 2, so of any `broken` + 1 trigrams of the name one stands in the catalog name. Names with fewer
trigrams meet all catalog names of their length range.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from plazamill.functions.text import normal

FEW = 2000


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def trigrams(c):
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3))))


def shortened(c):
    """Hashes of a name and of what is left of it without any one letter."""
    less = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.xxhash64(F.concat(F.substring(c, F.lit(1), i - 1), F.substr(c, i + 1))))
    return F.array_distinct(F.concat(F.array(F.xxhash64(c)), F.when(F.length(c) > 0, less).otherwise(F.array().cast("array<bigint>"))))


def broken(length, t):
    """Trigrams of a name of this length that a match of ratio t or more can break, at most."""
    return F.floor(2 * (1 - t) * length * F.greatest(3 / (2 - t), 2 / t) + 1e-6)


def best_match(names: DataFrame, catalog: DataFrame, name: str, key: str, catalog_name: str, threshold: float = 0.88, rarest: int = 6) -> DataFrame:
    """names with key and ratio of the best catalog row at or above the threshold (ties: least key), else nulls.

    Distinct names only are matched. Of names that a letter left out on either side doesn't settle the first pass scores
    what shares one of the `rarest` trigrams of the name, as long as those are in at most FEW catalog names; the best
    ratio found so far is the threshold of the second, which misses nothing at or above it.
    """
    own = names.select(F.col(name).alias("__raw")).distinct().withColumn("a", normal(F.col("__raw")))
    cat = catalog.select(F.col(key).alias("k"), normal(F.col(catalog_name)).alias("b")).groupBy("b").agg(F.min("k").alias("k")).hint("merge")  # files of names are too small for their size in memory
    exact = own.join(cat, F.col("a") == F.col("b")).select("__raw", "k", F.lit(1.0).alias("r"))
    unequal = own.join(cat, F.col("a") == F.col("b"), "left_anti")
    best = F.max(F.struct("r", (-F.col("k")).alias("m"))).alias("x")

    def scored(pairs):
        low, total = F.least(F.length("a"), F.length("b")), F.length("a") + F.length("b")
        near = pairs.where((2 * low >= F.col("t") * total - 1e-6) & (F.levenshtein("a", "b") <= (1 - F.col("t")) * total + 1e-6))
        return near.withColumn("r", ratio("a", "b")).where(F.col("r") >= F.col("t"))

    close = unequal.select("__raw", "a", F.explode(shortened(F.col("a"))).alias("h")).join(cat.select("k", "b", F.explode(shortened(F.col("b"))).alias("h")).hint("merge"), "h")
    close = scored(close.groupBy("__raw", "a", "k", "b").agg(F.lit(threshold).alias("t"))).groupBy(F.col("__raw").alias("__near")).agg(best).hint("merge")
    own_lengths, lengths = unequal.select(F.length("a").alias("la")).distinct(), cat.select(F.length("b").alias("lb")).distinct()
    most = F.least("la", "lb", F.greatest("la", "lb") - 2)
    unseen = own_lengths.crossJoin(lengths).groupBy("la").agg(F.max(F.when(most > 0, 2 * most / (F.col("la") + F.col("lb"))).otherwise(0.0)).alias("unseen"))  # one row for each length
    judged = unequal.join(close, F.col("__raw").eqNullSafe(F.col("__near")), "left").join(F.broadcast(unseen), F.length("a") == F.col("la"), "left")
    judged = judged.select("__raw", "a", "x", F.coalesce("x.r", F.lit(threshold)).alias("t"), (F.coalesce("unseen", F.lit(0.0)) < F.coalesce("x.r", F.lit(threshold)) - 1e-9).alias("sure"))
    settled = judged.where("sure AND x IS NOT NULL").select("__raw", (-F.col("x.m")).alias("k"), "x.r")
    rest = judged.where("NOT sure").select("__raw", "a", F.col("t").alias("known"))
    grams = cat.select("k", "b", F.explode(trigrams(F.col("b"))).alias("g")).hint("merge")
    frequency = grams.groupBy("g").agg(F.count("*").alias("n")).hint("merge")
    rare = Window.partitionBy("__raw").orderBy("n", "g")
    of_name = rest.select("__raw", "a", F.explode(trigrams(F.col("a"))).alias("g"))

    first = of_name.join(frequency, "g").withColumn("i", F.row_number().over(rare)).withColumn("sum", F.sum("n").over(rare.rowsBetween(Window.unboundedPreceding, 0)))
    first = first.where((F.col("i") <= rarest) & (F.col("sum") <= FEW)).join(grams, "g").select("__raw", "a", "k", "b").distinct()
    floor = scored(first.withColumn("t", F.lit(threshold))).groupBy(F.col("__raw").alias("__one")).agg(F.max("r").alias("t")).hint("merge")
    limits = rest.join(floor, F.col("__raw").eqNullSafe(F.col("__one")), "left").select("__raw", "a", F.greatest("known", F.coalesce("t", F.lit(threshold))).alias("t"))
    limits = limits.withColumn("most", broken(F.length("a"), F.col("t"))).withColumn("gs", trigrams(F.col("a")))
    posted = limits.where(F.size("gs") > F.col("most")).select("__raw", "a", "t", "most", F.explode("gs").alias("g")).join(frequency, "g", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    posted = posted.withColumn("i", F.row_number().over(rare)).where(F.col("i") <= F.col("most") + 1).join(grams, "g").select("__raw", "a", "t", "k", "b").distinct()
    share = F.col("t") / (2 - F.col("t"))
    short = limits.where(F.size("gs") <= F.col("most")).select("__raw", "a", "t", F.explode(F.sequence(F.ceil(F.length("a") * share - 1e-6), F.floor(F.length("a") / share + 1e-6))).alias("length"))
    short = short.join(cat.withColumn("length", F.length("b").cast("long")), "length").select("__raw", "a", "t", "k", "b")
    top = scored(posted.unionByName(short)).groupBy("__raw").agg(best).select("__raw", (-F.col("x.m")).alias("k"), "x.r")
    found = exact.unionByName(settled).unionByName(top)
    return names.join(found.hint("merge"), names[name].eqNullSafe(found["__raw"]), "left").drop("__raw").withColumnsRenamed({"k": "match_id", "r": "match_ratio"})

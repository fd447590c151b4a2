"""State maintenance: a batch of changes is joined into a state table, and every effect is a frame.

Parquet has no merge statement, so each function returns the new state; write it to a new path or by foreachBatch.
Both sides are co-partitioned by the key once; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(state: DataFrame, delta: DataFrame, key: str, columns: Iterable[str], mode: str = "overwrite") -> DataFrame:
    """The state after the delta, with es_insert (row is new) and es_update (row was there and is in the delta).

    mode: overwrite (new values as they are), if_not_null, if_not_empty (null and "" keep the old value). A key that
    a delta repeats counts once, by its first row in the order of its columns.
    """
    columns = list(columns)
    row = F.struct(*[F.col(c).alias(f"__{c}") for c in columns])
    nulls_last = F.struct(*[x for i, c in enumerate(columns) for x in (F.col(c).isNull().alias(f"n{i}"), F.col(c).alias(f"v{i}"))])
    new = delta.groupBy(F.col(key).alias("__key")).agg(F.min_by(row, nulls_last).alias("r")).select("__key", "r.*")
    both = state.join(new, F.col(key) == F.col("__key"), "full")
    isnew, touched = F.col(key).isNull(), F.col("__key").isNotNull()

    def value(c: str):
        fresh = {"overwrite": F.col(f"__{c}"), "if_not_null": F.coalesce(f"__{c}", c), "if_not_empty": F.coalesce(F.nullif(F.col(f"__{c}").cast("string"), F.lit("")).cast(state.schema[c].dataType), F.col(c))}[mode]
        return F.when(touched, fresh).otherwise(F.col(c)).alias(c)

    rest = [c for c in state.columns if c != key and c not in columns]
    return both.select(F.coalesce(key, "__key").alias(key), *[value(c) for c in columns], *rest, isnew.alias("es_insert"), (touched & ~isnew).alias("es_update"))


def snapshots(merged: DataFrame) -> DataFrame:
    """The image after each insert and update."""
    return merged.where("es_insert OR es_update").withColumn("origen", F.when(F.col("es_insert"), "INSERT").otherwise("UPDATE")).drop("es_insert", "es_update")


def history(state: DataFrame, merged: DataFrame, key: str, columns: Iterable[str]) -> DataFrame:
    """The old image of each row that really changed (null is a value like any other)."""
    after = merged.where("es_update").select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in columns])
    changed = F.lit(False)
    for c in columns:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    return state.join(after, F.col(key) == F.col("__key")).where(changed).select(*state.columns)


def close_missing(state: DataFrame, seen: DataFrame, key: str, at, keep_first: bool = False) -> DataFrame:
    """Active rows whose key wasn't seen are switched off at `at`; an empty seen set changes nothing."""
    marks = seen.select(F.col(key).alias("__key"), F.lit(True).alias("__seen")).where("__key IS NOT NULL").distinct()
    any_seen = seen.select(F.lit(1).alias("__any")).limit(1).agg((F.count("*") > 0).alias("__any"))
    joined = state.join(marks, F.col(key) == F.col("__key"), "left").crossJoin(F.broadcast(any_seen))  # one row
    gone = F.col("__any") & F.col("activa") & F.col("__seen").isNull()
    stamp = F.coalesce("cerrada_en", at) if keep_first else at
    return joined.withColumn("cerrada_en", F.when(gone, stamp).otherwise(F.col("cerrada_en"))).withColumn("activa", F.col("activa") & ~gone).select(*state.columns)


def close_expired(state: DataFrame, today, at, keep_first: bool = True) -> DataFrame:
    gone = F.col("activa") & F.coalesce(F.col("fecha_cierre") < today, F.lit(False))
    stamp = F.coalesce("cerrada_en", at) if keep_first else at
    return state.withColumn("cerrada_en", F.when(gone, stamp).otherwise(F.col("cerrada_en"))).withColumn("activa", F.col("activa") & ~gone)


def sequence_codes(rows: DataFrame, year: str, sector, order: list, counters: DataFrame | None = None, slice_=None) -> DataFrame:
    """EE-<last three digits of the year>-<sector>-<six digits>, counted on within (year, sector).

    slice_: an expression that never falls along the order (a day of its first column, say). Rows are numbered within
    (sector, slice) and shifted by the rows of the slices before, counted in a table of one row a slice, so a large
    sector is many tasks; without it a sector is one slice.
    """
    rows = rows.withColumn("__sector", sector).withColumn("__slice", F.lit(0) if slice_ is None else slice_)
    sizes = rows.groupBy(F.col("__sector").alias("__s"), F.col("__slice").alias("__l")).agg(F.count("*").alias("__size"))
    earlier = Window.partitionBy("__s").orderBy(F.asc_nulls_first("__l")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__size").over(earlier), F.lit(0))).drop("__size")
    if counters is not None:
        last = counters.where(F.col("anio") == year[-3:]).select(F.col("sector").alias("__c"), "ultimo")
        sizes = sizes.join(F.broadcast(last), F.col("__s") == F.col("__c"), "left").withColumn("__before", F.col("__before") + F.coalesce("ultimo", F.lit(0))).drop("__c", "ultimo")  # at most one row per sector code
    n = F.row_number().over(Window.partitionBy("__sector", "__slice").orderBy(*order)) + F.col("__before")
    rows = rows.join(sizes, F.col("__sector").eqNullSafe(F.col("__s")) & F.col("__slice").eqNullSafe(F.col("__l")))
    return rows.withColumn("codigo", F.concat(F.lit(f"EE-{year[-3:]}-"), F.col("__sector"), F.lit("-"), F.lpad(n.cast("string"), 6, "0"))).drop("__sector", "__slice", "__s", "__l", "__before")


def zero_streak(runs: DataFrame, key: str, order: str, extracted: str, found: str) -> DataFrame:
    """Consecutive runs that extracted and found nothing; a find resets, a run without extraction carries on."""
    w = Window.partitionBy(key).orderBy(order)
    resets = F.sum((F.col(extracted) & (F.col(found) > 0)).cast("int")).over(w)
    rows = runs.withColumn("__part", resets)
    within = Window.partitionBy(key, "__part").orderBy(order)
    return rows.withColumn("ceros", F.sum((F.col(extracted) & (F.col(found) == 0)).cast("int")).over(within)).drop("__part")

"""Streaming forms of the incremental state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from plazamill.operators import merge


def first_seen(stream: DataFrame, key: str, event_time: str, late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark: the seen-hash set of a run, with bounded state."""
    return stream.withWatermark(event_time, late).dropDuplicatesWithinWatermark([key])


def failures(stream: DataFrame, event_time: str, key: str, size: str = "10 minutes", limit: int = 5, late: str = "10 minutes") -> DataFrame:
    """Keys with `limit` failures or more in a tumbling window."""
    counts = stream.withWatermark(event_time, late).groupBy(F.window(event_time, size).alias("w"), key).agg(F.count("*").alias("fallos"))
    return counts.where(F.col("fallos") >= limit).select(F.col("w.start").alias("desde"), key, "fallos")


def counts(stream: DataFrame, event_time: str, *keys: str, size: str = "1 day", late: str = "1 day") -> DataFrame:
    return stream.withWatermark(event_time, late).groupBy(F.window(event_time, size).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("desde"), *keys, "n")


def merged_into(stream: DataFrame, state_path: str, key: str, columns: list[str], checkpoint: str, after: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Upserts each micro-batch into versioned Parquet state below state_path, with the old images of rows that really
    changed below history; a retried batch rewrites its versions. `after` gets the snapshots of the batch."""
    spark = stream.sparkSession

    def apply(batch: DataFrame, epoch: int) -> None:
        old = spark.read.parquet(f"{state_path}/v{epoch}") if epoch else batch.select(key, *columns).where("false")
        new = merge.upsert(old, batch, key, columns, "if_not_null")
        new.select(key, *columns).write.mode("overwrite").parquet(f"{state_path}/v{epoch + 1}")
        merge.history(old, new, key, columns).write.mode("overwrite").parquet(f"{state_path}/history/v{epoch + 1}")
        if after:
            after(merge.snapshots(new), epoch)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sliding_failures(stream: DataFrame, event_time: str, key: str, seconds: int = 600, limit: int = 5, late: str = "10 minutes") -> DataFrame:
    """Every failure that is the `limit`-th or a later one within the `seconds` up to it: key, cuando, fallos. Bursts across
    any edge count. Per key only the times within the last `seconds` before its newest failure are held, and they go
    when the watermark has passed them; rows without key or time are left out."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    span = seconds * 1_000_000

    def step(group, batches, state):
        name = group[0]
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"k": pd.Series([], dtype=object), "t": pd.Series([], dtype="int64"), "n": pd.Series([], dtype="int32")})
            return
        held = list(state.get[0]) if state.exists else []
        out = []
        for t in sorted(x for b in batches for x in b["t"].tolist()):
            held.append(t)
            within = sum(t - span < x <= t for x in held)
            if within >= limit:
                out.append((t, within))
        held = sorted(x for x in held if x > max(held) - span)
        state.update((held,))
        state.setTimeoutTimestamp(max(max(held) // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"k": [name] * len(out), "t": [t for t, _ in out], "n": [n for _, n in out]})

    kind = dict(stream.dtypes)[key]
    rows = stream.where(F.col(key).isNotNull() & F.col(event_time).isNotNull()).withWatermark(event_time, late)
    rows = rows.select(F.col(key).alias("k"), event_time, F.unix_micros(event_time).alias("t"))
    found = rows.groupBy("k").applyInPandasWithState(step, f"k {kind}, t long, n int", "times array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(F.col("k").alias(key), F.timestamp_micros("t").alias("cuando"), F.col("n").alias("fallos"))


# --- state that is merged when it is read


def delta_merged(stream: DataFrame, path: str, key: str, columns: list[str], checkpoint: str, buckets: int = 16, compact_every: int = 8, after: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Upserts each micro-batch (a null keeps the old value) by writing its rows only: a delta below path/delta, by version
    and bucket of the key, and the old images of its keys that really changed below path/history. Every `compact_every`
    versions the state becomes a new base and `merged_state` reads that and later deltas. A retried batch rewrites
    its own version. `after` gets the new images of the batch's keys."""
    spark = stream.sparkSession
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")

    def apply(batch: DataFrame, epoch: int) -> None:
        version = epoch + 1
        empty = batch.select(key, *columns).where("false")
        one = merge.upsert(empty, batch, key, columns, "if_not_null").select(key, *columns)
        one.select("*", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/delta/version={version:012d}")
        mine = spark.read.parquet(f"{path}/delta/version={version:012d}")
        touched = [r["bucket"] for r in mine.select("bucket").distinct().collect()]
        old = merged_state(spark, path, key, empty, version - 1, touched).join(mine.select(key), key, "left_semi")
        new = merge.upsert(old, mine.select(key, *columns), key, columns, "if_not_null")
        merge.history(old, new, key, columns).write.mode("overwrite").parquet(f"{path}/history/version={version:012d}")
        if after:
            after(new.select(key, *columns), epoch)
        if version % compact_every == 0:
            whole = merged_state(spark, path, key, empty, version)
            whole.select("*", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/base/version={version:012d}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark, path: str) -> list[int]:
    """The versions below a folder that were written to their end."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    found = [f.getPath() for f in fs.listStatus(folder)]
    return sorted(int(p.getName().split("=")[1]) for p in found if p.getName().startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def merged_state(spark, path: str, key: str, like: DataFrame, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
    """The state as of a version (null: the last): of every column the last value that is not null, over the newest base
    and the deltas after it. like: a frame with the key and the columns. Only the asked buckets are read."""
    until = [v for v in _versions(spark, f"{path}/delta") if version is None or v <= version]
    bases = [v for v in _versions(spark, f"{path}/base") if version is None or v <= version]
    base = bases[-1] if bases else 0
    parts = [(base, "base")] if base else []
    parts += [(v, "delta") for v in until if v > base]
    if not parts:
        return like.where("false")
    rows, schema = None, T.StructType([*like.schema.fields, T.StructField("bucket", T.IntegerType())])
    for v, kind in parts:
        one = spark.read.schema(schema).parquet(f"{path}/{kind}/version={v:012d}").withColumn("__v", F.lit(v))
        rows = one if rows is None else rows.unionByName(one)
    if buckets is not None:
        rows = rows.where(F.col("bucket").isin(*buckets))
    columns = [c for c in like.columns if c != key]
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("__v"))).alias(c) for c in columns]
    return rows.groupBy(key).agg(*last).select(*like.columns)


STREAK = "institucion_id long, evaluated_at timestamp, ceros int, desvio_usado boolean"


def zero_streaks(stream: DataFrame) -> DataFrame:
    """Per institution the state after its newest run: stream rows are institucion_id, evaluated_at, extracted (boolean),
    found (int), bypass (boolean: this run was let through once in spite of its zeros) and, if there is one, id (long).

    A run that extracted and found nothing adds one, a find resets, other runs carry on; the bypass can be used once and
    is given back when the count is zero. Only (count, flag, time, id) is kept per institution; runs are taken by (time,
    id) and those not after the state are left out, so a replayed row changes nothing. Runs of one time count each if
    they have ids or come in one batch. Rows without a time are left out.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    has_id = "id" in stream.columns

    def step(key, batches, state):
        count, used, last, last_id = state.get if state.exists else (0, False, -(1 << 62), -(1 << 62))
        rows = pd.concat(list(batches)).sort_values(["at", "id"], kind="stable")
        before = last
        for t, run, extracted, found, bypass in zip(rows["at"], rows["id"], rows["extracted"], rows["found"], rows["bypass"]):
            if (t, run) <= (last, last_id) if has_id else t <= before:
                continue
            last, last_id = int(t), int(run)
            if extracted:
                count = 0 if found else count + 1
            used = (used or bool(bypass)) and count > 0
        state.update((int(count), bool(used), int(last), int(last_id)))
        yield pd.DataFrame({"institucion_id": [key[0]], "evaluated_at": [rows["evaluated_at"].max()], "ceros": [count], "desvio_usado": [used]})

    timed = stream.where("evaluated_at IS NOT NULL").select("institucion_id", "evaluated_at", "extracted", "found", "bypass", F.unix_micros(F.col("evaluated_at").cast("timestamp")).alias("at"), (F.col("id").cast("long") if has_id else F.lit(0).cast("long")).alias("id"))
    return timed.groupBy("institucion_id").applyInPandasWithState(step, STREAK, "ceros int, usado boolean, ultimo long, ultimo_id long", "update", GroupStateTimeout.NoTimeout)

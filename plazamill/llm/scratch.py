"""Durable intermediate tables in the folder that the cluster shares.

Every lineage cut in this subpackage is a written Parquet table below ``spark.checkpoint.dir``: any executor
can be lost afterwards and the next stage only re-reads files. Where the setting is absent and the master is local
(tests) a temporary folder is made and set; on a cluster its absence is an error, since executors don't see each
other's disks. ``drop`` is for tables that nothing returned depends on any more.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="plazamill-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES (or one row), unless the session names a bound of its own: by rows alone a
    batch of long texts is as large as the texts are."""
    if int(spark.conf.get(_BATCH).rstrip("bB")) > 1 << 30:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


class Scratch:
    """Tables of one operator call. ``save`` writes and re-reads; ``drop`` deletes what later stages don't need."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        small_batches(spark)
        self.root = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def without(df: DataFrame, *names: str) -> DataFrame:
    """The frame without columns of these names in any case: an operator's own outputs win over extra inputs."""
    own = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in own])


def as_text(df: DataFrame, names: list[str]) -> tuple[DataFrame, list[str]]:
    """The frame, and where these columns (found in any case) stand in it as text: those of another type get a cast
    copy at the end, texts are not sent twice."""
    own = {f.name.lower(): f for f in reversed(df.schema.fields)}
    held, more = [], []
    for n, inner in zip(names, fresh(df, *[f"text_{n.lower()}" for n in names])):
        f = own[n.lower()]
        held.append(f.name if f.dataType.simpleString() == "string" else inner)
        if held[-1] == inner:
            more.append(df[f"`{f.name}`"].cast("string").alias(inner))
    return df.select("*", *more), held


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for inner columns that no column of the frame has in any case."""
    own, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in own:
            n = f"_{n}"
        own.add(n.lower())
        out.append(n)
    return out

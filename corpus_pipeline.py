"""The corpus pipeline: quality, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns a DataFrame; all but
the last return the columns of the documents. ``run`` writes each stage's result as Parquet in the shared folder and
re-reads it, so a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plazamill.llm import bloom, cotrain, decontaminate, fast_minhash, mixing, sharding
from plazamill.llm.scratch import Scratch

N_SHARDS = 40


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go.

    Null or empty texts are judged by their metadata, null metadata is a value of its own, null ids are judged like
    others; rows that repeat are judged alike; without labels of both classes nothing goes; an empty table stays empty;
    very long texts are scored whole; further columns pass unread, whatever their names.
    """
    model = cotrain.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return cotrain.score(docs, model).where("keep").select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays (5-word shingles, similarity 0.8), and one row of each repeated id: the
    least by hash of its text, then by all its columns.

    Null, empty and blank texts are linked with nothing and stay; rows with a null id all stay; very long texts are
    compared whole; an empty table stays empty; further columns pass unread, whatever their names. Rows whose id surely
    isn't among those to drop pass without an exchange; only the rest is joined.
    """
    found = Scratch(spark, "stage-near").save(fast_minhash.near_duplicates(docs, k=5, percent=80), "found")
    known = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    concerned = Scratch(spark, "stage-near").save(known.where("NOT kept OR n > 1").select("doc_id", "kept", F.xxhash64("doc_id").alias("h")), "concerned")
    field = bloom.build(concerned, "h", bloom.size_for(concerned.count()))

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        return pd.Series(bloom.has(field.value, h.to_numpy().view("uint64")))

    key = F.xxhash64(F.col("doc_id").cast("long"))
    free = docs.where(~maybe(key) | F.col("doc_id").isNull())
    gone = concerned.where("NOT kept").select(F.col("doc_id").alias("__gone"))
    held = docs.where(maybe(key) & F.col("doc_id").isNotNull()).join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = held.groupBy(F.col("doc_id").alias("__id")).agg(F.min_by(row, F.struct(F.xxhash64("text"), F.to_json(row))).alias("row"))
    return free.unionByName(one.select("row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go.

    Null and empty texts leak nothing and stay, and nothing leaks null or empty items; null ids are judged like others,
    repeated rows alike; very long texts are aligned whole; an empty table stays empty; further columns pass unread,
    whatever their names.
    """
    marked = decontaminate.with_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return marked.where(F.size("leaks") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Null text has size 0, a null source is a source of its own, null ids share a coin and so do rows that repeat an id;
    a source without words gives no rows; very long texts count by all their words; an empty table stays empty; further
    columns pass unread.
    """
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus in shards of near equal bytes: the document columns with size, shard and slot.

    Null text has 16 bytes, null ids sort first, copies of a row stand together, very long texts are one row of their size;
    an empty table gives no rows; input columns named size, shard or slot are replaced.
    """
    return sharding.shard(docs, N_SHARDS)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing_sources),
    ("sharding", shards),
]
#: Trained models and sketches have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

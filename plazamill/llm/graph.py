"""Connected components of an undirected graph of links.

Up to LOCAL_LINKS links (a few megabytes, checked by counting) one task unites them; beyond, large and small stars
alternate over exchanges until every node is tied to the least one it can reach.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

LOCAL_LINKS = 250_000


def _united(batches):
    parent: dict[int, int] = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            a, c = top(u), top(v)
            parent[max(a, c)] = min(a, c)
    ids = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([top(x) for x in ids], pa.int64())], ["id", "comp"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours above it (large) or at most it (small) are tied to the least node it knows."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    tied = both.join(least, "u")
    if large:
        return tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v")).where("u <> v"))


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """edges (u, v), both long, of a written table. Rows (id, comp) for every node that has a link; comp is the least id reachable."""
    if edges.count() <= LOCAL_LINKS:
        return edges.select("u", "v").coalesce(1).mapInArrow(_united, "id long, comp long")
    now = scratch.save(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), f"{name}-0")
    said, turn = None, 0
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == said or not state["n"]:
            return now.select(F.col("u").alias("id"), F.col("v").alias("comp")).union(now.select("v", "v").distinct())
        said, turn = state, turn + 1
        after = scratch.save(_star(_star(now, True), False).distinct(), f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}")
        now = after

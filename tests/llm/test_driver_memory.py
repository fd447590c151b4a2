"""Tables of one row a document stay off the driver once they are many."""

from pyspark.sql import functions as F

from plazamill.llm import fast_minhash


def test_many_components_are_exchanged(spark):
    frame, comps = spark.range(100).withColumnRenamed("id", "u"), spark.range(50).select("id", (F.col("id") % 7).alias("comp"))
    out = fast_minhash.labelled(frame, comps, "u", "top", False)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r["u"], r["top"]) for r in out.collect()} == {(i, i % 7 if i < 50 else i) for i in range(100)}
    assert fast_minhash.BROADCAST_IDS <= 50_000


def test_same_components_without_broadcast(spark, monkeypatch):
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(10 * g + c, " ".join(words[g : g + 30] + ([f"x{c}"] if c else []))) for g in range(0, 30, 6) for c in range(4)], "doc_id long, text string")
    found = []
    for most in (50_000, 0):
        monkeypatch.setattr(fast_minhash, "BROADCAST_IDS", most)
        found.append(sorted(map(tuple, fast_minhash.near_duplicates(docs, k=2, percent=80).collect())))
    assert found[0] == found[1] and {r[2] for r in found[0]} == {10 * g for g in range(0, 30, 6)}

"""Search over postings: stems that must all occur, and ranked search with synonyms and typing errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plazamill.functions import tables as TB
from plazamill.functions.text import normal

#: Words that search leaves out, and endings that it cuts off, longest first.
STOP = ("de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "no", "una", "su", "al", "lo", "como", "o", "e", "u")
ENDINGS = ("amientos", "imientos", "amiento", "imiento", "aciones", "adoras", "adores", "ancias", "logias", "idades", "encias", "acion", "adora", "ancia", "ciones", "mente", "antes", "idad", "logia", "encia", "ables", "ibles", "istas", "cion", "ador", "ante", "able", "ible", "ista", "osos", "osas", "ivos", "ivas", "oso", "osa", "ivo", "iva", "es", "os", "as", "s", "o", "a", "e")


def stem(word: Column) -> Column:
    """A folded word without its longest known ending, three letters at least staying. A light rule: it joins number,
    gender and the common derivations; it is not the full Snowball algorithm."""
    pattern = "^(.{3,}?)(?:" + "|".join(ENDINGS) + ")$"
    return F.when(word.rlike(pattern), F.regexp_extract(word, pattern, 1)).otherwise(word)


def stems(text: Column) -> Column:
    words = F.filter(F.split(F.regexp_replace(normal(text), "[^a-z0-9]+", " "), " "), lambda w: (w != "") & ~w.isin(*STOP))
    return F.array_distinct(F.transform(words, stem))


def full_text(text: Column, query: str) -> Column:
    """Whether every stem of the query occurs; a query of stop words alone matches nothing."""
    wanted = stems(F.lit(query))
    return (F.size(wanted) > 0) & (F.size(F.array_except(wanted, stems(text))) == 0)


def words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(normal(text), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def search(rows: DataFrame, query: str, fields: tuple[str, ...], limit: int = 10, offset: int = 0, filters: dict[str, str] | None = None) -> DataFrame:
    """rows (id and fields in order of weight) that hold every word of the query, or a synonym of the whole query: one
    typing error is forgiven from four letters on, two from eight on, and the last word may be unfinished. Ranked by
    errors, then by the weight of the fields, then by id; `rank`, `errors` and the first field with marks are added.

    Only the distinct words of the postings are compared with the query, then joined back, so the costly comparison
    sees the vocabulary, not the text.
    """
    for c, v in (filters or {}).items():
        rows = rows.where(F.col(c) == v)
    folded = lambda s: "".join(ch for ch in s.lower().translate(str.maketrans("áéíóúüñ", "aeiouun")) if ch.isalnum() or ch == " ").split()
    same = {tuple(folded(k)): v for k, v in TB.SYNONYMS.items()}
    ways = [folded(query), *[folded(s) for s in same.get(tuple(folded(query)), ())]]
    terms = [(w, i, t, len(t), i == len(ws) - 1 and w == 0, len(ws)) for w, ws in enumerate(ways) for i, t in enumerate(ws)]
    if not terms:
        return rows.select("id", F.lit(0).alias("errors"), F.lit(0).alias("rank"), F.col(fields[0]).alias("marked")).where("false")
    asked = rows.sparkSession.createDataFrame(terms, "way int, at int, term string, n int, open boolean, of int")
    posted = rows.select("id", *[words(F.col(f)).alias(f) for f in fields])
    posted = posted.select("id", F.explode(F.concat(*[F.transform(F.col(f), _tagged(k)) for k, f in enumerate(fields)])).alias("p")).select("id", "p.*").distinct()
    near = posted.select("word").distinct().join(F.broadcast(asked), _close())  # the query's few words
    near = near.withColumn("errors", F.when(F.col("open") & F.startswith("word", F.col("term")), 0).otherwise(F.levenshtein("word", "term")))
    hits = posted.join(near, "word").groupBy("id", "way", "at", "of").agg(F.min(F.struct("errors", "field")).alias("b"))
    ways_ = hits.groupBy("id", "way", "of").agg(F.count("*").alias("held"), F.sum("b.errors").alias("errors"), F.sum("b.field").alias("weight")).where("held = of")
    best = ways_.groupBy("id").agg(F.min(F.struct("errors", F.when(F.col("way") == 0, 0).otherwise(1).alias("other"), "weight")).alias("b"))
    top = best.orderBy("b.errors", "b.other", "b.weight", "id").limit(limit + offset)
    ranked = top.select("id", "b.errors", F.row_number().over(_order()).alias("rank")).where(F.col("rank") > offset)
    pattern = "(?iu)(" + "|".join(sorted({t for ws in ways for t in ws}, key=lambda t: (-len(t), t))) + ")"
    return ranked.join(rows.select("id", F.regexp_replace(fields[0], pattern, "<mark>$1</mark>").alias("marked")), "id")


def _tagged(k: int):
    return lambda w: F.struct(w.alias("word"), F.lit(k).alias("field"))


def _close() -> Column:
    allowed = F.when(F.col("n") >= 8, 2).when(F.col("n") >= 4, 1).otherwise(0)
    return (F.abs(F.length("word") - F.col("n")) <= allowed) & (F.levenshtein("word", "term") <= allowed) | (F.col("open") & F.startswith("word", F.col("term")))


def _order():
    from pyspark.sql import Window

    return Window.orderBy("b.errors", "b.other", "b.weight", "id")  # over at most limit + offset rows


def autocomplete(rows: DataFrame, query: str, limit: int = 8) -> DataFrame:
    """Suggestions: of the ranked hits each title once in any case, the first one kept."""
    hits = search(rows, query, ("cargo",), limit)
    found = hits.join(rows.select("id", "cargo", "institucion", "region"), "id")
    return found.groupBy(F.lower("cargo").alias("k")).agg(F.min_by(F.struct("cargo", "marked", "institucion", "region", "rank"), "rank").alias("r")).select("r.*")

"""Matches of a pattern with their places, and what stands around them, as arrays of structs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once: within lambdas an expression named twice is evaluated twice."""
    return F.element_at(F.transform(F.array(value), use), 1)  # get() works out the type of the whole lambda again for every value


def matches(text: Column, pattern: str) -> Column:
    """array<struct<value, start>> (start from 0): the text is cut at the matches, so the lengths of what stands before
    one add up to its place. Null text has none."""

    def placed(p: Column) -> Column:
        pieces = F.zip_with(p["found"], F.slice(p["between"], F.lit(1), F.size(p["found"])), lambda x, gap: F.struct(x.alias("value"), F.length(gap).alias("gap"), F.length(x).alias("own")))
        none = F.struct(F.array().cast("array<struct<value: string, start: int>>").alias("done"), F.lit(0).alias("at"))
        step = lambda a, x: F.struct(F.concat(a["done"], F.array(F.struct(x["value"].alias("value"), (a["at"] + x["gap"]).alias("start")))).alias("done"), (a["at"] + x["gap"] + x["own"]).alias("at"))
        return F.aggregate(pieces, none, step, lambda a: a["done"])

    t = F.coalesce(text, F.lit(""))
    return let(F.struct(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("found"), F.split(t, pattern, -1).alias("between")), placed)


def around(text: Column, match: Column, radius: int) -> Column:
    """The match with up to `radius` characters on both sides."""
    low = F.greatest(match["start"] - radius, F.lit(0))
    return F.substring(text, low + 1, match["start"] + F.length(match["value"]) + radius - low)


def first_seen(items: Column) -> Column:
    """Distinct texts without regard to case, the first spelling kept."""
    none = F.array().cast("array<string>")
    return F.aggregate(items, none, lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))))

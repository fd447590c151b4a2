"""Walking JSON of any depth as a column expression over VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STRINGS = '"(?:[^"\\\\]|\\\\.)*+"'


def depth(text: Column) -> Column:
    """How deep brackets nest, those in strings left out."""
    bare = F.regexp_replace(F.regexp_replace(text, _STRINGS, ""), "[^\\[\\]{}]+", "")
    step = lambda now, c: now + F.when(c.isin("[", "{"), 1).otherwise(-1)
    at = F.aggregate(
        F.filter(F.split(bare, ""), lambda c: c != ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda a, c: F.struct(step(a["now"], c).alias("now"), F.greatest(a["most"], step(a["now"], c)).alias("most")),
    )
    return at["most"]


def _children(v: Column) -> Column:
    """The values of an object by name, or the items of a list."""
    fields = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
    items = F.try_variant_get(v, "$", "array<variant>")
    none = F.array().cast("array<variant>")
    return F.coalesce(F.transform(F.array_sort(F.transform(fields, lambda e: e["key"])), lambda k: F.get(F.filter(fields, lambda e: e["key"] == k), F.lit(0))["value"]), items, none)


def objects(text: Column) -> Column:
    """Every object of the JSON text at any depth, as VARIANT: an object before those within it, fields by name, items in
    order. Null or broken JSON has none."""
    found = lambda path, v: F.struct(path.alias("path"), v.alias("value"))
    whole = F.array(found(F.array().cast("array<int>"), F.try_parse_json(text)))

    def further(held: Column, _: Column) -> Column:
        new = F.flatten(F.transform(held["edge"], lambda x: F.transform(_children(x["value"]), lambda c, i: found(F.concat(x["path"], F.array(i)), c))))
        return F.struct(new.alias("edge"), F.concat(held["all"], new).alias("all"))

    every = F.aggregate(F.sequence(F.lit(1), F.greatest(depth(text), F.lit(1))), F.struct(whole.alias("edge"), whole.alias("all")), further)["all"]
    own = F.filter(every, lambda x: F.startswith(F.schema_of_variant(x["value"]), F.lit("OBJECT")))
    ordered = F.array_sort(own, lambda a, b: F.when(a["path"] < b["path"], -1).when(a["path"] > b["path"], 1).otherwise(0))
    return F.coalesce(F.transform(ordered, lambda x: x["value"]), F.array().cast("array<variant>"))


def value(v: Column, name: str) -> Column:
    """A field as text: strings and numbers as they stand, objects and lists as JSON; null without it."""
    return F.try_variant_get(v, f"$.{name}" if name.isidentifier() else f"$['{name}']", "string")


def _is_object(v: Column) -> Column:
    return F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))


def graph_objects(text: Column) -> Column:
    """The objects of linked data: the object itself, or those of a list, each with those of its @graph; nothing deeper."""
    whole = F.try_parse_json(text)
    roots = F.filter(F.coalesce(F.try_variant_get(whole, "$", "array<variant>"), F.array(whole)), _is_object)
    graph = lambda v: F.filter(F.coalesce(F.try_variant_get(v, "$['@graph']", "array<variant>"), F.array().cast("array<variant>")), _is_object)
    return F.coalesce(F.flatten(F.transform(roots, lambda v: F.concat(F.array(v), graph(v)))), F.array().cast("array<variant>"))

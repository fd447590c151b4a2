"""Dates in text as column expressions; an impossible date is null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_accents

#: Fixed values.
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")
#: Order decides: the first pattern whose first match is a date wins, wherever it stands.
PATTERNS = (
    ("(?<![0-9A-Za-z_])([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})(?![0-9A-Za-z_])", (1, 2, 3)),
    ("(?<![0-9A-Za-z_])([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})(?![0-9A-Za-z_])", (3, 2, 1)),
    ("(?<![0-9A-Za-z_])([0-9]{1,2})-([0-9]{1,2})-([0-9]{4})(?![0-9A-Za-z_])", (3, 2, 1)),
    ("(?<![0-9A-Za-z_])([0-9]{1,2})\\.([0-9]{1,2})\\.([0-9]{4})(?![0-9A-Za-z_])", (3, 2, 1)),
)
SPANISH = "(?i)(?<![0-9A-Za-z_])([0-9]{1,2})\\s+de\\s+([a-záéíóúñ]+)\\s+de\\s+([0-9]{4})(?![0-9A-Za-z_])"


def day_of(y: Column, m: Column, d: Column) -> Column:
    """A date from text parts; null if there is none."""
    return F.try_to_date(F.concat_ws("-", y, m, d), "y-M-d")


def month_number(name: Column) -> Column:
    at = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(strip_accents(name)))
    return F.nullif(at, F.lit(0))


def first_date(text: Column) -> Column:
    """Each pattern is looked for once and its match cut into parts; texts without a digit are done at once."""

    def numeric(pattern: str, groups: tuple[int, int, int]) -> Column:
        parts = F.split(F.regexp_extract(text, pattern, 0), "[-/.]")
        return day_of(*[F.get(parts, g - 1) for g in groups])

    words = F.split(F.regexp_extract(text, SPANISH, 0), "(?i)\\s+de\\s+")
    spanish = F.get(F.transform(F.array(words), lambda w: F.when(month_number(F.get(w, 1)).isNotNull(), day_of(F.get(w, 2), month_number(F.get(w, 1)).cast("string"), F.get(w, 0)))), 0)
    return F.when(text.rlike("[0-9]"), F.coalesce(*[numeric(p, g) for p, g in PATTERNS], spanish))


def all_dates(text: Column) -> Column:
    """All numeric dates, pattern by pattern."""

    def of(pattern: str, groups: tuple[int, int, int]) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: day_of(*[F.regexp_extract(x, pattern, g) for g in groups]))

    return F.array_compact(F.concat(*[of(p, g) for p, g in PATTERNS]))


def coerced(text: Column) -> Column:
    """The whole text as y-m-d, d/m/y or d-m-y."""
    t = F.trim(text)
    return F.coalesce(F.try_to_date(t, "yyyy-MM-dd"), F.try_to_date(t, "dd/MM/yyyy"), F.try_to_date(t, "dd-MM-yyyy"))


def with_year(day: Column, month: Column, today: Column) -> Column:
    """Day and month without a year: of last, this and next year the one within [-30, +365] days; the earliest
    date to come is preferred, else the latest past."""
    years = [F.year(today) + k for k in (-1, 0, 1)]
    days = F.array_compact(F.array(*[day_of(y.cast("string"), month.cast("string"), day.cast("string")) for y in years]))
    near = F.filter(days, lambda x: F.datediff(x, today).between(-30, 365))
    return F.coalesce(F.array_min(F.filter(near, lambda x: x >= today)), F.array_max(near))


def long_date(c: Column) -> Column:
    return F.concat(F.dayofmonth(c).cast("string"), F.lit(" de "), F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(c)), F.lit(" de "), F.year(c).cast("string"))


def in_force(closes: Column, published: Column, today: Column, grace: int = 0, life: int = 60) -> Column:
    return F.when(closes.isNotNull(), F.datediff(today, closes) <= grace).when(published.isNotNull(), F.datediff(today, published) <= life).otherwise(True)


def date_range(text: Column) -> Column:
    """struct(start, stop): "a - b" as written, else the first and the last d/m/y date, which may be one."""
    day = "[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{4}"
    t = F.trim(F.regexp_replace(text, "\\s+", " "))
    pair = f"({day})\\s*(?:-|–|—|a)\\s*({day})"
    found, both = F.regexp_extract_all(t, F.lit(day), F.lit(0)), t.rlike(pair)
    date = lambda c: F.try_to_date(F.replace(c, F.lit("/"), F.lit("-")), "d-M-yyyy")
    part = lambda g, i: date(F.when(both, F.regexp_extract(t, pair, g)).otherwise(F.get(found, i)))
    return F.struct(part(1, F.lit(0)).alias("start"), part(2, F.size(found) - 1).alias("stop"))


#: The months of contextual dates, folded.
MONTH_NAMES = {"enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6, "julio": 7, "agosto": 8, "septiembre": 9, "setiembre": 9, "octubre": 10, "noviembre": 11, "diciembre": 12}
#: A date in folded text, by order; the first form that occurs decides, even if it is no date.
FORMS = (("\\b([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})\\b", (1, 2, 3)), ("\\b([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})\\b", (3, 2, 1)), ("\\b([0-9]{1,2})-([0-9]{1,2})-([0-9]{4})\\b", (3, 2, 1)), ("\\b([0-9]{1,2})\\.([0-9]{1,2})\\.([0-9]{4})\\b", (3, 2, 1)))
NAMED = "\\b([0-9]{1,2})\\s+de\\s+([a-z]+)(?:\\s+de\\s+([0-9]{4}))?\\b"


def date_in(folded: Column, today: Column, future: bool) -> Column:
    """The date that folded text holds. A day and month without a year takes the year of last, this and next year that
    lies within [-30, +365] days: the earliest to come if `future`, else the nearest."""
    month = F.try_element_at(F.create_map(*[F.lit(x) for kv in MONTH_NAMES.items() for x in kv]), F.regexp_extract(folded, NAMED, 2))
    day, year = F.regexp_extract(folded, NAMED, 1), F.regexp_extract(folded, NAMED, 3)
    near = F.filter(F.array_compact(F.array(*[day_of((F.year(today) + k).cast("string"), month.cast("string"), day) for k in (-1, 0, 1)])), lambda x: F.datediff(x, today).between(-30, 365))
    nearest = F.array_min(F.transform(near, lambda x: F.struct(F.abs(F.datediff(x, today)).alias("off"), x.alias("day"))))["day"]
    inferred = F.coalesce(F.array_min(F.filter(near, lambda x: x >= today)), nearest) if future else nearest
    named = F.when(month.isNull(), None).when(year != "", day_of(year, month.cast("string"), day)).otherwise(inferred)
    out = F.when(folded.rlike(NAMED), named)
    for pattern, groups in reversed(FORMS):
        out = F.when(folded.rlike(pattern), day_of(*[F.regexp_extract(folded, pattern, g) for g in groups])).otherwise(out)
    return out


def labelled_dates(folded: Column, labels, today: Column, future: bool) -> Column:
    """array<date>: for every occurrence of every label the date within 120 characters from its start."""

    def of(label: str) -> Column:
        parts = F.split(folded, label.replace(".", "\\."), -1)
        starts = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda x, i: F.aggregate(F.slice(parts, 1, i + 1), i * len(label), lambda a, y: a + F.length(y)))
        snippets = F.transform(starts, lambda s: F.substring(folded, s + 1, F.lit(120)))  # cut first: within a lambda each use is evaluated
        return F.transform(snippets, lambda x: date_in(x, today, future))

    return F.array_compact(F.concat(*[of(x) for x in labels]))

"""Lookups in text: the longest key that a folded text contains decides."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normal

#: Region keys and names. "rm" is found inside longer words too.
REGIONS = {
    "arica": "Arica y Parinacota", "tarapaca": "Tarapacá", "antofagasta": "Antofagasta", "atacama": "Atacama", "coquimbo": "Coquimbo", "valparaiso": "Valparaíso", "metropolitana": "Metropolitana de Santiago",
    "region metropolitana": "Metropolitana de Santiago", "rm": "Metropolitana de Santiago", "ohiggins": "O'Higgins", "libertador general bernardo ohiggins": "O'Higgins", "maule": "Maule", "nuble": "Ñuble", "biobio": "Biobío",
    "bio bio": "Biobío", "araucania": "La Araucanía", "la araucania": "La Araucanía", "los rios": "Los Ríos", "los lagos": "Los Lagos", "aysen": "Aysén", "magallanes": "Magallanes",
}
#: Contract keys and kinds.
CONTRACTS = {
    "planta": "planta", "contrata": "contrata", "honorario": "honorarios", "honorarios": "honorarios", "honorarios asimilados": "honorarios", "codigo del trabajo": "codigo_trabajo", "codigo trabajo": "codigo_trabajo",
    "cod. del trabajo": "codigo_trabajo", "reemplazo": "reemplazo", "suplencia": "reemplazo",
}


def by_length(table: dict[str, str]) -> list[tuple[str, str]]:
    """Longest key first, equal lengths in the table's order."""
    return sorted(table.items(), key=lambda kv: -len(kv[0]))


def longest_key(text: Column, table: dict[str, str]) -> Column:
    folded = normal(text)
    out = F.lit(None).cast("string")
    for key, value in reversed(by_length(table)):
        out = F.when(F.contains(folded, F.lit(key)), value).otherwise(out)
    return F.when(text.isNotNull() & (text != ""), out)


def first_key(folded: Column, table, default: str | None = None) -> Column:
    out = F.lit(default).cast("string")
    for key, value in reversed(list(table)):
        out = F.when(F.contains(folded, F.lit(key)), value).otherwise(out)
    return out


def contains_any(c: Column, words) -> Column:
    """Whether c contains one of the words: one alternation, so long lists stay one compact expression."""
    return c.rlike("|".join(re.escape(w) for w in words))


def count_of(c: Column, words) -> Column:
    """How many of the words c contains."""
    return sum((F.contains(c, F.lit(w)).cast("int") for w in words), F.lit(0))


def first_group(c: Column, table, default: str | None = None) -> Column:
    """table: (words, label); the first group with a word in c gives its label."""
    out = F.lit(default).cast("string")
    for words, label in reversed(list(table)):
        out = F.when(contains_any(c, words), label).otherwise(out)
    return out


def first_word(c: Column, words) -> Column:
    """The first word of the list that c contains."""
    return F.get(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(c, w)), 0)


def literals(pattern: str) -> list[str] | None:
    """For each alternative of a pattern the longest plain text that every match of it holds; None if one has none."""
    runs, run, i, out = [], "", 0, []
    while i <= len(pattern):
        x = pattern[i : i + 1]
        plain = x if x and x not in "\\()[]{}.*+?^$|" else pattern[i + 1] if x == "\\" and not pattern[i + 1].isalnum() else ""
        if plain:
            run, i = run + plain, i + 1 + (x == "\\")
            continue
        runs.append(run[:-1] if x in ("?", "*", "{") else run)  # the letter before may be absent
        run = ""
        if x == "(" and pattern.startswith("(?", i) and not pattern.startswith("(?:", i):
            return None  # flags change what a letter stands for
        if x in ("(", "["):
            i = _closing(pattern, i)
        elif x == "{":
            i = pattern.index("}", i)
        elif x in ("|", ""):
            out.append(max(runs, key=len))
            runs = []
        i += 2 if x == "\\" else 1
    return out if all(out) else None


def _closing(pattern: str, i: int) -> int:
    """The place of the bracket that closes the one at i."""
    shut, depth, first = {"(": ")", "[": "]"}[pattern[i]], 0, i
    while True:
        if pattern[i] == "\\":
            i += 1
        elif pattern[i] == "[" and shut == ")":
            i = _closing(pattern, i)
        elif pattern[i] == pattern[first] and shut == ")":
            depth += 1
        elif pattern[i] == shut:
            depth -= 1
            if depth <= 0:
                return i
        i += 1


def fits(c: Column, pattern: str) -> Column:
    """c.rlike(pattern), asked only where c holds a text that each match needs: that is looked for among bytes, while an
    expression first makes a new string of the text."""
    texts = literals(pattern)
    if not texts:
        return c.rlike(pattern)
    some = F.contains(c, F.lit(texts[0]))
    for x in texts[1:]:
        some = some | F.contains(c, F.lit(x))
    return some if pattern == re.escape(texts[0]) else some & c.rlike(pattern)

"""Registration of queries: a frame function and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from plazamill.sources.adapters import CTE

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, cte: bool = True, dates: tuple[str, ...] = ()):
    """Registers a query. Columns named in `dates` are returned as ISO text on both sides."""

    def add(f):
        def run(spark, sf_dir):
            out = f(spark, sf_dir)
            return out.withColumns({c: F.col(c).cast("string") for c in dates}) if dates else out

        QUERIES[f.__name__] = run
        if sql:
            body = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in dates)}) FROM ({sql})" if dates else sql
            SQL[f.__name__] = f"{CTE}\n{body}" if cte else body
        return f

    return add


def lit(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def picked(key: str, values) -> str:
    """SQL that Spark and DuckDB read alike: the values dealt over a table's rows by key."""
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {lit(v)}" for i, v in enumerate(values)) + " END"


def sql_any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(w)})" for w in words) + ")"


def sql_count(x: str, words) -> str:
    return "(" + " + ".join(f"contains({x}, {lit(w)})::INT" for w in words) + ")"


def sql_first(x: str, table, default: str | None = None) -> str:
    """table: (words, label) in order."""
    return "CASE " + " ".join(f"WHEN {sql_any(x, ws)} THEN {lit(v)}" for ws, v in table) + f" ELSE {lit(default)} END"


def sql_word(x: str, words) -> str:
    """The first of the words that x contains."""
    return "CASE " + " ".join(f"WHEN contains({x}, {lit(w)}) THEN {lit(w)}" for w in words) + " END"

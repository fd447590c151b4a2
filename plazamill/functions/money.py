"""Pay in pesos."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_fold

LOW, TRUSTED, CEILING = 250_000, 10_000_000, 15_000_000
#: Words that vouch for a high amount.
CONTEXT = ("renta bruta", "remuneracion", "renta liquida", "sueldo", "honorarios mensuales", "monto mensual", "renta ofrecida", "renta mensual")


def pesos(raw: Column) -> Column:
    """Digits only, within 300 000 and 30 000 000."""
    n = F.regexp_replace(raw, "[^0-9]", "").try_cast("long")
    return F.when(n.between(300_000, 30_000_000), n)


def pay_between(text: Column) -> Column:
    """struct(low, high) of "entre X y Y", ordered; else a single amount as low."""
    pattern = "entre\\s+\\$?\\s*([0-9][0-9.,]*[0-9])\\s+y\\s+\\$?\\s*([0-9][0-9.,]*[0-9])"
    t = F.lower(text)
    a, b = pesos(F.regexp_extract(t, pattern, 1)), pesos(F.regexp_extract(t, pattern, 2))
    one = pesos(F.regexp_extract(text, "\\$\\s*([0-9][0-9.,]*[0-9])", 1))
    both = a.isNotNull() & b.isNotNull()
    return F.struct(F.when(both, F.least(a, b)).otherwise(one).alias("low"), F.when(both, F.greatest(a, b)).alias("high"))


def assessed(low: Column, high: Column, context: Column) -> Column:
    """struct(low, high, reason): a missing end is the other, a swapped pair is ordered, what can't be believed goes."""
    positive = lambda x: F.when(x > 0, x)
    lo, hi = F.coalesce(positive(low), positive(high)), F.coalesce(positive(high), positive(low))
    lo, hi = F.least(lo, hi), F.greatest(lo, hi)
    vouched = ascii_fold(context).rlike("|".join(CONTEXT))
    reason = (
        F.when(hi >= CEILING, "renta_descarte_monto_inverosimil")
        .when(hi < LOW, "renta_descarte_monto_irrelevante")
        .when((hi >= TRUSTED) & ~vouched, "renta_no_confiable_sin_contexto")
    )
    safe = lambda x: F.when(reason.isNull(), x)
    return F.struct(safe(F.when(lo < LOW, hi).otherwise(lo)).alias("low"), safe(hi).alias("high"), reason.alias("reason"))


def unit(text: Column) -> Column:
    """monthly, annual or mixed by words; they are looked for inside longer words too."""
    t = ascii_fold(text)
    month, year = t.rlike("mensual|mes"), t.rlike("anual|ano")
    return F.when(month & year, "mixed").when(month, "mensual").when(year, "anual")

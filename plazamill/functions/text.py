"""Text, key and URL functions as column expressions.

Accents are folded by a fixed map of Latin letters: Spark has no Unicode normalisation. Letters outside it stay, so
`ascii_fold` drops what is left beyond ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented Latin letters and what they fold to.
ACCENTED = "áàâãäåéèêëíìîïóòôõöúùûüñçýÿÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÑÇÝ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncyyAAAAAAEEEEIIIIOOOOOUUUUNCY"
SPACE = "[\\s ]+"
#: Query parameters that only track.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "mc_cid", "mc_eid", "_hsenc", "_hsmi")


def strip_accents(c: Column) -> Column:
    return F.translate(c, ACCENTED, PLAIN)


def clean(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE, " "))


def normal(c: Column) -> Column:
    """Lower case, no accents, single spaces; null becomes empty."""
    return F.coalesce(clean(F.lower(strip_accents(c))), F.lit(""))


def ascii_fold(c: Column) -> Column:
    return F.coalesce(F.trim(F.lower(F.regexp_replace(strip_accents(c), "[^\\x00-\\x7F]", ""))), F.lit(""))


def cut(c: Column, n: int) -> Column:
    """Cleaned and cut to n; empty becomes null."""
    return F.nullif(F.substring(clean(c), 1, n), F.lit(""))


def ellipsis(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 3), F.lit("..."))).otherwise(c)


def slug(c: Column, n: int = 80) -> Column:
    dashed = F.regexp_replace(F.lower(strip_accents(c)), "[^a-z0-9]+", "-")
    return F.regexp_replace(F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, n), "-+$", "")


def without_municipal_prefix(c: Column) -> Column:
    return F.regexp_replace(normal(c), "^(ilustre municipalidad de|i\\. municipalidad de|municipalidad de|municipio de)\\s+", "")


def host(url: Column) -> Column:
    """Lower-case host without www.; null without one."""
    whole = F.when(F.instr(url, "://") > 0, url).otherwise(F.concat(F.lit("https://"), url))
    return F.regexp_replace(F.lower(F.try_parse_url(whole, F.lit("HOST"))), "^www\\.", "")


def path_segments(url: Column) -> Column:
    return F.filter(F.split(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/"), lambda x: x != "")


def canonical_url(url: Column) -> Column:
    """Stable form: scheme and host in lower case, no www., no trailing slash, no tracking or blank parameters, the
    rest sorted, no fragment."""
    url = F.trim(url)
    path = F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/+$", "")
    pairs = F.split(F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit("")), "&")
    kept = F.array_sort(F.filter(pairs, lambda p: p.rlike("^[^=]+=.+") & ~F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING)))
    query = F.array_join(kept, "&")
    head = F.concat(F.coalesce(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))), F.lit("https")), F.lit("://"), host(url))
    return F.concat(head, F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def url_hash(url: Column) -> Column:
    return F.sha2(canonical_url(url), 256)


def raw_url_hash(url: Column) -> Column:
    return F.sha2(F.lower(F.trim(url)), 256)


def content_hash(*cols: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]), 256)


def stable_id(*cols: Column) -> Column:
    """20 hex digits over cleaned lower-case parts."""
    return F.substring(F.sha1(F.concat_ws("||", *[F.lower(clean(F.coalesce(c.cast("string"), F.lit("")))) for c in cols])), 1, 20)


def money(c: Column) -> Column:
    """1234567 -> $1.234.567"""
    return F.concat(F.lit("$"), F.translate(F.format_number(c, 0), ",", "."))


def pay_range(low: Column, high: Column) -> Column:
    return (
        F.when(low.isNotNull() & high.isNotNull() & (low != high), F.concat(money(low), F.lit(" a "), money(high)))
        .when(low.isNotNull() & high.isNotNull(), money(low))
        .when(low.isNotNull(), F.concat(F.lit("Desde "), money(low)))
        .when(high.isNotNull(), F.concat(F.lit("Hasta "), money(high)))
    )


def email_ok(c: Column) -> Column:
    return F.coalesce(F.trim(c).rlike("^[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}$"), F.lit(False))

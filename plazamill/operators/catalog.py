"""Matching against a catalog: containment, name cascade, domains, sources, modules, overrides, patches, mining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plazamill.functions.text import normal

from . import fuzzy

#: Extractor, profile ("*" for any other) and the module that runs it.
MODULES = (
    ("scraper_wordpress_jobs", "*", "WordPressScraper"), ("scraper_wordpress_news_filter", "*", "WordPressScraper"), ("scraper_external_ats", "ats_trabajando", "TrabajandoCLScraper"), ("scraper_external_ats", "ats_hiringroom", "HiringRoomScraper"),
    ("scraper_external_ats", "ats_buk", "BukScraper"), ("scraper_external_ats", "*", "GenericSiteScraper"), ("scraper_pdf_jobs", "carabineros_pdf_first", "CarabinerosScraper"), ("scraper_pdf_jobs", "pdi_pdf_first", "PdiScraper"),
    ("scraper_pdf_jobs", "*", "GenericSiteScraper"), ("scraper_custom_detail", "ffaa_waf", "FfaaScraper"), ("scraper_custom_detail", "*", "GenericSiteScraper"), ("scraper_playwright", "*", "PlaywrightScraper"), ("scraper_generic_fallback", "*", "GenericSiteScraper"),
)
#: What to do about a reason.
REMEDIES = {
    "stale_active_offer": "Marcar oferta como cerrada o rechazarla al recalcular vigencia.", "placeholder_bases_url": "Nullear url_bases placeholder y forzar reextraccion de bases reales.",
    "invalid_institution_reference": "Mover a quarantine/manual_review y reconciliar catalogo.", "not_job_related": "Revalidar con gatekeeper WordPress/noticias y rebajar frecuencia de la fuente.",
    "salary_outlier": "Limpiar renta parseada y reextraer con parser de remuneraciones.", "duplicate_candidate": "Consolidar duplicados por (institucion_id, cargo, fecha_cierre).",
}


def contained(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """Pairs (t, k) of distinct texts t and keys k, a key of three letters or more being part of the text.

    Every piece of a text that is as long as some key is looked up among the keys: what meets is a pair, and work grows
    with the texts and the lengths that keys have, not with how many keys share a part.
    """
    wanted = keys.where(F.length("k") >= 3).select("k").distinct()
    lengths = wanted.select(F.length("k").alias("n")).distinct()  # few: one row a length
    pieces = texts.select("t").distinct().join(F.broadcast(lengths), F.length("t") >= F.col("n"))
    pieces = pieces.select("t", "n", F.explode(F.sequence(F.lit(1), F.length("t") - F.col("n") + 1)).alias("i")).select("t", F.substring("t", F.col("i"), F.col("n")).alias("k"))
    return pieces.join(wanted.hint("merge"), "k").select("t", "k").distinct()


def name_cascade(names: DataFrame, catalog: DataFrame, name: str, key: str, catalog_name: str, threshold: float = 0.80) -> DataFrame:
    """names with match_id and stage: the catalog's folded name, else the first row (least key) of which one name holds
    the other, else the closest name at or above the threshold. Names below three letters skip the second stage. No side is
    broadcast: a file of names is several times as large in the driver's memory as Spark takes it to be."""
    own = names.select(F.col(name).alias("raw")).distinct().withColumn("a", normal(F.col("raw"))).where("a <> ''")
    cat = catalog.select(F.col(key).alias("k_id"), normal(F.col(catalog_name)).alias("b")).where("b <> ''").groupBy("b").agg(F.min("k_id").alias("k_id")).hint("merge")
    exact = own.join(cat, F.col("a") == F.col("b")).select("raw", "k_id", F.lit("exact").alias("stage"))
    rest = own.join(cat, F.col("a") == F.col("b"), "left_anti")
    above = contained(rest.select(F.col("a").alias("t")), cat.select(F.col("b").alias("k"))).select(F.col("t").alias("a"), F.col("k").alias("b"))
    below = contained(cat.select(F.col("b").alias("t")), rest.select(F.col("a").alias("k"))).select(F.col("k").alias("a"), F.col("t").alias("b"))
    first = above.union(below).join(cat, "b").groupBy("a").agg(F.min("k_id").alias("k_id")).hint("merge")
    held = rest.join(first, "a").select("raw", "k_id", F.lit("contained").alias("stage"))
    left = rest.join(first, "a", "left_anti").select("raw")
    close = fuzzy.best_match(left, catalog, "raw", key, catalog_name, threshold).where("match_id IS NOT NULL").select("raw", F.col("match_id").alias("k_id"), F.lit("close").alias("stage"))
    found = exact.unionByName(held).unionByName(close).withColumnsRenamed({"k_id": "match_id"})
    return names.join(found.hint("merge"), names[name].eqNullSafe(found["raw"]), "left").drop("raw")


def web_domain(rows: DataFrame, catalog: DataFrame, name: str, id_: str) -> DataFrame:
    """rows with domain: of the institution's id, else of its folded name, else of the longest catalog key (ten letters
    or more) in the name. catalog: id, name, short, domain; of keys that repeat the row of least id counts."""
    keyed = catalog.where("domain IS NOT NULL").select("id", "domain", F.explode(F.array(F.struct(normal(F.col("name")).alias("key"), F.lit(0).alias("o")), F.struct(normal(F.col("short")).alias("key"), F.lit(1).alias("o")))).alias("x"))
    keys = keyed.select("id", "domain", "x.*").where("key <> ''").groupBy("key").agg(F.min_by("domain", F.struct("id", "o")).alias("d_name"))
    by_id = catalog.where("domain IS NOT NULL").groupBy(F.col("id").alias("c_id")).agg(F.min("domain").alias("d_id"))
    out = rows.withColumn("__key", normal(F.col(name)))
    pairs = contained(out.select(F.col("__key").alias("t")), keys.where(F.length("key") >= 10).select(F.col("key").alias("k")))
    best = pairs.join(keys, pairs["k"] == keys["key"]).groupBy("t").agg(F.max_by("d_name", F.struct(F.length("k"), "k")).alias("d_part"))
    out = out.join(by_id, out[id_] == by_id["c_id"], "left").join(keys, out["__key"] == keys["key"], "left").join(best, out["__key"] == best["t"], "left")
    return out.withColumn("domain", F.coalesce("d_id", "d_name", "d_part")).drop("__key", "c_id", "d_id", "key", "d_name", "t", "d_part")


def resolved_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows (extractor, host, site_host, name) with source_id: the central portal for its extractor (or none), else the
    first source of either host, else of the same name. sources: id, platform, host, name, in the order of ids."""
    least = lambda key, as_: sources.where(F.coalesce(key, F.lit("")) != "").groupBy(key.alias(as_)).agg(F.min("id").alias(f"{as_}_id"))
    central = sources.where(F.lower("platform") == "empleospublicos").agg(F.min("id").alias("central_id"))
    out = rows.crossJoin(F.broadcast(central))  # one row
    by_host, by_name = least(F.col("host"), "h"), least(F.lower(F.trim("name")), "n")
    out = out.join(by_host, out["host"] == F.col("h"), "left").drop("h").withColumnRenamed("h_id", "first_id").join(by_host, F.col("site_host") == F.col("h"), "left").drop("h").withColumnRenamed("h_id", "second_id")
    out = out.join(by_name, F.lower(F.trim(out["name"])) == F.col("n"), "left").drop("n")
    found = F.when(F.col("extractor") == "scraper_empleos_publicos", F.col("central_id")).otherwise(F.coalesce(F.least("first_id", "second_id"), "n_id"))
    return out.withColumn("source_id", found).drop("central_id", "first_id", "second_id", "n_id")


def module(extractor: Column, profile: Column) -> Column:
    """The module of an extractor and profile: the exact one, else that for any profile."""
    table = lambda rows: F.create_map(*[F.lit(x) for kv in rows for x in kv])
    exact = table([(f"{e}|{p}", m) for e, p, m in MODULES if p != "*"])
    other = table([(e, m) for e, p, m in MODULES if p == "*"])
    return F.coalesce(F.try_element_at(exact, F.concat_ws("|", extractor, profile)), F.try_element_at(other, extractor))


def overridden(rows: DataFrame, overrides: DataFrame, states, kinds) -> DataFrame:
    """rows (id, status, kind, confidence, reason) with what an override by id says; unknown values change nothing."""
    o = overrides.select(F.col("id").alias("o_id"), F.col("status").alias("o_status"), F.col("kind").alias("o_kind"), F.col("reason").alias("o_reason"), F.col("tier").alias("o_tier"))
    j = rows.join(o, rows["id"] == o["o_id"], "left")
    hit = F.col("o_id").isNotNull()
    return j.withColumns({
        "status": F.when(F.col("o_status").isin(*states), F.col("o_status")).otherwise(F.col("status")), "kind": F.when(F.col("o_kind").isin(*kinds), F.col("o_kind")).otherwise(F.col("kind")),
        "confidence": F.when(hit, "validated").otherwise(F.col("confidence")), "reason": F.when(hit, F.concat(F.lit("override: "), F.coalesce(F.nullif("o_reason", F.lit("")), "reason"))).otherwise(F.col("reason")),
        "tier": F.nullif(F.lower(F.trim("o_tier")), F.lit("")),
    }).drop("o_id", "o_status", "o_kind", "o_reason", "o_tier")


def first_seen(rows: DataFrame, key: Column, order: Column) -> DataFrame:
    """The first row of each key that isn't empty."""
    packed = F.struct(*[F.col(c) for c in rows.columns])
    return rows.withColumn("__k", key).where(F.coalesce("__k", F.lit("")) != "").groupBy("__k").agg(F.min_by(packed, order).alias("r")).select("r.*")


def suggestions(rows: DataFrame, stop: list[str], known_text: str, known_words: list[str], known_parts: list[str], support: int = 3, most: int = 25) -> DataFrame:
    """Heuristics to add: words of rejected titles (at least three times as often as in published ones), then segments
    of rejected URLs, most frequent first, `most` in all. rows: id, decision, title (folded), path (of the URL)."""
    words = rows.select("decision", F.explode(F.array_distinct(F.filter(F.regexp_extract_all("title", F.lit("[a-z0-9]{4,}"), F.lit(0)), lambda w: ~w.isin(*stop)))).alias("candidate"))
    counts = words.groupBy("candidate").agg(F.count_if(F.col("decision") == "reject").alias("support"), F.count_if(F.col("decision") == "publish").alias("published"))
    fine = counts.where((F.col("support") >= support) & (F.col("published") * 3 <= F.col("support")) & ~F.contains(F.lit(known_text), F.col("candidate")) & ~F.col("candidate").isin(*known_words))
    parts = rows.where("decision = 'reject'").select(F.explode(F.array_distinct(F.filter(F.split(F.lower("path"), "/"), lambda s: s != ""))).alias("candidate")).groupBy("candidate").agg(F.count("*").alias("support"))
    parts = parts.where((F.col("support") >= support) & ~F.col("candidate").isin(*known_parts) & ~F.col("candidate").rlike("^[0-9]+$") & (F.length("candidate") >= 4))
    both = fine.select(F.lit(0).alias("kind"), "candidate", "support").union(parts.select(F.lit(1).alias("kind"), "candidate", "support"))
    return both.orderBy("kind", F.desc("support"), "candidate").limit(most)


def patched(catalog: DataFrame, found: DataFrame, manual: DataFrame, dead: DataFrame) -> DataFrame:
    """catalog (id, site, url, platform, state) after three files of evidence by id: sites found again, manual findings
    over them, and dead ids, which count only where nothing is verified by then."""
    f = found.select(F.col("id").alias("f_id"), F.col("site").alias("f_site"), F.col("url").alias("f_url"), F.col("platform").alias("f_platform"))
    m = manual.select(F.col("id").alias("m_id"), F.col("site").alias("m_site"), F.col("url").alias("m_url"), F.col("platform").alias("m_platform"))
    d = dead.select(F.col("id").alias("d_id")).distinct()
    j = catalog.join(f, F.col("id") == F.col("f_id"), "left").join(m, F.col("id") == F.col("m_id"), "left").join(d, F.col("id") == F.col("d_id"), "left")
    found_, manual_ = F.col("f_id").isNotNull(), F.col("m_id").isNotNull()
    state = F.when(found_ | manual_, "Verificado").otherwise(F.col("state"))
    return j.select(
        "id", F.when(manual_, F.coalesce(F.nullif("m_site", F.lit("")), F.when(found_, F.col("f_site")).otherwise(F.col("site")))).when(found_, F.col("f_site")).otherwise(F.col("site")).alias("site"),
        F.when(manual_, F.col("m_url")).when(found_, F.col("f_url")).otherwise(F.col("url")).alias("url"), F.when(manual_, F.col("m_platform")).when(found_, F.col("f_platform")).otherwise(F.col("platform")).alias("platform"),
        F.when(F.col("d_id").isNotNull() & ~F.coalesce(state == "Verificado", F.lit(False)), "Sitio caído").otherwise(state).alias("state"),
    )


def subscribed(old: DataFrame, new: DataFrame, criteria: list[str], now: Column) -> DataFrame:
    """Subscriptions after new ones: a known address (any case) with the same criteria, null and "" being one, is
    switched on and takes the frequency; others are added. Of new rows with one key the last id counts."""
    same = F.concat_ws("\u0001", F.lower("email"), *[F.coalesce(F.trim(F.col(c)), F.lit("")) for c in criteria])
    often = F.when(F.lower(F.trim("freq")).isin("diaria", "semanal"), F.lower(F.trim("freq"))).otherwise("diaria")
    last = new.withColumn("k", same).groupBy("k").agg(F.max_by(F.struct("id", "email", *criteria, often.alias("freq")), "id").alias("n"))
    j = old.withColumn("k", same).join(last, "k", "full")
    known, hit = F.col("id").isNotNull(), F.col("n").isNotNull()
    return j.select(
        F.coalesce("id", "n.id").alias("id"), F.when(known, F.col("email")).otherwise(F.col("n.email")).alias("email"), *[F.when(known, F.col(c)).otherwise(F.trim(F.col(f"n.{c}"))).alias(c) for c in criteria],
        F.when(hit, F.col("n.freq")).otherwise(F.col("freq")).alias("freq"), F.when(hit, True).otherwise(F.col("active")).alias("active"), (~known).alias("added"), F.when(hit, now).otherwise(F.col("updated")).alias("updated"),
    )

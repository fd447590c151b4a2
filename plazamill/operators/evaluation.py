"""Evaluation of a fetched page of a source: profile, dates, validity, signals, page type, relevance, routing.

Input is one row per page: id, platform, url (of the catalog), final_url, status, error, content_type, headers (text),
html. Each page is parsed once into its tree (sources/markup.py); everything else is column expressions over that.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plazamill.functions import json_walk as J
from plazamill.functions import labels as LB
from plazamill.functions import tables as TB
from plazamill.functions.dates import date_in, labelled_dates
from plazamill.functions.lookups import contains_any, count_of
from plazamill.functions.text import ascii_fold
from plazamill.operators.sources_policy import thresholds
from plazamill.sources import markup as M

#: Profile, domains, institution ids, platform markers, extractor, extract and manual thresholds, renders
#: scripts, reads PDFs, trusted; the first profile that fits decides.
PROFILES = (
    ("empleos_publicos", ("empleospublicos.cl",), (), ("empleospublicos",), "scraper_empleos_publicos", 0.65, 0.45, False, False, True),
    ("carabineros_pdf_first", ("postulaciones.carabineros.cl", "carabineros.cl"), (161,), (), "scraper_pdf_jobs", 0.7, 0.5, False, True, False),
    ("pdi_pdf_first", ("pdichile.cl", "postulaciones.investigaciones.cl"), (162,), (), "scraper_pdf_jobs", 0.7, 0.5, False, True, False),
    ("policia_waf", ("postulaciones.carabineros.cl", "postulaciones.investigaciones.cl"), (), (), "scraper_custom_detail", 0.72, 0.52, False, True, False),
    ("ffaa_waf", ("ingreso.ejercito.cl", "admisionarmada.cl", "ejercito.cl", "armada.cl"), (157, 158), (), "scraper_custom_detail", 0.72, 0.52, False, False, False),
    ("ats_trabajando", ("trabajando.cl",), (), ("trabajando.cl", "trabajando cl"), "scraper_external_ats", 0.65, 0.45, False, False, False),
    ("ats_hiringroom", ("hiringroom.com", "hiringroomcampus.com"), (), ("hiringroom",), "scraper_external_ats", 0.65, 0.45, False, False, False),
    ("ats_buk", ("buk.cl",), (), ("buk",), "scraper_external_ats", 0.65, 0.45, False, False, False),
    ("playwright_js", ("bcentral.cl", "codelco.com", "tvn.cl"), (145, 275, 280), (), "scraper_playwright", 0.75, 0.55, True, False, False),
    ("wordpress", (), (), ("wordpress", "wp-json", "wp-content"), "scraper_wordpress_jobs", 0.8, 0.6, False, False, False),
    ("generic_site", (), (), (), "scraper_generic_fallback", 0.78, 0.58, False, False, False),
)
#: The family whose history adapts a profile's thresholds.
FAMILY_OF = {
    "empleos_publicos": "trusted_portal", "carabineros_pdf_first": "pdf_first_waf", "pdi_pdf_first": "pdf_first_waf", "policia_waf": "waf_protected", "ffaa_waf": "waf_protected", "ats_trabajando": "external_ats", "ats_hiringroom": "external_ats",
    "ats_buk": "external_ats", "playwright_js": "js_intensive", "wordpress": "wordpress", "generic_site": "generic",
}
#: Hints found at run time and the profile each names.
HINTS = (("ats_buk", "ats_buk"), ("ats_hiringroom", "ats_hiringroom"), ("ats_trabajando", "ats_trabajando"), ("cms_wordpress", "wordpress"))
#: Kinds of overrides that skip the evaluation, with extractor and profile; police ids have their own.
BYPASS = (
    ("custom_trabajando", "scraper_external_ats", "ats_trabajando"), ("custom_hiringroom", "scraper_external_ats", "ats_hiringroom"), ("custom_buk", "scraper_external_ats", "ats_buk"), ("custom_ffaa", "scraper_custom_detail", "ffaa_waf"),
)
POLICE = ((161, "scraper_pdf_jobs", "carabineros_pdf_first"), (162, "scraper_pdf_jobs", "pdi_pdf_first"))
#: Labels of meta names.
META = (
    ("article:published_time", "publication"), ("datepublished", "publication"), ("datecreated", "publication"), ("date", "publication"), ("fecha_publicacion", "publication"), ("article:modified_time", "publication"),
    ("fecha_cierre", "closing"), ("closingdate", "closing"), ("applicationdeadline", "deadline"), ("validthrough", "deadline"),
)
JOB_TERMS = ("concurso publico", "postulacion", "bases", "perfil del cargo", "vacante", "honorarios", "contrata", "planta", "recepcion de antecedentes")
OTHER_TERMS = ("subsidio", "beca", "fondo concursable", "noticia", "actividad", "taller", "beneficio", "tramite", "licitacion", "curso", "feria")


def key(c: Column) -> Column:
    """Folded to ASCII, lower case, single blanks."""
    return F.trim(F.regexp_replace(ascii_fold(c), "\\s+", " "))


def of_profile(name: Column, at: int) -> Column:
    """A property of the profile of that name, by its place in PROFILES."""
    return F.try_element_at(F.create_map(*[x for p in PROFILES for x in (F.lit(p[0]), F.lit(p[at]))]), name)


def profile(id_: Column, host: Column, platform: Column, hints: Column) -> Column:
    """struct(profile, matched_by): institution id, domain in the host, run-time hint, marker in the platform's name."""
    row = lambda p, by: F.struct((F.lit(p) if isinstance(p, str) else p).alias("profile"), F.lit(by).alias("matched_by"))
    h, p = F.lower(F.coalesce(host, F.lit(""))), F.lower(F.coalesce(platform, F.lit("")))
    rules = [(id_.isin(*x[2]), row(x[0], "institution_id")) for x in PROFILES if x[2]]
    rules += [(contains_any(h, x[1]), row(x[0], "domain")) for x in PROFILES if x[1]]
    rules += [(F.array_contains(hints, hint), row(name, "runtime")) for hint, name in HINTS]
    rules += [(contains_any(p, x[3]), row(x[0], "override")) for x in PROFILES if x[3]]
    out = row("generic_site", "fallback")
    for hit, found in reversed(rules):
        out = F.when(hit, found).otherwise(out)
    return out


def visible(html: Column) -> Column:
    """The text between the tags, references decoded, scripts and styles left out."""
    return M.text(html)


def runtime_hints(final_url: Column, headers: Column, page: Column) -> Column:
    """Sorted hints from the address, headers, script sources, meta tags and links of a page's tree."""
    of = lambda tag, name: F.array_compact(F.transform(F.filter(page["nodes"], lambda n: n["tag"] == tag), lambda n: M.attr(n, name)))
    metas = F.flatten(F.transform(F.filter(page["nodes"], lambda n: n["tag"] == "meta"), lambda n: F.map_values(n["attrs"])))
    blob = F.lower(F.concat_ws("\n", final_url, headers, of("script", "src"), metas, of("link", "href"), M.hrefs(page)))
    return F.array_compact(F.array(F.when(F.contains(blob, F.lit("buk.cl")), "ats_buk"), F.when(F.contains(blob, F.lit("hiringroom")), "ats_hiringroom"), F.when(F.contains(blob, F.lit("trabajando.cl")), "ats_trabajando"), F.when(contains_any(blob, TB.WORDPRESS_MARKERS), "cms_wordpress")))


def page_type(final_url: Column, content_type: Column, html: Column, page: Column, profile_name: Column) -> Column:
    """html and page are the markup and its tree."""
    u, ct, body, title = F.lower(final_url), F.lower(F.coalesce(content_type, F.lit(""))), key(html), key(M.title(page))
    n = lambda *tags: M.count(page, *tags)
    wordpress = contains_any(body, TB.WORDPRESS_MARKERS) | contains_any(u, TB.WORDPRESS_MARKERS) | (profile_name == "wordpress")
    post = (n("article") > 0) | F.exists(page["nodes"], lambda x: (x["tag"] == "body") & F.exists(x["classes"], lambda c: c.rlike("(?i)single|post-template")))
    return (
        F.when(F.contains(ct, F.lit("pdf")) | u.endswith(".pdf"), "document_page").when(contains_any(u, TB.ATS_HOSTS), "ats_external").when(wordpress & post, "wordpress_post").when(wordpress, "wordpress_listing")
        .when(contains_any(u, TB.NEWS_PATHS), "news_page").when(n("article") > 1, "listing_page").when((n("a") >= 12) & (n("table", "li") >= 8), "listing_page")
        .when((n("h1") > 0) & (M.said(page).rlike("(?i)requisitos|funciones|remuneraci") | (n("table") > 0)), "detail_page")
        .when(title.isin("concursos", "trabaja con nosotros", "ofertas laborales"), "listing_page").otherwise("general_page")
    )


def relevance(text: Column, page: Column, confidence: Column) -> Column:
    t = key(text)
    good, bad = count_of(t, JOB_TERMS), count_of(t, OTHER_TERMS)
    return (
        F.when((good >= 3) & (bad == 0), "job_like").when((bad >= 3) & (good == 0), "non_job").when((good >= 2) & (bad >= 1), "mixed")
        .when((confidence < 0.55) & page.isin("news_page", "general_page"), "non_job").otherwise("uncertain")
    )


def dates(html: Column, text: Column, today: Column) -> Column:
    """dates_of for markup that isn't parsed yet."""
    return M.let(F.struct(M.tree(html).alias("page"), text.alias("text")), lambda x: dates_of(x["page"], x["text"], today))


def dates_of(page: Column, text: Column, today: Column) -> Column:
    """struct(publication, closing, deadline): of meta tags (0.92), linked data (0.95), time tags (0.86) and
    labelled text the surest evidence counts, the earliest date of equals."""
    blocks = F.filter(page["nodes"], lambda n: (n["tag"] == "script") & F.contains(F.lower(F.coalesce(M.attr(n, "type"), F.lit(""))), F.lit("ld+json")))
    every = F.flatten(F.transform(blocks, lambda n: J.graph_objects(n["data"])))
    return M.let(F.struct(key(text).alias("folded"), every.alias("data")), lambda x: _dates(page, x["folded"], x["data"], today))


def _dates(page: Column, folded: Column, data: Column, today: Column) -> Column:
    filled = lambda c: F.nullif(c, F.lit(""))

    def stamped(v: Column, future: bool = True) -> Column:
        return F.coalesce(M.let(key(v), lambda k: date_in(k, today, future)), F.try_to_date(F.regexp_extract(v, "^\\s*([0-9]{4}-[0-9]{2}-[0-9]{2})[Tt ]", 1), "yyyy-MM-dd"))

    def days(values: Column, future: bool = True) -> Column:
        return F.array_compact(F.transform(F.array_compact(values), lambda v: stamped(v, future)))

    def best(*groups: tuple[float, Column]) -> Column:
        return F.coalesce(*[F.array_min(d) for _, d in sorted(groups, key=lambda g: -g[0])])

    def meta(label: str) -> Column:
        names = [k for k, v in META if v == label]
        mine = F.filter(page["nodes"], lambda n: (n["tag"] == "meta") & key(F.coalesce(*[filled(M.attr(n, a)) for a in ("property", "name", "itemprop")])).isin(*names))
        return days(F.transform(mine, lambda n: F.coalesce(filled(M.attr(n, "content")), filled(M.attr(n, "value")))))

    def linked(*names: str) -> Column:
        fields = lambda v: F.map_values(F.map_filter(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, _: F.lower(k).isin(*names)))
        return days(F.flatten(F.transform(data, lambda v: F.transform(fields(v), lambda x: F.try_variant_get(x, "$", "string")))))

    timed = days(F.transform(F.filter(page["nodes"], lambda n: n["tag"] == "time"), lambda n: F.coalesce(filled(M.attr(n, "datetime")), M.said(page, n))), False)
    return F.struct(
        best((0.95, linked("datepublished", "datecreated", "dateposted")), (0.92, meta("publication")), (0.86, timed), (0.78, labelled_dates(folded, TB.PUBLICATION_LABELS, today, False))).alias("publication"),
        best((0.95, linked("closingdate", "dateclosing")), (0.92, meta("closing")), (0.84, labelled_dates(folded, TB.CLOSING_LABELS, today, True))).alias("closing"),
        best((0.95, linked("validthrough")), (0.92, meta("deadline")), (0.84, labelled_dates(folded, TB.DEADLINE_LABELS, today, True))).alias("deadline"),
    )


def validity(page: Column, text: Column, published: Column, closes: Column, deadline: Column, has_bases: Column, today: Column) -> Column:
    """struct(status, open_calls, reason, open_signals, expired_signals): deadline, closing date, texts, then age."""
    t = key(text)
    opened, expired = count_of(t, TB.OPEN_SIGNALS), count_of(t, TB.EXPIRED_SIGNALS)
    row = lambda s, o, r=None: F.struct(F.lit(s).alias("status"), F.lit(o).alias("open_calls"), F.lit(r).cast("string").alias("reason"), opened.alias("open_signals"), expired.alias("expired_signals"))
    old = page.isin("wordpress_post", "news_page", "general_page") & (F.datediff(today, published) > 90) & ~has_bases
    return (
        F.when(deadline < today, row("expired_confirmed", "only_expired_calls", "deadline_passed")).when(deadline.isNotNull(), row("open_confirmed", "has_open_calls"))
        .when(closes < today, row("expired_confirmed", "only_expired_calls", "closing_date_passed")).when(closes.isNotNull(), row("open_confirmed", "has_open_calls"))
        .when((expired > 0) & (opened == 0), row("expired_confirmed", "only_expired_calls", "expired_text_signal")).when((opened > 0) & (expired == 0), row("open_confirmed", "has_open_calls"))
        .when((opened > 0) & (expired > 0), row("manual_review", "unknown_status", "manual_review_required")).when(old, row("expired_by_publication_age", "no_calls_found", "publication_too_old"))
        .otherwise(row("unknown_validity", "unknown_status"))
    )


def signals(path: Column, title: Column, text: Column, page: Column, published: Column, closes: Column, deadline: Column, jsonld: Column, pdfs: Column, known_ats: Column, bot_or_js: Column, open_signals: Column, today: Column, weights: dict | None = None) -> Column:
    """struct(confidence, positive, negative): 0.5 plus the weights of eleven signals, within [0, 1]."""
    w = TB.SIGNAL_WEIGHTS | (weights or {})
    t, ti, u = key(text), key(title), key(path)
    good = count_of(F.concat(t, F.lit(" "), u), TB.JOB_CLUSTER)
    bad = count_of(F.concat(t, F.lit(" "), ti), TB.OTHER_CLUSTER)
    old = (F.datediff(today, published) > 90) & (open_signals == 0) & deadline.isNull() & closes.isNull()
    rules = {
        "jobposting_jsonld": jsonld, "future_deadline": deadline >= today, "closing_metadata": closes.isNotNull(), "pdf_bases_or_profile": F.exists(pdfs, lambda x: x.rlike("(?i)bases|perfil|descriptor")), "known_ats": known_ats,
        "job_cluster": (good >= 2) | u.rlike("concurso|trabaja|trabaje|empleo|oferta|convocatoria|postul"), "listing_only_title": ti.isin(*TB.LISTING_TITLES) | ((page == "listing_page") & (good < 2)),
        "negative_cluster": (bad >= 2) | (page == "news_page"), "old_without_open_signal": old, "generic_landing_page": (page == "general_page") & (good == 0), "bot_waf_js": bot_or_js,
    }
    held = {n: F.coalesce(c, F.lit(False)) for n, c in rules.items()}
    raw = sum((F.when(c, F.lit(float(w[n]))).otherwise(0.0) for n, c in held.items()), F.lit(0.0))
    names = lambda sign: F.array_compact(F.array(*[F.when(c, n) for n, c in held.items() if (TB.SIGNAL_WEIGHTS[n] > 0) == sign]))
    return F.struct(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(0.5) + raw)), 4).alias("confidence"), names(True).alias("positive"), names(False).alias("negative"))


def select_extractor(profile_name: Column, availability: Column, page: Column, relevance_: Column, validity_: Column, confidence: Column, extract_at: Column, manual_at: Column) -> Column:
    """struct(extractor, decision, reason): ten ordered rules and a default."""

    def row(extractor, decision, reason=None):
        text = lambda x: F.lit(x).cast("string") if x is None or isinstance(x, str) else x
        return F.struct(text(extractor).alias("extractor"), text(decision).alias("decision"), text(reason).alias("reason"))

    hint = of_profile(profile_name, 4)
    sure = confidence >= extract_at
    judged = lambda extractor: row(extractor, F.when(sure, "extract").otherwise("manual_review"), F.when(~sure, "manual_review_required"))
    wordpress, non_job = page.isin("wordpress_post", "wordpress_listing"), relevance_ == "non_job"
    blog = F.when(non_job, "scraper_wordpress_news_filter").otherwise("scraper_wordpress_jobs")
    return (
        F.when((availability == "js_required") & of_profile(profile_name, 7), judged("scraper_playwright")).when(availability != "ok", row(None, "source_status_only", availability))
        .when((page == "document_page") & of_profile(profile_name, 8), row("scraper_pdf_jobs", "extract")).when((page == "ats_external") | (hint == "scraper_external_ats"), judged("scraper_external_ats"))
        .when(profile_name == "empleos_publicos", row("scraper_empleos_publicos", "extract")).when(wordpress & non_job, row(blog, "skip", "not_job_related"))
        .when(wordpress & (validity_ == "expired_by_publication_age"), row(blog, "skip", "publication_too_old")).when(wordpress, judged(blog)).when(validity_ == "expired_confirmed", row(hint, "skip", "only_expired_calls"))
        .when((page == "listing_page") & ~sure, row(hint, "manual_review", "listing_without_offer_detail")).when(sure, row(hint, "extract")).when(confidence >= manual_at, row(hint, "manual_review", "manual_review_required"))
        .otherwise(row(hint, "skip", "no_matching_extractor"))
    )


def evaluate(pages: DataFrame, today: date, noise: Column | None = None, history: DataFrame | None = None) -> DataFrame:
    """history: id, sample, precision, recall of what the source gave before; it adapts the profile's thresholds.

    One evaluation per page: availability, profile, page type, dates, validity, signals with the noise penalty, the
    floor of trusted sources, routing and the repairs of its reason."""
    c, day = F.col, F.lit(today)
    noise = F.lit(0.0) if noise is None else noise
    out = pages.withColumn("availability", LB.availability(c("error"), c("status"), c("html"), c("content_type"))).withColumn("body", F.coalesce("html", F.lit("")))
    out = out.withColumn("tree", M.tree(c("body")))
    out = out.withColumn("hints", F.when(c("availability") == "ok", runtime_hints(c("final_url"), c("headers"), c("tree"))).otherwise(F.array().cast("array<string>")))
    host = F.regexp_extract(F.lower("url"), "^[a-z]+://([^/?#]+)", 1)
    out = out.withColumn("p", profile(c("id"), host, c("platform"), c("hints"))).withColumn("noise", noise)
    out = out.withColumn("text", M.said(c("tree"))).withColumn("title", M.title(c("tree"))).withColumn("pdfs", F.filter(M.hrefs(c("tree")), lambda x: F.lower(x).endswith(".pdf")))
    out = out.withColumn("page", F.when(c("availability") == "ok", page_type(c("final_url"), c("content_type"), c("body"), c("tree"), c("p.profile"))).otherwise("unknown_page_type"))
    out = out.withColumn("d", dates_of(c("tree"), c("text"), day))
    bases = F.exists("pdfs", lambda x: key(x).rlike("bases|perfil"))
    out = out.withColumn("v", validity(c("page"), c("text"), c("d.publication"), c("d.closing"), c("d.deadline"), bases, day))
    jsonld = F.exists(M.scripts(c("tree"), "application/ld+json"), lambda x: F.contains(F.lower(x), F.lit("jobposting")))
    ats = (c("page") == "ats_external") | (of_profile(c("p.profile"), 4) == "scraper_external_ats")
    path = F.regexp_extract("final_url", "^[a-z]+://[^/?#]+([^?#]*)", 1)
    barred = c("availability").isin("js_required", "blocked_by_bot_protection")
    out = out.withColumn("s", signals(path, c("title"), c("text"), c("page"), c("d.publication"), c("d.closing"), c("d.deadline"), jsonld, c("pdfs"), ats, barred, c("v.open_signals"), day))
    held = F.when(c("noise") > 0, F.greatest(F.lit(0.0), F.round(c("s.confidence") - F.least(F.lit(0.2), c("noise") * 0.25), 4))).otherwise(c("s.confidence"))
    out = out.withColumn("held", F.when(c("availability") == "ok", held).otherwise(0.0)).withColumn("relevance", F.when(c("availability") == "ok", relevance(c("text"), c("page"), c("held"))).otherwise("uncertain"))
    trusted = of_profile(c("p.profile"), 9) & (c("v.status") != "expired_confirmed") & (c("availability") == "ok")
    out = out.withColumn("confidence", F.when(trusted, F.greatest("held", F.lit(0.8))).otherwise(c("held")))
    extract_at, manual_at = of_profile(c("p.profile"), 5), of_profile(c("p.profile"), 6)
    if history is not None:
        family = F.try_element_at(F.create_map(*[F.lit(x) for kv in FAMILY_OF.items() for x in kv]), c("p.profile"))
        out = out.withColumns({"family": family, "extract_threshold": extract_at, "manual_threshold": manual_at})
        out = thresholds(out.join(history.select("id", "sample", "precision", "recall"), "id", "left"))
        extract_at, manual_at = c("extract_applied"), c("manual_applied")
    out = out.withColumn("x", select_extractor(c("p.profile"), c("availability"), c("page"), c("relevance"), c("v.status"), c("confidence"), extract_at, manual_at))
    undecided = (c("v.status") == "manual_review") & (c("x.decision") == "skip")
    decision = F.when(undecided, "manual_review").otherwise(c("x.decision"))
    reason = F.when(undecided, "manual_review_required").otherwise(F.coalesce("x.reason", "v.reason"))
    calls = F.when(c("relevance") == "non_job", "no_calls_found").otherwise(c("v.open_calls"))
    return out.select(
        "id", "availability", c("p.profile").alias("profile"), c("p.matched_by").alias("matched_by"), F.array_join("hints", ",").alias("hints"), c("page").alias("page_type"), "relevance", c("v.status").alias("validity"), calls.alias("open_calls"),
        "confidence", c("x.extractor").alias("extractor"), decision.alias("decision"), reason.alias("reason"), F.array_join(F.concat("s.positive", "s.negative", F.when(c("noise") > 0, F.array(F.lit("historical_noise_penalty"))).otherwise(F.array().cast("array<string>"))), ",").alias("signals"),
        c("d.publication").alias("published"), c("d.closing").alias("closes"), c("d.deadline").alias("deadline"),
    )


def bypass(id_: Column, status: Column, kind: Column) -> Column:
    """struct(extractor, profile) of an active source whose kind skips the evaluation; null for others."""
    row = lambda e, p: F.struct(F.lit(e).alias("extractor"), F.lit(p).alias("profile"))
    out = None
    for i, e, p in POLICE:
        hit = (kind == "custom_policia") & (id_ == i)
        out = F.when(hit, row(e, p)) if out is None else out.when(hit, row(e, p))
    for k, e, p in BYPASS:
        out = out.when(kind == k, row(e, p))
    return F.when(status == "active", out)


def demoted(extractor: Column, decision: Column, reason: Column, can_render: bool) -> Column:
    """struct(extractor, decision, reason): without a renderer its sources are only watched."""
    lost = F.coalesce(extractor == "scraper_playwright", F.lit(False)) & F.lit(not can_render)
    return F.struct(F.when(~lost, extractor).alias("extractor"), F.when(lost, "source_status_only").otherwise(decision).alias("decision"), F.when(lost, "playwright_runtime_unavailable").otherwise(reason).alias("reason"))


def source_status(platform: Column, url: Column, site: Column, sector: Column, verified: Column, publishes: Column, needs_js: Column) -> Column:
    """struct(status, kind, confidence, reason, central): eight ordered rules over the catalog's texts."""
    p, ep = key(platform), key(publishes)
    ok = F.coalesce(key(verified) == "verificado", F.lit(False))
    central = ep.isin("si", "parcialmente")

    def row(s, k, c, r):
        text = lambda x: F.lit(x) if isinstance(x, str) else x
        return F.struct(text(s).alias("status"), F.lit(k).alias("kind"), text(c).alias("confidence"), text(r).alias("reason"), central.alias("central"))

    has = lambda *words: contains_any(p, words)
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    tested, sure = F.when(ok, "active").otherwise("experimental"), F.when(ok, "validated").otherwise("medium")
    own = has("sitio propio", "portal propio", "cms", "joomla", "php", "transparencia", "transparen")
    town = F.trim(F.coalesce(sector, F.lit(""))) == "Municipal"
    return (
        F.when(blank(url) & blank(site), row("broken", "skip", "validated", "sin url_empleo ni sitio_web")).when(key(needs_js).isin("si", "yes", "true", "1") | has("spa", "vue", "react", "javascript"), row("js_required", "skip", "validated", "requiere navegador con JS"))
        .when(ep == "si", row("active", "empleos_publicos", "validated", "cubierto por empleospublicos.cl batch")).when(has("trabajando.cl", "trabajando cl"), row(tested, "custom_trabajando", sure, "portal trabajando.cl"))
        .when(has("hiringroom"), row(tested, "custom_hiringroom", sure, "portal HiringRoom")).when(has("buk"), row(tested, "custom_buk", sure, "portal Buk"))
        .when(has("wordpress"), row(tested, "wordpress", sure, F.when(ok, "WordPress verificado").otherwise("WordPress sin verificar"))).when(own & ok, row("active", "generic", "validated", "sitio propio verificado manualmente"))
        .when(own & town, row("manual_review", "generic", "low", "municipio con sitio propio sin verificar")).when(own, row("manual_review", "generic", "low", "sitio propio sin verificar"))
        .when(p != "", row("manual_review", "skip", "low", F.concat(F.lit("plataforma sin módulo dedicado: "), p))).otherwise(row("disabled", "skip", "low", "sin plataforma declarada"))
    )

"""Evaluation of fetched pages and sources: each rule with its SQL, then the whole cascade."""

from __future__ import annotations

from pyspark.sql import functions as F

from plazamill.context import OFFERS
from plazamill.functions import dates as DT
from plazamill.functions import tables as TB
from plazamill.operators import evaluation as E
from plazamill.operators import sources_policy as P
from plazamill.sources import adapters as A
from plazamill.sources import markup as M

from .base import lit, picked, query, sql_any, sql_count
from .labels import dealt, dealt_sql
from .listing import D
from .scalars import sql_fold


def sql_key(x: str) -> str:
    return f"trim(regexp_replace({sql_fold(x)}, '\\s+', ' ', 'g'))"


DAYS = (
    "Publicado el 3 de marzo de 1998. Fecha de cierre: 15/06/1998", "Recepción de antecedentes hasta el lunes 20 de junio; cierre 1998-07-01", "postulaciones hasta 31/02/1998, hasta el 05.06.1998", "cierre: 2 de brumario de 1998 y cierre 3 de mayo", "plazo de postulación 1-12-1998 y hasta el 4 de julio",
    "publicacion " + "x" * 130 + " 01/01/1998", "sin fechas", None, "Hasta el 15 de enero, posted on 10 de junio", "fecha de publicacion 5 de mayo; fecha de cierre 30 de abril",
)
_M = ", ".join(f"'{m}'" for m in DT.MONTH_NAMES)
_MN = ", ".join(str(n) for n in DT.MONTH_NAMES.values())


def sql_date_in(x: str, future: bool) -> str:
    ymd = lambda y, m, d: f"CAST(try_strptime({y} || '-' || {m} || '-' || {d}, '%Y-%m-%d') AS DATE)"
    month = f"[{_MN}][list_position([{_M}], regexp_extract({x}, '{DT.NAMED}', 2))]::VARCHAR"
    day, year = f"regexp_extract({x}, '{DT.NAMED}', 1)", f"regexp_extract({x}, '{DT.NAMED}', 3)"
    near = "list_filter([" + ", ".join(ymd(f"(year({D}) {k:+d})::VARCHAR", month, day) for k in (-1, 0, 1)) + f"], lambda y: y IS NOT NULL AND y - {D} BETWEEN -30 AND 365)"
    nearest = f"list_sort(list_transform({near}, lambda y: {{'o': abs(y - {D}), 'd': y}}))[1].d"
    inferred = f"coalesce(list_min(list_filter({near}, lambda y: y >= {D})), {nearest})" if future else nearest
    forms = " ".join(f"WHEN regexp_matches({x}, '{p}') THEN " + ymd(*[f"regexp_extract({x}, '{p}', {g})" for g in gs]) for p, gs in DT.FORMS)
    return f"CASE {forms} WHEN regexp_matches({x}, '{DT.NAMED}') THEN CASE WHEN {year} <> '' THEN {ymd(year, month, day)} ELSE {inferred} END END"


def sql_labelled(t: str, labels, future: bool) -> str:
    def of(label):
        starts = f"list_transform(generate_series(1, len(string_split({t}, {lit(label)})) - 1), lambda i: list_sum(list_transform(string_split({t}, {lit(label)})[1:i], lambda q: length(q)))::BIGINT + (i - 1) * {len(label)})"
        return f"list_transform({starts}, lambda s: substring({t}, s + 1, 120))"

    snippets = " || ".join(of(x) for x in labels)
    return f"list_filter(list_transform({snippets}, lambda z: {sql_date_in('z', future)}), lambda z: z IS NOT NULL)"


@query(f"""SELECT id, CAST(list_min({sql_labelled('t', TB.PUBLICATION_LABELS, False)}) AS VARCHAR) AS publicacion, CAST(list_min({sql_labelled('t', TB.CLOSING_LABELS, True)}) AS VARCHAR) AS cierre, CAST(list_min({sql_labelled('t', TB.DEADLINE_LABELS, True)}) AS VARCHAR) AS plazo FROM (SELECT id, {sql_key('texto')} AS t FROM {dealt_sql(texto=DAYS)})""", cte=False)
def d05_labelled_dates(spark, sf_dir):
    rows = dealt(spark, sf_dir, texto=DAYS).withColumn("t", E.key(F.col("texto")))
    least = lambda labels, future: F.array_min(DT.labelled_dates(F.col("t"), labels, OFFERS.day, future)).cast("string")
    return rows.select("id", least(TB.PUBLICATION_LABELS, False).alias("publicacion"), least(TB.CLOSING_LABELS, True).alias("cierre"), least(TB.DEADLINE_LABELS, True).alias("plazo"))


TYPES = ("wordpress_post", "listing_page", "general_page", "news_page", "detail_page", "document_page", "ats_external", "wordpress_listing")
TEXTS = (
    "Concurso público: requisitos y funciones, recepción de antecedentes", "Taller de cocina y feria; subsidio, noticia", "Proceso cerrado, nómina de seleccionados", "Convocatoria vigente en curso", "Proceso abierto pero plazo vencido", "Bienvenidos", None,
    "Vacante a honorarios, perfil del cargo y bases; trámite", "Actividad municipal",
)
HEADS = ("Concursos", "Trabaja con Nosotros", "Portal", None, "Licitaciones")
PATHS = ("/trabaje-con-nosotros", "/noticias/1", "/", "/convocatorias/a", "/inicio")
_PUB, _CLO, _DEA = "CASE WHEN id % 3 = 0 THEN NULL ELSE fecha_publicacion END", "CASE WHEN id % 5 = 0 THEN fecha_cierre END", "CASE WHEN id % 11 = 1 THEN fecha_cierre END"


def _offers(spark, sf_dir):
    names = {"tipo": TYPES, "texto": TEXTS, "titulo": HEADS, "ruta": PATHS}
    return A.offers(spark, sf_dir).selectExpr("id", *[f"{picked('id', v)} AS {n}" for n, v in names.items()], f"{_PUB} AS pub", f"{_CLO} AS clo", f"{_DEA} AS dea", "id % 4 = 0 AS bases", "id % 13 = 0 AS jsonld", "id % 17 = 0 AS ats", "id % 19 = 0 AS barrera")


_O = f"(SELECT id, {picked('id', TYPES)} AS tipo, {picked('id', TEXTS)} AS texto, {picked('id', HEADS)} AS titulo, {picked('id', PATHS)} AS ruta, {_PUB} AS pub, {_CLO} AS clo, {_DEA} AS dea, id % 4 = 0 AS bases, id % 13 = 0 AS jsonld, id % 17 = 0 AS ats, id % 19 = 0 AS barrera FROM ofertas)"
_V = f"SELECT *, {sql_count('t', TB.OPEN_SIGNALS)} AS ab, {sql_count('t', TB.EXPIRED_SIGNALS)} AS ce FROM (SELECT *, {sql_key('texto')} AS t FROM {_O})"
_AGED = f"tipo IN ('wordpress_post', 'news_page', 'general_page') AND {D} - pub > 90 AND NOT bases"


@query(f"""SELECT id, CASE WHEN dea < {D} THEN 'expired_confirmed' WHEN dea IS NOT NULL THEN 'open_confirmed' WHEN clo < {D} THEN 'expired_confirmed' WHEN clo IS NOT NULL THEN 'open_confirmed' WHEN ce > 0 AND ab = 0 THEN 'expired_confirmed' WHEN ab > 0 AND ce = 0 THEN 'open_confirmed' WHEN ab > 0 THEN 'manual_review' WHEN {_AGED} THEN 'expired_by_publication_age' ELSE 'unknown_validity' END AS estado,
 CASE WHEN dea < {D} THEN 'only_expired_calls' WHEN dea IS NOT NULL THEN 'has_open_calls' WHEN clo < {D} THEN 'only_expired_calls' WHEN clo IS NOT NULL THEN 'has_open_calls' WHEN ce > 0 AND ab = 0 THEN 'only_expired_calls' WHEN ab > 0 AND ce = 0 THEN 'has_open_calls' WHEN ab > 0 THEN 'unknown_status' WHEN {_AGED} THEN 'no_calls_found' ELSE 'unknown_status' END AS llamados,
 CASE WHEN dea < {D} THEN 'deadline_passed' WHEN dea IS NOT NULL THEN NULL WHEN clo < {D} THEN 'closing_date_passed' WHEN clo IS NOT NULL THEN NULL WHEN ce > 0 AND ab = 0 THEN 'expired_text_signal' WHEN ab > 0 AND ce = 0 THEN NULL WHEN ab > 0 THEN 'manual_review_required' WHEN {_AGED} THEN 'publication_too_old' END AS motivo, ab::INT AS abiertas, ce::INT AS cerradas FROM ({_V})""")
def v14_validity(spark, sf_dir):
    v = E.validity(*[F.col(c) for c in ("tipo", "texto", "pub", "clo", "dea", "bases")], OFFERS.day)
    rows = _offers(spark, sf_dir).select("id", v.alias("v"))
    return rows.select("id", F.col("v.status").alias("estado"), F.col("v.open_calls").alias("llamados"), F.col("v.reason").alias("motivo"), F.col("v.open_signals").cast("int").alias("abiertas"), F.col("v.expired_signals").cast("int").alias("cerradas"))


_SIGNALS = {
    "jobposting_jsonld": "jsonld", "future_deadline": f"dea >= {D}", "closing_metadata": "clo IS NOT NULL", "pdf_bases_or_profile": "bases", "known_ats": "ats", "job_cluster": "good >= 2 OR regexp_matches(u, 'concurso|trabaja|trabaje|empleo|oferta|convocatoria|postul')",
    "listing_only_title": f"ti IN ({', '.join(lit(x) for x in TB.LISTING_TITLES)}) OR (tipo = 'listing_page' AND good < 2)", "negative_cluster": "bad >= 2 OR tipo = 'news_page'", "old_without_open_signal": f"{D} - pub > 90 AND ab = 0 AND dea IS NULL AND clo IS NULL",
    "generic_landing_page": "tipo = 'general_page' AND good = 0", "bot_waf_js": "barrera",
}
_HELD = {n: f"coalesce({c}, FALSE)" for n, c in _SIGNALS.items()}
_SIG = f"SELECT *, {sql_count(chr(40) + 't || ' + chr(39) + ' ' + chr(39) + ' || u' + chr(41), TB.JOB_CLUSTER)} AS good, {sql_count(chr(40) + 't || ' + chr(39) + ' ' + chr(39) + ' || ti' + chr(41), TB.OTHER_CLUSTER)} AS bad FROM (SELECT *, {sql_key('titulo')} AS ti, {sql_key('ruta')} AS u FROM ({_V}))"


@query(f"""SELECT id, round(greatest(0.0, least(1.0, 0.5::DOUBLE + {" + ".join(f"CASE WHEN {c} THEN {TB.SIGNAL_WEIGHTS[n]}::DOUBLE ELSE 0 END" for n, c in _HELD.items())})), 4) AS confianza, array_to_string(list_filter([{", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _HELD.items() if TB.SIGNAL_WEIGHTS[n] > 0)}], lambda x: x IS NOT NULL), ',') AS positivas,
 array_to_string(list_filter([{", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _HELD.items() if TB.SIGNAL_WEIGHTS[n] < 0)}], lambda x: x IS NOT NULL), ',') AS negativas FROM ({_SIG})""")
def v13_signals(spark, sf_dir):
    c = F.col
    pdfs = F.when(c("bases"), F.array(F.lit("/docs/Bases.pdf"))).otherwise(F.array(F.lit("/docs/otro.pdf")))
    rows = _offers(spark, sf_dir).withColumn("v", E.validity(*[c(x) for x in ("tipo", "texto", "pub", "clo", "dea", "bases")], OFFERS.day))
    s = E.signals(c("ruta"), c("titulo"), c("texto"), c("tipo"), c("pub"), c("clo"), c("dea"), c("jsonld"), pdfs, c("ats"), c("barrera"), c("v.open_signals"), OFFERS.day)
    rows = rows.select("id", s.alias("s"))
    return rows.select("id", c("s.confidence").alias("confianza"), F.array_join("s.positive", ",").alias("positivas"), F.array_join("s.negative", ",").alias("negativas"))


PAGES = (
    "<html><head><title>Concursos</title></head><body class=\"home single\"><p>wp-content</p></body></html>", "<article>uno</article><p>WordPress</p>", "<p>WP-JSON</p>", "<article>a</article><article>b</article>", "<a href=\"/x\">x</a>" * 12 + "<li>1</li>" * 8, "<h1>Cargo</h1><p>Requisitos</p>",
    "<h1>Cargo</h1><table><tr></tr></table>", "<h1>Hola</h1><p>nada</p>", "<title> Ofertas  Laborales </title>", "<title>Otra</title><script>var requisitos</script><h1>x</h1>", None, "<script src=\"https://static.buk.cl/a.js\"></script><a href=\"https://x.hiringroom.com/y\">ir</a>",
)
ADDRESSES = ("https://muni.cl/", "https://muni.cl/noticias/1", "https://x.trabajando.cl/ofertas", "https://muni.cl/Bases.PDF", "https://muni.cl/empleos")
CONTENT = ("text/html", "application/pdf", None, "text/html", "text/html", "text/html", "text/html")
SERVERS = ("server:nginx", "link:<https://muni.cl/wp-json/>", None)
_TITLE = "nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '')"
_VISIBLE = "trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\\b.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"


def _n(tag):
    return f"len(regexp_extract_all(html, '(?i)<{tag}\\b'))"


_PG = f"(SELECT *, lower(url) AS u, lower(coalesce(tipo, '')) AS ct, {sql_key('html')} AS b, {sql_key(_TITLE)} AS ti FROM {dealt_sql(html=PAGES, url=ADDRESSES, tipo=CONTENT, servidor=SERVERS)})"


@query(f"""SELECT id, CASE WHEN contains(ct, 'pdf') OR u LIKE '%.pdf' THEN 'document_page' WHEN {sql_any('u', TB.ATS_HOSTS)} THEN 'ats_external' WHEN {sql_any('b', TB.WORDPRESS_MARKERS)} OR {sql_any('u', TB.WORDPRESS_MARKERS)} THEN CASE WHEN {_n('article')} > 0 OR regexp_matches(html, '(?i)<body\\b[^>]*class="[^"]*(single|post-template)') THEN 'wordpress_post' ELSE 'wordpress_listing' END
 WHEN {sql_any('u', TB.NEWS_PATHS)} THEN 'news_page' WHEN {_n('article')} > 1 OR ({_n('a')} >= 12 AND {_n('(?:table|li)')} >= 8) THEN 'listing_page' WHEN {_n('h1')} > 0 AND (regexp_matches({_VISIBLE}, '(?i)requisitos|funciones|remuneraci') OR {_n('table')} > 0) THEN 'detail_page' WHEN ti IN ('concursos', 'trabaja con nosotros', 'ofertas laborales') THEN 'listing_page' ELSE 'general_page' END AS tipo FROM (SELECT * REPLACE (coalesce(html, '') AS html) FROM {_PG})""", cte=False)
def v16_page_type(spark, sf_dir):
    rows = dealt(spark, sf_dir, html=PAGES, url=ADDRESSES, tipo=CONTENT).withColumn("html", F.coalesce("html", F.lit(""))).withColumn("page", M.tree(F.col("html")))
    return rows.select("id", E.page_type(F.col("url"), F.col("tipo"), F.col("html"), F.col("page"), F.lit("generic_site")).alias("tipo"))


@query(f"""SELECT id, CASE WHEN good >= 3 AND bad = 0 THEN 'job_like' WHEN bad >= 3 AND good = 0 THEN 'non_job' WHEN good >= 2 AND bad >= 1 THEN 'mixed' WHEN id % 10 < 5 AND tipo IN ('news_page', 'general_page') THEN 'non_job' ELSE 'uncertain' END AS relevancia FROM (SELECT id, tipo, {sql_count('t', E.JOB_TERMS)} AS good, {sql_count('t', E.OTHER_TERMS)} AS bad FROM (SELECT id, tipo, {sql_key('texto')} AS t FROM {_O}))""")
def v16_relevance(spark, sf_dir):
    confidence = F.when(F.col("id") % 10 < 5, 0.5).otherwise(0.6)
    return _offers(spark, sf_dir).select("id", E.relevance(F.col("texto"), F.col("tipo"), confidence).alias("relevancia"))


_BLOB = """lower(url || chr(10) || coalesce(servidor, '') || chr(10) || array_to_string(regexp_extract_all(html, '(?i)<script\\b[^>]*\\bsrc="([^"]*)"', 1) || regexp_extract_all(html, '(?i)<meta\\b[^>]*>') || regexp_extract_all(html, '(?i)<a\\b[^>]*\\bhref="([^"]*)"', 1), chr(10)))"""


@query(f"""SELECT id, array_to_string(list_filter([CASE WHEN contains(x, 'buk.cl') THEN 'ats_buk' END, CASE WHEN contains(x, 'hiringroom') THEN 'ats_hiringroom' END, CASE WHEN contains(x, 'trabajando.cl') THEN 'ats_trabajando' END, CASE WHEN {sql_any('x', TB.WORDPRESS_MARKERS)} THEN 'cms_wordpress' END], lambda y: y IS NOT NULL), ',') AS pistas FROM (SELECT id, {_BLOB} AS x FROM (SELECT * REPLACE (coalesce(html, '') AS html) FROM {_PG}))""", cte=False)
def v17_runtime_hints(spark, sf_dir):
    rows = dealt(spark, sf_dir, html=PAGES, url=ADDRESSES, servidor=SERVERS).withColumn("page", M.tree(F.col("html")))
    return rows.select("id", F.array_join(E.runtime_hints(F.col("url"), F.col("servidor"), F.col("page")), ",").alias("pistas"))


HOSTS = ("www.empleospublicos.cl", "postulaciones.carabineros.cl", "postulaciones.investigaciones.cl", "ejercito.cl", "x.trabajando.cl", "empresa.buk.cl", "muni.cl", None, "www.bcentral.cl", "muni2.cl", "otra.cl")
MARKS = ("WordPress", "Buk (RRHH)", "HiringRoom", None, "Trabajando CL", "Sitio propio", "usa wp-json")
RUN = ("", "cms_wordpress", "ats_buk,cms_wordpress", "", "")
_PROFILE = (
    "CASE " + " ".join(f"WHEN id IN ({', '.join(map(str, x[2]))}) THEN '{x[0]}|institution_id'" for x in E.PROFILES if x[2]) + " " + " ".join(f"WHEN {sql_any('h', x[1])} THEN '{x[0]}|domain'" for x in E.PROFILES if x[1])
    + " " + " ".join(f"WHEN list_contains(string_split(corrida, ','), '{h}') THEN '{n}|runtime'" for h, n in E.HINTS) + " " + " ".join(f"WHEN {sql_any('p', x[3])} THEN '{x[0]}|override'" for x in E.PROFILES if x[3]) + " ELSE 'generic_site|fallback' END"
)


@query(f"SELECT id, {_PROFILE} AS perfil FROM (SELECT *, lower(coalesce(host, '')) AS h, lower(coalesce(marca, '')) AS p FROM {dealt_sql('c_custkey', 'customer', host=HOSTS, marca=MARKS, corrida=RUN)})", cte=False)
def j11_profile_cascade(spark, sf_dir):
    rows = dealt(spark, sf_dir, "c_custkey", "customer", host=HOSTS, marca=MARKS, corrida=RUN)
    p = E.profile(F.col("id"), F.col("host"), F.col("marca"), F.split("corrida", ","))
    return rows.select("id", F.concat_ws("|", p["profile"], p["matched_by"]).alias("perfil"))


_AV = ("ok", "ok", "ok", "js_required", "ok", "timeout", "ok", "http_404", "ok", "ok", "ok")
_RL, _VL, _CF = ("job_like", "uncertain", "non_job", "mixed"), ("unknown_validity", "expired_by_publication_age", "open_confirmed", "expired_confirmed", "unknown_validity"), ("0.9", "0.7", "0.5", "0.3", "0.81", "0.79")
_PR = tuple(x[0] for x in E.PROFILES)


def _prop(at):
    say = lambda v: lit(v) if isinstance(v, str) else str(v)
    return "CASE perfil " + " ".join(f"WHEN '{x[0]}' THEN {say(x[at])}" for x in E.PROFILES) + " END"


_ROUTE = {
    "extractor": ("'scraper_playwright'", "NULL", "'scraper_pdf_jobs'", "'scraper_external_ats'", "'scraper_empleos_publicos'", "CASE WHEN rl = 'non_job' THEN 'scraper_wordpress_news_filter' ELSE 'scraper_wordpress_jobs' END", "CASE WHEN rl = 'non_job' THEN 'scraper_wordpress_news_filter' ELSE 'scraper_wordpress_jobs' END", "pista", "pista", "pista", "pista", "pista"),
    "decision": ("CASE WHEN s THEN 'extract' ELSE 'manual_review' END", "'source_status_only'", "'extract'", "CASE WHEN s THEN 'extract' ELSE 'manual_review' END", "'extract'", "'skip'", "CASE WHEN s THEN 'extract' ELSE 'manual_review' END", "'skip'", "'manual_review'", "'extract'", "'manual_review'", "'skip'"),
    "motivo": ("CASE WHEN NOT s THEN 'manual_review_required' END", "av", "NULL", "CASE WHEN NOT s THEN 'manual_review_required' END", "NULL", "CASE WHEN rl = 'non_job' THEN 'not_job_related' ELSE 'publication_too_old' END", "CASE WHEN NOT s THEN 'manual_review_required' END", "'only_expired_calls'", "'listing_without_offer_detail'", "NULL", "'manual_review_required'", "'no_matching_extractor'"),
}
_WHEN = ("av = 'js_required' AND js", "av <> 'ok'", "pg = 'document_page' AND pdf", "pg = 'ats_external' OR pista = 'scraper_external_ats'", "perfil = 'empleos_publicos'", "pg LIKE 'wordpress%' AND (rl = 'non_job' OR vl = 'expired_by_publication_age')", "pg LIKE 'wordpress%'", "vl = 'expired_confirmed'", "pg = 'listing_page' AND NOT s", "s", "q >= bajo")


@query("SELECT id, " + ", ".join("CASE " + " ".join(f"WHEN {w} THEN {v}" for w, v in zip(_WHEN, vs)) + f" ELSE {vs[-1]} END AS {n}" for n, vs in _ROUTE.items()) + f" FROM (SELECT *, q >= alto AS s FROM (SELECT *, {_prop(4)} AS pista, {_prop(5)}::DOUBLE AS alto, {_prop(6)}::DOUBLE AS bajo, {_prop(7)} AS js, {_prop(8)} AS pdf, cf::DOUBLE AS q FROM {dealt_sql('event_id', 'events', perfil=_PR, av=_AV, pg=TYPES, rl=_RL, vl=_VL, cf=_CF)}))", cte=False)
def v19_routing(spark, sf_dir):
    rows = dealt(spark, sf_dir, "event_id", "events", perfil=_PR, av=_AV, pg=TYPES, rl=_RL, vl=_VL, cf=_CF)
    c = F.col
    x = E.select_extractor(c("perfil"), c("av"), c("pg"), c("rl"), c("vl"), c("cf").cast("double"), E.of_profile(c("perfil"), 5), E.of_profile(c("perfil"), 6))
    rows = rows.select("id", x.alias("x"))
    return rows.select("id", c("x.extractor").alias("extractor"), c("x.decision").alias("decision"), c("x.reason").alias("motivo"))


SOURCE = {
    "plataforma": ("WordPress", "Trabajando.cl/OMIL", "HiringRoom", "Buk (RRHH)", "Sitio propio Joomla", "Portal de Transparencia", "SPA JavaScript", "Drupal", None, "", "PHP propio"),
    "url": ("https://a.cl", None, "", "https://b.cl"), "sitio": ("https://a.cl", "", None), "sector": ("Municipal", "Salud", None), "verificado": ("Verificado", "pendiente", None, "verificado", "no"), "publica": ("No", "Sí", "Parcialmente", None, "No", "No", "No"), "js": ("No", "No", "Sí", None, "no", "No", "No", "No", "No", "No", "No", "No", "No"),
}
_ST = [
    ("trim(coalesce(url, '')) = '' AND trim(coalesce(sitio, '')) = ''", "'broken'", "skip", "'validated'", "'sin url_empleo ni sitio_web'"),
    (f"{sql_key('js')} IN ('si', 'yes', 'true', '1') OR {sql_any('p', ('spa', 'vue', 'react', 'javascript'))}", "'js_required'", "skip", "'validated'", "'requiere navegador con JS'"),
    ("ep = 'si'", "'active'", "empleos_publicos", "'validated'", "'cubierto por empleospublicos.cl batch'"),
    (sql_any("p", ("trabajando.cl", "trabajando cl")), "CASE WHEN ok THEN 'active' ELSE 'experimental' END", "custom_trabajando", "CASE WHEN ok THEN 'validated' ELSE 'medium' END", "'portal trabajando.cl'"),
    ("contains(p, 'hiringroom')", "CASE WHEN ok THEN 'active' ELSE 'experimental' END", "custom_hiringroom", "CASE WHEN ok THEN 'validated' ELSE 'medium' END", "'portal HiringRoom'"),
    ("contains(p, 'buk')", "CASE WHEN ok THEN 'active' ELSE 'experimental' END", "custom_buk", "CASE WHEN ok THEN 'validated' ELSE 'medium' END", "'portal Buk'"),
    ("contains(p, 'wordpress')", "CASE WHEN ok THEN 'active' ELSE 'experimental' END", "wordpress", "CASE WHEN ok THEN 'validated' ELSE 'medium' END", "'WordPress' || CASE WHEN ok THEN ' verificado' ELSE ' sin verificar' END"),
    (f"{sql_any('p', ('sitio propio', 'portal propio', 'cms', 'joomla', 'php', 'transparen'))} AND ok", "'active'", "generic", "'validated'", "'sitio propio verificado manualmente'"),
    (f"{sql_any('p', ('sitio propio', 'portal propio', 'cms', 'joomla', 'php', 'transparen'))}", "'manual_review'", "generic", "'low'", "CASE WHEN trim(coalesce(sector, '')) = 'Municipal' THEN 'municipio con sitio propio sin verificar' ELSE 'sitio propio sin verificar' END"),
    ("p <> ''", "'manual_review'", "skip", "'low'", "'plataforma sin módulo dedicado: ' || p"), ("TRUE", "'disabled'", "skip", "'low'", "'sin plataforma declarada'"),
]
_STC = ", ".join("CASE " + " ".join(f"WHEN {r[0]} THEN {lit(r[i]) if i == 2 else r[i]}" for r in _ST) + f" END AS {n}" for i, n in ((1, "status"), (2, "kind"), (3, "confianza"), (4, "motivo")))
V21 = f"SELECT id, {_STC}, ep IN ('si', 'parcialmente') AS central FROM (SELECT *, {sql_key('plataforma')} AS p, {sql_key('publica')} AS ep, coalesce({sql_key('verificado')} = 'verificado', FALSE) AS ok FROM {dealt_sql('c_custkey', 'customer', **SOURCE)})"


def _sources(spark, sf_dir):
    rows = dealt(spark, sf_dir, "c_custkey", "customer", **SOURCE)
    return rows.withColumn("s", E.source_status(*[F.col(c) for c in ("plataforma", "url", "sitio", "sector", "verificado", "publica", "js")]))


@query(V21, cte=False)
def v21_source_status(spark, sf_dir):
    return _sources(spark, sf_dir).select("id", "s.status", "s.kind", F.col("s.confidence").alias("confianza"), F.col("s.reason").alias("motivo"), F.col("s.central").alias("central"))


KINDS = ("custom_trabajando", "generic", "custom_policia", "custom_ffaa", "custom_buk", "wordpress", "custom_hiringroom", "skip")
STATES = ("active", "active", "active", "manual_review", "active")
_BY = "CASE WHEN estado = 'active' THEN CASE WHEN kind = 'custom_policia' AND id = 161 THEN 'scraper_pdf_jobs|carabineros_pdf_first' WHEN kind = 'custom_policia' AND id = 162 THEN 'scraper_pdf_jobs|pdi_pdf_first' " + " ".join(f"WHEN kind = '{k}' THEN '{e}|{p}'" for k, e, p in E.BYPASS) + " END END"


@query(f"""SELECT id, b AS desvio, CASE WHEN extractor = 'scraper_playwright' THEN 'source_status_only' ELSE 'extract' END AS decision, CASE WHEN extractor = 'scraper_playwright' THEN 'playwright_runtime_unavailable' END AS motivo FROM (SELECT id, {_BY} AS b, CASE WHEN id % 3 = 0 THEN 'scraper_playwright' ELSE 'scraper_generic_fallback' END AS extractor
 FROM (SELECT 150 + id % 20 AS id0, * REPLACE (CASE WHEN id % 4 = 0 THEN 161 WHEN id % 4 = 1 THEN 162 ELSE id END AS id) FROM {dealt_sql('c_custkey', 'customer', kind=KINDS, estado=STATES)}))""", cte=False)
def v25_bypass(spark, sf_dir):
    i = F.col("id")
    rows = dealt(spark, sf_dir, "c_custkey", "customer", kind=KINDS, estado=STATES).withColumn("id", F.when(i % 4 == 0, 161).when(i % 4 == 1, 162).otherwise(i))
    b = E.bypass(F.col("id"), F.col("estado"), F.col("kind"))
    x = E.demoted(F.when(F.col("id") % 3 == 0, "scraper_playwright").otherwise("scraper_generic_fallback"), F.lit("extract"), F.lit(None).cast("string"), can_render=False)
    return rows.select("id", F.when(b.isNotNull(), F.concat_ws("|", b["extractor"], b["profile"])).alias("desvio"), x["decision"].alias("decision"), x["reason"].alias("motivo"))


@query()
def v20_source_evaluation(spark, sf_dir):
    """The whole cascade over the pages table; tests hold it against fixed pages."""
    pages = A.spread(A.read(spark, sf_dir, "pages").select("page_id", "url", "html"), "page_id").select(
        F.col("page_id").alias("id"), F.lit(None).cast("string").alias("platform"), "url", F.col("url").alias("final_url"), F.lit(200).alias("status"), F.lit(None).cast("string").alias("error"), F.lit("text/html").alias("content_type"), F.lit(None).cast("string").alias("headers"), "html",
    )
    history = A.read(spark, sf_dir, "pages").select(F.col("page_id").alias("id")).select("id", (F.col("id") % 40).alias("sample"), (F.col("id") % 11 / 10).alias("precision"), (F.col("id") % 7 / 6).alias("recall"))
    out = E.evaluate(pages, OFFERS.today, noise=F.when(F.col("id") % 2 == 0, 0.4).otherwise(0.0), history=history)
    return out.withColumns({c: F.col(c).cast("string") for c in ("published", "closes", "deadline")})


@query(f"""SELECT id, CASE WHEN id % 29 = 0 THEN 'eventual' WHEN status <> 'active' THEN 'exploratory' WHEN kind = 'empleos_publicos' THEN 'critical' WHEN contains(lower(coalesce(sector, '')), 'municip') THEN 'low' WHEN kind IN ('custom_trabajando', 'custom_hiringroom', 'custom_buk') THEN 'high' WHEN kind IN ('generic', 'wordpress') AND central THEN 'low' ELSE 'medium' END AS tier FROM (SELECT s.*, f.sector FROM ({V21}) s JOIN {dealt_sql('c_custkey', 'customer', sector=SOURCE['sector'])} f USING (id))""", cte=False)
def v22_frequency_tier(spark, sf_dir):
    override = F.when(F.col("id") % 29 == 0, " Eventual ").when(F.col("id") % 31 == 0, "nunca")
    return _sources(spark, sf_dir).select("id", P.tier(F.col("s.status"), F.col("s.kind"), F.col("sector"), F.coalesce("s.central", F.lit(False)), override).alias("tier"))

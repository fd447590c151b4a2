"""The rule engine of pages, its fallback, the pipeline, and the quality validator of postings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plazamill.context import OFFERS
from plazamill.functions import money as M
from plazamill.functions import tables as TB
from plazamill.functions.lookups import contains_any
from plazamill.operators import evaluation as E
from plazamill.operators import page_rules as PR
from plazamill.operators import rules as R
from plazamill.sources import adapters as A

from .base import lit, picked, query, sql_any
from .labels import KEY, dealt, dealt_sql
from .listing import D
from .pages import sql_key
from .scalars import sql_fold

PAGE = {
    "title": ("Concurso público: Cargo Analista", "Noticias del mes", "Trabaja con nosotros", "Resultados del concurso", "Seminario anual", None, "Portal"),
    "crumbs": ("Inicio > Concursos", "Inicio > Prensa", "", None, "Inicio"),
    "hint": ("", None, "blog"),
    "body": (
        "Se requiere contratar. Requisitos:\nTítulo de contador público\nDos años de experiencia\nFunciones:\nLlevar la contabilidad\nRenta bruta mensual $ 1.200.000, contrata. Fecha de cierre: postulaciones hasta 15/06/1998. Enviar antecedentes a rrhh@muni.cl",
        "Comunicado: proceso cerrado, nómina de seleccionados 1993", "La vacante a honorarios, jornada completa; bases y perfil de cargo. Postulaciones hasta el 01/02/1998", "Agenda institucional y galería de fotos", "", None,
        "Concurso 1994 archivo histórico", "Evento y charla sobre licitación pública", "Cargo: auxiliar. Postular enviando CV a x@y.cl con requisitos y funciones", "llamado a postulación 1998 vigente, planta y suplencia, reemplazo, cierre de postulación",
    ),
    "tables": ("", "Cargo Renta Cierre", None),
    "attachments": ("", "Bases del concurso y perfil de cargo", None, ""),
    "url": ("https://muni.cl/concursos/1", "https://muni.cl/noticias/2", "https://muni.cl/x", "https://muni.cl/rrhh/blog/3", "https://muni.cl/trabaja-con-nosotros"),
}
_HTTP = "CASE WHEN o_orderkey % 23 = 0 THEN 404 WHEN o_orderkey % 29 = 0 THEN NULL ELSE 200 END"


def _pages(spark, sf_dir):
    rows = A.spread(A.read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey").selectExpr("o_orderkey AS id", *[f"{picked('o_orderkey', v)} AS {n}" for n, v in PAGE.items()], f"{_HTTP} AS http_status")
    return rows.withColumn("files", F.when(F.col("id") % 4 == 1, F.array(F.lit("https://muni.cl/docs/bases.pdf"))).otherwise(F.array().cast("array<string>"))).withColumn("headings", F.array(F.lit("Inicio"), F.lit("Llamado abierto")))


_BASE = f"(SELECT o_orderkey AS id, {', '.join(f'{picked(KEY, v)} AS {n}' for n, v in PAGE.items())}, {_HTTP} AS http_status FROM orders)"
_TARGET = {"text": "txt", "url": "u", "tables": "tb"}
_GOOD, _BAD = PR.positive_rules(), PR.negative_rules()
_q = lambda p: p.replace("'", "''")
_G = "[" + ", ".join(f"regexp_matches({_TARGET[r[4]]}, '{_q(r[1])}')::INT" for r in _GOOD) + "]"
_B = "[" + ", ".join(f"regexp_matches({_TARGET[r[4]]}, '{_q(r[1])}')::INT" for r in _BAD) + "]"
_W = lambda rules: "[" + ", ".join(str(r[2]) for r in rules) + "]"
_R = lambda rules: "[" + ", ".join(lit(r[3]) for r in rules) + "]"
_ESS = {n: "greatest(" + ", ".join(f"g[{i + 1}]" for i in at) + ", 0)" for n, at in PR.vouched().items()}
_OLD, _NOW = PR.years(OFFERS.today)
_TXT = "lower(concat_ws(chr(10), coalesce(title, ''), coalesce(crumbs, ''), coalesce(hint, ''), coalesce(body, ''), coalesce(tables, ''), coalesce(attachments, '')))"
_C1 = f"SELECT *, {_G} AS g, {_B} AS b FROM (SELECT *, {_TXT} AS txt, lower(coalesce(url, '')) AS u, lower(coalesce(tables, '')) AS tb FROM {_BASE})"
_C2 = f"SELECT *, {' + '.join(_ESS.values())} AS ess, regexp_matches(lower(concat_ws(chr(10), coalesce(url, ''), coalesce(title, ''), coalesce(crumbs, ''), coalesce(hint, ''))), '{PR.NEWS}') AND {_ESS['deadline']} = 0 AS news FROM ({_C1})"
_C3 = f"""SELECT *, round(greatest(0.0, least(1.0, 0.5::DOUBLE + list_sum(list_transform(generate_series(1, {len(_GOOD)}), lambda i: g[i] * {_W(_GOOD)}[i]))::DOUBLE + list_sum(list_transform(generate_series(1, {len(_BAD)}), lambda i: b[i] * {_W(_BAD)}[i]))::DOUBLE - CASE WHEN ess = 0 THEN 0.25 ELSE 0 END - CASE WHEN news THEN 0.22 ELSE 0 END)), 6) AS s0,
 coalesce(http_status >= 400, FALSE) AS broken, regexp_matches(txt, '{_OLD}') AND NOT regexp_matches(txt, '{_NOW}') AS hist FROM ({_C2})"""
_OTHER = "CASE " + " ".join(f"WHEN regexp_matches(coalesce(url, '') || ' ' || txt, '{p}') THEN '{k}'" for p, k in PR.OTHER_KINDS) + " ELSE 'informational_page' END"
_C4 = f"""SELECT *, CASE WHEN broken THEN 0.0 ELSE s0 END AS score, CASE WHEN broken THEN 1.0 WHEN hist THEN 0.95 ELSE s0 END AS confidence, NOT broken AND NOT hist AND s0 >= 0.80 AND ess >= 2 AS is_job,
 CASE WHEN broken THEN 'broken_page' WHEN hist THEN 'historical_archive' WHEN s0 >= 0.80 AND ess >= 2 THEN CASE WHEN contains(txt, 'concurso') THEN 'public_competition' ELSE 'job_posting' END WHEN s0 >= 0.80 THEN 'informational_page' WHEN s0 >= 0.55 THEN 'unknown' ELSE {_OTHER} END AS kind,
 CASE WHEN broken THEN 'http_status=' || http_status::VARCHAR WHEN hist THEN 'publicación histórica sin vigencia actual' WHEN s0 >= 0.80 AND ess >= 2 THEN NULL WHEN s0 >= 0.80 THEN 'faltan señales esenciales mínimas' WHEN s0 >= 0.55 THEN 'zona ambigua' ELSE 'score bajo por reglas' END AS why,
 list_transform(list_filter(generate_series(1, {len(_GOOD)}), lambda i: g[i] = 1), lambda i: {_R(_GOOD)}[i]) AS hits, list_transform(list_filter(generate_series(1, {len(_BAD)}), lambda i: b[i] = 1), lambda i: {_R(_BAD)}[i]) || CASE WHEN ess = 0 THEN ['ausencia total de cargo/requisitos/fechas'] ELSE [] END || CASE WHEN news THEN ['contexto noticioso sin fecha de cierre verificable'] ELSE [] END || CASE WHEN hist AND NOT broken THEN ['aviso antiguo detectado'] ELSE [] END AS misses FROM ({_C3})"""


@query(f"SELECT id, is_job AS es_aviso, kind AS tipo, score::DOUBLE AS puntaje, ess::INT AS esenciales, why AS motivo, md5(array_to_string(hits, '|') || '#' || array_to_string(misses, '|')) AS traza FROM ({_C4})", cte=False)
def v08_rule_engine(spark, sf_dir):
    out = PR.classified(_pages(spark, sf_dir), OFFERS.today)
    trace = F.md5(F.concat(F.array_join("hits", "|"), F.lit("#"), F.array_join("misses", "|")))
    return out.select("id", F.col("is_job").alias("es_aviso"), F.col("kind").alias("tipo"), F.col("score").alias("puntaje"), F.col("essential").cast("int").alias("esenciales"), F.col("why").alias("motivo"), trace.alias("traza"))


@query(f"SELECT id, regexp_matches(t, '\\b(1992|1993|1994|1995|1996)\\b') AND NOT regexp_matches(t, '\\b(1997|1998|1999|vigente|abierto|postulaciones hasta|en curso)\\b') AS historico FROM (SELECT id, lower(coalesce(texto, '')) AS t FROM {dealt_sql(texto=('Concurso 1993', 'Proceso 1996 abierto', '1991', 'año 1992 y 1998', '19930', None, 'Bases 1995. EN CURSO', '1994'))})", cte=False)
def v09_historical_years(spark, sf_dir):
    rows = dealt(spark, sf_dir, texto=("Concurso 1993", "Proceso 1996 abierto", "1991", "año 1992 y 1998", "19930", None, "Bases 1995. EN CURSO", "1994"))
    return rows.select("id", PR.historical(F.lower(F.coalesce("texto", F.lit(""))), OFFERS.today).alias("historico"))


_C5 = f"""SELECT *, (score >= 0.55 AND score < 0.80) OR (len(hits) > 0 AND len(misses) > 0 AND score >= 0.40 AND kind IN ('unknown', 'news_article', 'informational_page')) AS asked, regexp_matches(lower(substring(coalesce(body, ''), 1, 1600)), 'cargo|postulación|requisitos|funciones') AS jg, regexp_matches(lower(substring(coalesce(body, ''), 1, 1600)), 'noticia|comunicado|evento|resultados') AS jb FROM ({_C4})"""


@query(f"SELECT id, asked AS consultado, CASE WHEN asked THEN jg OR NOT jb ELSE is_job END AS es_aviso, CASE WHEN asked THEN CASE WHEN jg OR NOT jb THEN 'job_posting' ELSE 'news_article' END ELSE kind END AS tipo, (CASE WHEN asked THEN greatest(confidence, 0.62) ELSE confidence END)::DOUBLE AS confianza FROM ({_C5})", cte=False)
def v10_fallback(spark, sf_dir):
    out = PR.resolved(_pages(spark, sf_dir), OFFERS.today)
    return out.select("id", F.col("asked").alias("consultado"), F.col("is_job").alias("es_aviso"), F.col("kind").alias("tipo"), F.col("confidence").alias("confianza"))


@query()
def v12_page_pipeline(spark, sf_dir):
    """The composed pipeline; its parts have their SQL (v08, v10, l07, l09, l10, l11, l12, n03, v11), tests hold the whole."""
    out = PR.pipeline(_pages(spark, sf_dir), OFFERS.today)
    return out.select("id", "is_job", "kind", "rejected", F.array_join("missing", ",").alias("missing"), "job_title", "amount", "contract", F.col("ends").cast("string").alias("ends"), "quality", "review")


_KINDS = ("job_posting", "news_article", "public_competition", "informational_page", "results_page", "event", "historical_archive", "unknown")
_WHY = (None, "explicit_closed_signal", "application_end_at_in_past", None, None)
_SURE = ("low", "medium", "high")
_CONF = ("0.9", "0.62", "0.3", "0.81", "1.0")
_F = [f"id % {m} <> 0" for m in (2, 3, 5, 7, 4, 6)]


@query(f"""SELECT id, CASE WHEN tipo IN ('results_page', 'historical_archive', 'news_article', 'event') THEN 'content_type=' || tipo WHEN porque IS NOT NULL THEN porque WHEN id % 9 = 0 THEN 'expired' WHEN tipo = 'informational_page' AND NOT id % 10 = 3 THEN 'informational_non_posting' END AS vencido,
 array_to_string(list_filter([CASE WHEN NOT {_F[0]} THEN 'title' END, CASE WHEN NOT ({_F[1]} OR {_F[2]}) THEN 'functions_or_requirements' END, CASE WHEN NOT ({_F[3]} OR {_F[4]}) THEN 'salary_or_contract' END, CASE WHEN NOT ({_F[5]} OR id % 8 = 1) THEN 'documents_or_attachments' END], lambda x: x IS NOT NULL), ',') AS faltan,
 p AS puntaje, p < 0.60 OR id % 11 = 5 AS revisar FROM (SELECT *, round(greatest(0.0, least(1.0, cf::DOUBLE * 0.30 + ({" + ".join(f"({x})::INT" for x in _F)}) / 6.0::DOUBLE * 0.25 + CASE seguridad WHEN 'high' THEN 0.95 WHEN 'medium' THEN 0.65 ELSE 0.35 END::DOUBLE * 0.20 + CASE WHEN {_F[3]} THEN 0.85 ELSE 0.25 END::DOUBLE * 0.10 + CASE WHEN {_F[2]} THEN 0.85 ELSE 0.25 END::DOUBLE * 0.15 - CASE WHEN tipo IN ('news_article', 'results_page') THEN 0.2 ELSE 0 END)), 4) AS p FROM {dealt_sql(tipo=_KINDS, porque=_WHY, seguridad=_SURE, cf=_CONF)})""", cte=False)
def v11_completeness_score(spark, sf_dir):
    c, f = F.col, [F.expr(x) for x in _F]
    rows = dealt(spark, sf_dir, tipo=_KINDS, porque=_WHY, seguridad=_SURE, cf=_CONF)
    some = lambda x: F.when(x, F.array(F.lit("a b"))).otherwise(F.array().cast("array<string>"))
    past = PR.expiry(c("tipo"), c("id") % 10 == 3, c("porque").isNotNull() | (c("id") % 9 == 0), c("porque"))
    gaps = PR.missing(F.when(f[0], "x"), some(f[1]), some(f[2]), F.when(f[3], 1), F.when(f[4], "planta"), some(f[5]), some(c("id") % 8 == 1))
    q = PR.quality_score(c("cf").cast("double"), c("tipo"), c("id") % 11 == 5, f, f[3], f[2], c("seguridad"))
    return rows.select("id", past.alias("vencido"), F.array_join(gaps, ",").alias("faltan"), q["score"].alias("puntaje"), q["review"].alias("revisar"))


CALLS = (
    "Publicado: 01/03/1998. Inicio de postulación 02/03/1998. Plazo de postulación: 15/07/1998", "Hasta el 15/05/1998 por correo", "Cierre de postulación: proceso finalizado", "publicación 05/2023; hasta el 01/02/2023", "desde el 10-06-1998 hasta el 20-06-1998", "nada", None,
    "postulaciones hasta el viernes", "Fecha de publicación: 1998-04-05\nRecepción de antecedentes hasta 1998-06-30",
)
_PD = ("([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})", "([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})", "([0-9]{1,2})-([0-9]{1,2})-([0-9]{4})", "([0-9]{1,2})\\.([0-9]{1,2})\\.([0-9]{4})")


def _sql_first_date(x: str) -> str:
    one = lambda p, y, m, d: f"list_filter(list_transform(regexp_extract_all({x}, '\\b{p}\\b'), lambda w: CAST(try_strptime(regexp_extract(w, '{p}', {y}) || '-' || regexp_extract(w, '{p}', {m}) || '-' || regexp_extract(w, '{p}', {d}), '%Y-%m-%d') AS DATE)), lambda w: w IS NOT NULL)[1]"
    return "coalesce(" + ", ".join(one(p, *((1, 2, 3) if i == 0 else (3, 2, 1))) for i, p in enumerate(_PD)) + ")"


_TAB = ("", "Plazo de postulación: 10/08/1998", None)
_PIECES = {k: f"(?i){p}" for k, p in PR.CALL_DATES.items()}
_FIRST = lambda k: "coalesce(" + ", ".join(f"list_filter(list_transform(regexp_extract_all({t}, '{_PIECES[k]}'), lambda z: {_sql_first_date('z')}), lambda z: z IS NOT NULL)[1]" for t in ("tb", "bd")) + ")"
_SAID = "lower(array_to_string(" + " || ".join(f"regexp_extract_all({t}, '{p}')" for p in _PIECES.values() for t in ("bd", "tb")) + ", ' '))"


@query(f"""SELECT id, CAST(p AS VARCHAR) AS publicado, CAST(a AS VARCHAR) AS desde, CAST(c AS VARCHAR) AS hasta, CASE WHEN viejo OR shut THEN TRUE ELSE c < {D} END AS vencido, CASE WHEN viejo THEN 'historical_year_without_current_signals' WHEN shut THEN 'explicit_closed_signal' WHEN c < {D} THEN 'application_end_at_in_past' END AS motivo, CASE WHEN viejo THEN 'medium' WHEN shut OR c IS NOT NULL THEN 'high' ELSE 'low' END AS seguridad
 FROM (SELECT id, {_FIRST('published')} AS p, {_FIRST('start')} AS a, {_FIRST('end')} AS c, regexp_matches({_SAID}, '\\b(2020|2021|2022|2023|2024)\\b') AND NOT regexp_matches({_SAID}, '\\b2025|2026|vigente|abierto|en proceso\\b') AS viejo, regexp_matches({_SAID}, '{PR.CLOSED}') AS shut FROM (SELECT id, coalesce(texto, '') AS bd, coalesce(tabla, '') AS tb FROM {dealt_sql(texto=CALLS, tabla=_TAB)}))""", cte=False)
def d07_call_dates(spark, sf_dir):
    d = PR.call_dates(F.col("texto"), F.col("tabla"), F.lit(""), OFFERS.day)
    rows = dealt(spark, sf_dir, texto=CALLS, tabla=_TAB).select("id", d.alias("d"))
    return rows.select("id", *[F.col(f"d.{a}").cast("string").alias(b) for a, b in (("published", "publicado"), ("start", "desde"), ("stop", "hasta"))], F.col("d.expired").alias("vencido"), F.col("d.why").alias("motivo"), F.col("d.sure").alias("seguridad"))


# --- the quality validator

FIELDS = {
    "cargo": ("Analista contable", "Concursos", "Feria", "Taller de capacitación", None, "Jefe de obras", "Licitaciones", "Abogada", "  ", "Chofer", "Auxiliar"), "descripcion": ("Detalle del cargo, renta mensual", "Subsidio y beneficio", None, "renta anual de la planta", "mensual y anual", "Noticia del día", "aviso", "texto"),
    "bases": ("https://www.empleospublicos.cl/documentos/PoliticaPrivacidad.pdf", None, "https://x.cl/b.pdf", "", "https://x.cl/c.pdf"), "correo": ("a@b.cl", None, None), "contacto": ("c@d.cl", "c@d.cl", None, ""),
}
_X = {n: picked("id", v) for n, v in FIELDS.items()}
_EST = "CASE WHEN id % 3 = 0 THEN 'Activo' WHEN id % 3 = 1 THEN 'cerrada' ELSE NULL END"
_ROWS = f"SELECT id, institucion_id AS inst, institucion_nombre AS nombre, url_oferta AS url, fecha_publicacion AS pub, fecha_cierre AS cie, renta_bruta_min / 4 AS rmin, renta_bruta_max * 3 AS rmax, activa, {_EST} AS estado, {', '.join(f'{e} AS {n}' for n, e in _X.items())} FROM ofertas"
_K = f"SELECT *, {sql_key('cargo')} AS c, {sql_key('nombre')} AS nk, {sql_key('descripcion')} AS d, coalesce(nullif({sql_key('estado')}, ''), CASE WHEN activa THEN 'activo' ELSE '' END) AS e, {sql_fold('descripcion')} AS u FROM ({_ROWS})"
_UNIT = "CASE WHEN regexp_matches(u, 'mensual|mes') AND regexp_matches(u, 'anual|ano') THEN 'mixed' WHEN regexp_matches(u, 'mensual|mes') THEN 'mensual' WHEN regexp_matches(u, 'anual|ano') THEN 'anual' END"
#: Condition (over the folded columns), reason, penalty; every one that holds counts, in this order.
CHECKS = [
    ("c = ''", "extractor_failed_validation", 0.5), ("nk = '' AND inst IS NULL", "invalid_institution_reference", 0.5), ("url IS NULL", "missing_publishable_url", 0.6), ("cie IS NULL AND NOT e IN ('activo', 'vigente', 'abierto')", "missing_validity_signal", 0.6),
    ("inst IS NOT NULL AND NOT conocida", "invalid_institution_reference", 0.7), ("portada", "listing_page_only", 0.8), ("ajena", "not_job_related", 0.7), ("lower(trim(bases)) = 'https://www.empleospublicos.cl/documentos/politicaprivacidad.pdf'", "placeholder_bases_url", 0.8),
    ("cie < pub", "extractor_failed_validation", 0.5), (f"cie < {D} AND e = 'activo'", "stale_active_offer", 0.8), (f"cie < {D} AND e <> 'activo'", "closing_date_passed", 0.8), ("rmax > 15000000 OR rmax < 250000", "salary_outlier", 0.7),
    ("(rmax IS NULL OR rmax BETWEEN 250000 AND 15000000) AND rmin < 250000", "salary_outlier", 0.4), ("unidad = 'mixed'", "salary_unit_inconsistent", 0.4), ("unidad = 'anual' AND rmax < 12000000", "salary_outlier", 0.3),
    ("coalesce(correo, '') = '' AND coalesce(contacto, '') <> ''", "contact_channel_ambiguous", 0.2), ("repetida", "duplicate_candidate", 0.7),
]
REJECT = ["placeholder_bases_url", "invalid_institution_reference", "stale_active_offer", "listing_page_only", "not_job_related", "closing_date_passed", "missing_publishable_url"]
REVIEW = ["salary_outlier", "duplicate_candidate", "extractor_failed_validation", "missing_validity_signal", "salary_unit_inconsistent", "contact_channel_ambiguous"]
_FP = "sha1(coalesce(inst::VARCHAR, nombre, '') || '|' || c || '|' || coalesce(cie::VARCHAR, ''))"
_SQLV = f"""SELECT *, inst IN (SELECT id FROM instituciones WHERE activa) AS conocida, c IN ({', '.join(lit(x) for x in TB.LANDING_TITLES)}) AS portada, {sql_any("(c || ' ' || d)", TB.NOT_JOB_MARKERS)} AS ajena, {_UNIT} AS unidad, row_number() OVER (PARTITION BY {_FP} ORDER BY id) > 1 AS repetida FROM ({_K})"""


@query(f"""SELECT id, CASE WHEN r[1].a IN ({", ".join(repr(x) for x in REJECT)}) THEN 'reject' WHEN r[1].a IN ({", ".join(repr(x) for x in REVIEW)}) THEN CASE WHEN s >= 0.35 THEN 'review' ELSE 'reject' END ELSE 'publish' END AS decision, r[1].a AS primera, array_to_string(list_transform(r, lambda x: x.a), ',') AS motivos, greatest(0.0, s) AS puntaje
 FROM (SELECT id, r, round(1.0 - coalesce(list_sum(list_transform(r, lambda x: x.b)), 0)::DOUBLE, 4) AS s FROM (SELECT id, list_filter([{", ".join(f"CASE WHEN {c} THEN {{'a': '{n}', 'b': {p}}} END" for c, n, p in CHECKS)}], lambda x: x IS NOT NULL) AS r FROM ({_SQLV})))""")
def v07_quality_validator(spark, sf_dir):
    rows = A.offers(spark, sf_dir).selectExpr(
        "id", "institucion_id AS inst", "institucion_nombre AS nombre", "url_oferta AS url", "fecha_publicacion AS pub", "fecha_cierre AS cie", "renta_bruta_min / 4 AS rmin", "renta_bruta_max * 3 AS rmax", "activa", f"{_EST} AS estado", *[f"{e} AS {n}" for n, e in _X.items()]
    )
    rows = rows.withColumns({"c": E.key(F.col("cargo")), "nk": E.key(F.col("nombre")), "d": E.key(F.col("descripcion")), "e": F.coalesce(F.nullif(E.key(F.col("estado")), F.lit("")), F.when(F.col("activa"), "activo").otherwise("")), "unidad": M.unit(F.col("descripcion"))})
    known = A.institutions(spark, sf_dir).where("activa").select(F.col("id").alias("known"))
    rows = rows.join(known, F.col("inst") == F.col("known"), "left").withColumn("conocida", F.col("known").isNotNull())
    print_ = F.sha1(F.concat_ws("|", F.coalesce(F.col("inst").cast("string"), "nombre", F.lit("")), "c", F.coalesce(F.col("cie").cast("string"), F.lit(""))))
    rows = rows.withColumn("repetida", F.row_number().over(Window.partitionBy(print_).orderBy("id")) > 1).withColumn("portada", F.col("c").isin(*TB.LANDING_TITLES)).withColumn("ajena", contains_any(F.concat_ws(" ", "c", "d"), TB.NOT_JOB_MARKERS))
    out = rows.select("id", R.quality([(F.expr(c), n, p) for c, n, p in CHECKS], REJECT, REVIEW).alias("q"))
    return out.select("id", "q.decision", F.col("q.primary").alias("primera"), F.col("q.reasons").alias("motivos"), F.col("q.score").alias("puntaje"))


# --- intake: policy, dates, pay and body together


@query(f"""SELECT id, m IS NOT NULL AS descarta, m AS motivo, CASE WHEN m IS NULL THEN array_to_string(list_filter([CASE WHEN viejo THEN 'publicacion_antigua' END, renta, CASE WHEN length(coalesce(b, '')) < 80 THEN 'texto_insuficiente' END], lambda x: x IS NOT NULL), ',') ELSE '' END AS revisar FROM (SELECT *, CASE WHEN trim(coalesce(t, '')) = '' THEN 'sin_cargo' WHEN trim(coalesce(u, '')) = '' THEN 'sin_url' WHEN length(trim(t)) < 5 THEN 'cargo_demasiado_corto' WHEN NOT pol THEN 'politica_rechaza' WHEN cie < {D} THEN 'fecha_cierre_vencida' WHEN cie >= {D} THEN NULL WHEN {D} - pub > 365 THEN 'publicacion_excede_365_dias' WHEN {D} - pub > 180 THEN 'publicacion_excede_180_dias_sin_cierre' END AS m,
 cie IS NULL AND coalesce({D} - pub BETWEEN 91 AND 180, FALSE) AS viejo FROM (SELECT o.id, p.t, p.b, o.url_oferta AS u, o.fecha_publicacion AS pub, CASE WHEN o.id % 3 <> 0 THEN o.fecha_cierre END AS cie, p.pol, CASE WHEN greatest(coalesce(rmin, rmax), coalesce(rmax, rmin)) >= 15000000 THEN 'renta_descarte_monto_inverosimil' WHEN greatest(coalesce(rmin, rmax), coalesce(rmax, rmin)) < 250000 THEN 'renta_descarte_monto_irrelevante' WHEN greatest(coalesce(rmin, rmax), coalesce(rmax, rmin)) >= 10000000 AND NOT regexp_matches({sql_fold('p.b')}, '{"|".join(M.CONTEXT)}') THEN 'renta_no_confiable_sin_contexto' END AS renta
 FROM (SELECT *, CASE WHEN renta_bruta_min > 0 THEN renta_bruta_min * 5 END AS rmin, CASE WHEN renta_bruta_max > 0 THEN renta_bruta_max * 5 END AS rmax FROM ofertas) o JOIN (SELECT id, t, b, round(sc, 4) >= 0.2 AND hits > 0 AND NOT ins AS pol FROM (SELECT *, least(0.75, hits * 0.1)::DOUBLE - bu::INT * 0.45 - bt::INT * 0.35 - ins::INT * 0.6 - (length(bl) < 8)::INT * 0.25 AS sc FROM (SELECT *, ({{POS}})::DOUBLE AS hits, regexp_matches(ul, '{{URLS}}') AS bu, regexp_matches(bl, '{{NEG}}') AS bt, regexp_matches(bl, '{{INT}}') AS ins
 FROM (SELECT id, t, b, {sql_fold("coalesce(t, '') || ' ' || coalesce(b, '')")} AS bl, {sql_fold('url_oferta')} AS ul FROM (SELECT id, url_oferta, {picked('id', PAGE['title'])} AS t, {picked('id', PAGE['body'])} AS b FROM ofertas))))) p ON p.id = o.id))""".replace("{POS}", " + ".join(f"contains(bl, '{p}')::INT" for p in dict.fromkeys(PR.PL.POSITIVE))).replace("{URLS}", "|".join(PR.PL.NEGATIVE_URL)).replace("{NEG}", "|".join(PR.PL.NEGATIVE)).replace("{INT}", "|".join(PR.PL.INTERNAL)))
def v04_intake_gate(spark, sf_dir):
    """V06, V03, V05 and N04 composed: the first failure decides, doubts ask for review."""
    from plazamill.functions import policy_lists as PL
    from plazamill.functions import text as T
    from plazamill.operators import sources_policy as P

    c = F.col
    rows = A.offers(spark, sf_dir).selectExpr("id", f"{picked('id', PAGE['title'])} AS t", f"{picked('id', PAGE['body'])} AS b", "url_oferta AS u", "fecha_publicacion AS pub", "CASE WHEN id % 3 <> 0 THEN fecha_cierre END AS cie", "renta_bruta_min * 5 AS rmin", "renta_bruta_max * 5 AS rmax")
    rows = rows.withColumn("bl", T.ascii_fold(F.concat_ws(" ", F.coalesce("t", F.lit("")), F.coalesce("b", F.lit(""))))).withColumn("ul", T.ascii_fold(c("u")))
    rows = rows.withColumn("p", R.policy(c("bl"), c("ul"), list(PL.POSITIVE), "|".join(PL.NEGATIVE), "|".join(PL.NEGATIVE_URL), "|".join(PL.INTERNAL)))
    g = P.intake(R.minimum_fields(c("t"), c("u")), c("p.accept"), R.vigency(c("pub"), c("cie"), OFFERS.day), M.assessed(c("rmin"), c("rmax"), c("b"))["reason"], F.length(F.coalesce("b", F.lit(""))) < 80)
    return rows.select("id", g.alias("g")).select("id", c("g.discard").alias("descarta"), c("g.reason").alias("motivo"), c("g.review").alias("revisar"))

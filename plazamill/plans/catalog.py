"""Catalog matches, source resolution, overrides, patches, subscriptions, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from plazamill.context import OFFERS
from plazamill.functions import policy_lists as PL
from plazamill.functions import text as T
from plazamill.operators import catalog as C
from plazamill.operators import evaluation as E
from plazamill.sources import adapters as A

from .base import lit, query
from .labels import dealt, dealt_sql
from .page_rules import _SQLV, CHECKS
from .pages import V21, _sources, sql_key
from .scalars import sql_normal

_NAMES = "CASE c_custkey % 5 WHEN 0 THEN upper(c_name) WHEN 1 THEN concat('Servicio ', c_name, ' de Salud') WHEN 2 THEN substring(c_name, 1, 12) WHEN 3 THEN concat('zz', c_name) ELSE 'q' END"


@query(f"""WITH n AS (SELECT c_custkey AS id, {sql_normal(_NAMES)} AS a FROM customer), c AS (SELECT min(c_custkey) AS k, {sql_normal('c_name')} AS b FROM customer GROUP BY 2)
 SELECT n.id, coalesce(x.k, (SELECT min(c.k) FROM c WHERE length(n.a) >= 3 AND (contains(c.b, n.a) OR contains(n.a, c.b)))) AS match_id, CASE WHEN x.k IS NOT NULL THEN 'exact' WHEN EXISTS (SELECT 1 FROM c WHERE length(n.a) >= 3 AND (contains(c.b, n.a) OR contains(n.a, c.b))) THEN 'contained' END AS stage FROM n LEFT JOIN c x ON x.b = n.a""", cte=False)
def j09_contained_names(spark, sf_dir):
    """The first two stages of the cascade; the names of this query have no third (tests hold that one)."""
    c = A.read(spark, sf_dir, "customer")
    names = c.selectExpr("c_custkey AS id", f"{_NAMES} AS nombre")
    return C.name_cascade(names, c, "nombre", "c_custkey", "c_name", threshold=0.99).select("id", "match_id", "stage")


@query()
def j09_name_cascade(spark, sf_dir):
    """All three stages, one letter of each name changed."""
    c = A.read(spark, sf_dir, "customer")
    names = c.select(F.col("c_custkey").alias("id"), F.regexp_replace("c_name", "Customer", "Custumer").alias("nombre"))
    return C.name_cascade(names, c, "nombre", "c_custkey", "c_name").select("id", "match_id", "stage")


_CAT = "SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 4 = 0 THEN concat('Sigla larga ', c_custkey) END AS short, CASE WHEN c_custkey % 6 IN (2, 4) THEN concat('sitio', c_custkey % 90, '.cl') END AS domain FROM customer"
_ASK = "CASE id % 4 WHEN 0 THEN concat('Dirección de ', nombre, ' central') WHEN 1 THEN upper(nombre) WHEN 2 THEN concat('sigla  larga ', id) ELSE 'otra' END"


@query(f"""SELECT r.id, coalesce(d.domain, n.d, p.d) AS dominio FROM (SELECT id, iid, {sql_normal('t')} AS k FROM (SELECT id, CASE WHEN id % 5 = 0 THEN id + 1 END AS iid, {_ASK} AS t FROM instituciones)) r LEFT JOIN (SELECT id, domain FROM ({_CAT}) WHERE domain IS NOT NULL) d ON d.id = r.iid
 LEFT JOIN (SELECT key, arg_min(domain, (id, o)) AS d FROM (SELECT id, domain, {sql_normal('name')} AS key, 0 AS o FROM ({_CAT}) UNION ALL SELECT id, domain, {sql_normal('short')}, 1 FROM ({_CAT})) WHERE domain IS NOT NULL AND key <> '' GROUP BY key) n ON n.key = r.k
 LEFT JOIN (SELECT a.k, arg_max(b.d, (length(b.key), b.key)) AS d FROM (SELECT DISTINCT {sql_normal('t')} AS k FROM (SELECT {_ASK} AS t FROM instituciones)) a JOIN (SELECT key, arg_min(domain, (id, o)) AS d FROM (SELECT id, domain, {sql_normal('name')} AS key, 0 AS o FROM ({_CAT}) UNION ALL SELECT id, domain, {sql_normal('short')}, 1 FROM ({_CAT})) WHERE domain IS NOT NULL AND length(key) >= 10 GROUP BY key) b ON contains(a.k, b.key) GROUP BY a.k) p ON p.k = r.k""")
def p09_web_domain(spark, sf_dir):
    catalog = A.read(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_name AS name", "CASE WHEN c_custkey % 4 = 0 THEN concat('Sigla larga ', c_custkey) END AS short", "CASE WHEN c_custkey % 6 IN (2, 4) THEN concat('sitio', c_custkey % 90, '.cl') END AS domain")
    rows = A.institutions(spark, sf_dir).selectExpr("id", "CASE WHEN id % 5 = 0 THEN id + 1 END AS iid", f"{_ASK} AS t")
    return C.web_domain(rows, catalog, "t", "iid").select("id", F.col("domain").alias("dominio"))


_SRC = "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 10 = 7 THEN 'EmpleosPublicos' ELSE 'wordpress' END AS platform, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE concat('empleo', s_suppkey % 30, '.cl') END AS host, CASE WHEN s_suppkey % 4 = 0 THEN concat(' CUSTOMER#00000000', s_suppkey % 10) ELSE s_name END AS name FROM supplier"
_WHO = "SELECT id, CASE WHEN id % 6 = 0 THEN 'scraper_empleos_publicos' ELSE 'scraper_generic_fallback' END AS extractor, coalesce(regexp_replace(lower(regexp_extract(url_empleo, '^[a-z]+://([^/]+)', 1)), '^www\\.', ''), '') AS host, concat('empleo', id % 40, '.cl') AS site_host, nombre AS name FROM instituciones"


@query(f"""SELECT r.id, CASE WHEN extractor = 'scraper_empleos_publicos' THEN (SELECT min(id) FROM ({_SRC}) WHERE lower(platform) = 'empleospublicos') ELSE coalesce((SELECT min(s.id) FROM ({_SRC}) s WHERE s.host = r.host OR s.host = r.site_host), (SELECT min(s.id) FROM ({_SRC}) s WHERE lower(trim(s.name)) = lower(trim(r.name)))) END AS fuente_id FROM ({_WHO}) r""")
def j10_source_resolution(spark, sf_dir):
    sources = A.read(spark, sf_dir, "supplier").selectExpr(*[x.strip() for x in ("s_suppkey AS id", "CASE WHEN s_suppkey % 10 = 7 THEN 'EmpleosPublicos' ELSE 'wordpress' END AS platform", "CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE concat('empleo', s_suppkey % 30, '.cl') END AS host", "CASE WHEN s_suppkey % 4 = 0 THEN concat(' CUSTOMER#00000000', s_suppkey % 10) ELSE s_name END AS name")])
    rows = A.institutions(spark, sf_dir).select("id", F.when(F.col("id") % 6 == 0, "scraper_empleos_publicos").otherwise("scraper_generic_fallback").alias("extractor"), F.coalesce(T.host(F.col("url_empleo")), F.lit("")).alias("host"), F.concat(F.lit("empleo"), F.col("id") % 40, F.lit(".cl")).alias("site_host"), F.col("nombre").alias("name"))
    return C.resolved_source(rows, sources).select("id", F.col("source_id").alias("fuente_id"))


_EX = tuple(dict.fromkeys(e for e, _, _ in C.MODULES)) + (None,)
_PF = tuple(x[0] for x in E.PROFILES)


@query("SELECT id, coalesce(x.m, w.m) AS modulo FROM " + dealt_sql("event_id", "events", extractor=_EX, perfil=_PF) + " r LEFT JOIN (VALUES " + ", ".join(f"('{e}', '{p}', '{m}')" for e, p, m in C.MODULES) + ") x(e, p, m) ON x.e = r.extractor AND x.p = r.perfil LEFT JOIN (VALUES " + ", ".join(f"('{e}', '{p}', '{m}')" for e, p, m in C.MODULES) + ") w(e, p, m) ON w.e = r.extractor AND w.p = '*'", cte=False)
def j14_runtime_dispatch(spark, sf_dir):
    return dealt(spark, sf_dir, "event_id", "events", extractor=_EX, perfil=_PF).select("id", C.module(F.col("extractor"), F.col("perfil")).alias("modulo"))


STATES = ("active", "experimental", "manual_review", "js_required", "blocked", "broken", "no_data", "disabled")
KINDS = ("empleos_publicos", "wordpress", "generic", "custom_trabajando", "custom_hiringroom", "custom_buk", "custom_playwright", "custom_policia", "custom_ffaa", "skip")
_OV = {"status": ("blocked", None, "raro", "active"), "kind": ("custom_ffaa", None, "otro", "skip", "generic"), "reason": ("WAF", None, ""), "tier": (" High ", None, "")}
_OVSQL = dealt_sql("c_custkey", "customer", **_OV)


@query(f"""SELECT s.id, CASE WHEN o.status IN ({', '.join(map(lit, STATES))}) THEN o.status ELSE s.status END AS status, CASE WHEN o.kind IN ({', '.join(map(lit, KINDS))}) THEN o.kind ELSE s.kind END AS kind, CASE WHEN o.id IS NOT NULL THEN 'validated' ELSE s.confianza END AS confianza, CASE WHEN o.id IS NOT NULL THEN 'override: ' || coalesce(nullif(o.reason, ''), s.motivo) ELSE s.motivo END AS motivo, nullif(lower(trim(o.tier)), '') AS tier FROM ({V21}) s LEFT JOIN (SELECT * FROM {_OVSQL} WHERE id % 3 = 0) o ON o.id = s.id""", cte=False)
def j15_override_join(spark, sf_dir):
    rows = _sources(spark, sf_dir).select("id", "s.status", "s.kind", "s.confidence", "s.reason")
    overrides = dealt(spark, sf_dir, "c_custkey", "customer", **_OV).where("id % 3 = 0")
    out = C.overridden(rows, overrides, STATES, KINDS)
    return out.select("id", "status", "kind", F.col("confidence").alias("confianza"), F.col("reason").alias("motivo"), "tier")


_SEEN = {"url": ("https://a.cl/1", "", None, " https://a.cl/2 ", "https://a.cl/1"), "titulo": ("Aviso  uno", "aviso uno", "", None, "Otro", "Aviso uno", "Tercero")}


@query(f"""SELECT min(id) AS id, k AS clave FROM (SELECT id, coalesce(nullif(trim(regexp_replace(url, '\\s+', ' ', 'g')), ''), nullif(trim(regexp_replace(titulo, '\\s+', ' ', 'g')), '')) AS k FROM {dealt_sql(**_SEEN)}) WHERE k IS NOT NULL GROUP BY k""", cte=False)
def w05_first_seen_key(spark, sf_dir):
    rows = dealt(spark, sf_dir, **_SEEN)
    key = F.coalesce(F.nullif(T.clean(F.col("url")), F.lit("")), F.nullif(T.clean(F.col("titulo")), F.lit("")))
    return C.first_seen(rows, key, F.col("id")).select("id", key.alias("clave"))


@query(f"""SELECT min(id) AS id, k AS clave FROM (SELECT id, coalesce(url, '') || substring(coalesce(titulo, ''), 1, 30) AS k FROM {dealt_sql(**_SEEN)}) WHERE k <> '' GROUP BY k""", cte=False)
def w05_first_seen_url_title(spark, sf_dir):
    key = F.concat(F.coalesce("url", F.lit("")), F.substring(F.coalesce("titulo", F.lit("")), 1, 30))
    return C.first_seen(dealt(spark, sf_dir, **_SEEN), key, F.col("id")).select("id", key.alias("clave"))


_MINE = {"titulo": ("Noticia del concejo", "Analista contable", "Sorteo navideño vecinal", "Sorteo de fin de año", "Profesional analista", "Remate 2024 público"), "ruta": ("/sorteos/2024/x", "/empleos/1", "/noticias/a", "/sorteos/navidad", "/remates/abc", "/2024/01")}
_DEC = "CASE id % 7 WHEN 0 THEN 'publish' WHEN 1 THEN 'review' ELSE 'reject' END"
STOP = ("para", "como", "este", "esta", "desde", "hasta", "entre", "sobre", "concurso", "publico", "cargo")
_KNOWN = " ".join(PL.NEGATIVE)


@query(f"""WITH r AS (SELECT id, {_DEC} AS decision, {sql_key('titulo')} AS t, lower(ruta) AS p FROM {dealt_sql(**_MINE)}), w AS (SELECT DISTINCT id, decision, unnest(regexp_extract_all(t, '[a-z0-9]{{4,}}')) AS c FROM r), s AS (SELECT DISTINCT id, unnest(list_filter(string_split(p, '/'), lambda x: x <> '')) AS c FROM r WHERE decision = 'reject')
 SELECT * FROM (SELECT 0 AS kind, c AS candidate, count(*) FILTER (WHERE decision = 'reject') AS support FROM w WHERE c NOT IN ({', '.join(map(lit, STOP))}) GROUP BY c HAVING count(*) FILTER (WHERE decision = 'reject') >= 3 AND count(*) FILTER (WHERE decision = 'publish') * 3 <= count(*) FILTER (WHERE decision = 'reject') AND NOT contains({lit(_KNOWN)}, c) AND c NOT IN ({', '.join(map(lit, PL.POSITIVE))})
 UNION ALL SELECT 1, c, count(*) FROM s GROUP BY c HAVING count(*) >= 3 AND c NOT IN ({', '.join(lit(x.strip('/')) for x in PL.NEGATIVE_URL)}) AND NOT regexp_full_match(c, '[0-9]+') AND length(c) >= 4) ORDER BY kind, support DESC, candidate LIMIT 25""", cte=False)
def a23_token_mining(spark, sf_dir):
    rows = dealt(spark, sf_dir, **_MINE).select("id", F.expr(_DEC).alias("decision"), E.key(F.col("titulo")).alias("title"), F.col("ruta").alias("path"))
    return C.suggestions(rows, list(STOP), _KNOWN, list(PL.POSITIVE), [x.strip("/") for x in PL.NEGATIVE_URL])


_REASONS = f"""SELECT id, quien, unnest(list_transform(list_filter([{", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n, _ in CHECKS)}], lambda x: x IS NOT NULL), lambda x: x)) AS motivo FROM (SELECT *, coalesce(inst::VARCHAR, nombre, 'sin_institucion') AS quien FROM ({_SQLV}))"""
_FIX = "CASE motivo " + " ".join(f"WHEN '{k}' THEN {lit(v)}" for k, v in C.REMEDIES.items()) + " END"


@query(f"SELECT quien, motivo, count(*) AS n, {_FIX} AS remedio, sum(count(*)) OVER (PARTITION BY motivo)::BIGINT AS total FROM ({_REASONS}) GROUP BY quien, motivo")
def a24_historical_audit(spark, sf_dir):
    """Reasons of the quality validator by institution, over all, and what to do about each."""
    from .page_rules import v07_quality_validator

    q = v07_quality_validator(spark, sf_dir).select("id", F.explode(F.split("motivos", ",")).alias("motivo")).where("motivo <> ''")
    o = A.offers(spark, sf_dir).select("id", F.coalesce(F.col("institucion_id").cast("string"), "institucion_nombre", F.lit("sin_institucion")).alias("quien"))
    by = q.join(o, "id").groupBy("quien", "motivo").agg(F.count("*").alias("n"))
    total = by.groupBy("motivo").agg(F.sum("n").alias("total"))
    remedy = F.try_element_at(F.create_map(*[F.lit(x) for kv in C.REMEDIES.items() for x in kv]), F.col("motivo"))
    return by.join(total, "motivo").select("quien", "motivo", "n", remedy.alias("remedio"), "total")


@query("""SELECT f.plataforma_empleo AS familia, count(*) AS total, count(*) FILTER (WHERE trim(coalesce(o.cargo, '')) <> '' AND o.url_oferta IS NOT NULL) AS minimos, count(*) FILTER (WHERE CASE WHEN o.fecha_cierre IS NOT NULL THEN o.fecha_cierre >= DATE '1998-06-01' WHEN o.fecha_publicacion IS NOT NULL THEN DATE '1998-06-01' - o.fecha_publicacion <= 60 ELSE TRUE END) AS vigentes, count(*) FILTER (WHERE m IS NOT NULL) AS descartadas,
 count(*) FILTER (WHERE m = 'sin_cargo') AS sin_cargo, count(*) FILTER (WHERE m = 'sin_url') AS sin_url, count(*) FILTER (WHERE m LIKE 'fecha_cierre%') AS vencidas, count(*) FILTER (WHERE m LIKE 'publicacion%') AS antiguas, count(*) FILTER (WHERE m IS NULL AND fecha_cierre IS NULL AND coalesce(DATE '1998-06-01' - fecha_publicacion BETWEEN 91 AND 180, FALSE)) AS revisar
 FROM (SELECT *, CASE WHEN trim(coalesce(cargo, '')) = '' THEN 'sin_cargo' WHEN trim(coalesce(url_oferta, '')) = '' THEN 'sin_url' WHEN length(trim(cargo)) < 5 THEN 'corto' WHEN fecha_cierre < DATE '1998-06-01' THEN 'fecha_cierre_vencida' WHEN fecha_cierre >= DATE '1998-06-01' THEN NULL WHEN DATE '1998-06-01' - fecha_publicacion > 365 THEN 'publicacion_365' WHEN DATE '1998-06-01' - fecha_publicacion > 180 THEN 'publicacion_180' END AS m FROM ofertas) o JOIN instituciones f ON f.id = o.institucion_id GROUP BY 1""")
def a28_family_summary(spark, sf_dir):
    """Offers by the platform of their institution: minimum fields, in force, review, discards by motive."""
    from plazamill.functions import dates as DT
    from plazamill.operators import rules as R

    c = F.col
    v = R.vigency(c("fecha_publicacion"), c("fecha_cierre"), OFFERS.day)
    o = A.offers(spark, sf_dir).withColumn("v", v).withColumn("m", F.coalesce(R.minimum_fields(c("cargo"), c("url_oferta")), F.when(c("v.discard"), c("v.reason"))))
    j = o.join(A.institutions(spark, sf_dir).select(c("id").alias("i"), "plataforma_empleo"), c("institucion_id") == c("i"))
    full = (F.trim(F.coalesce("cargo", F.lit(""))) != "") & c("url_oferta").isNotNull()
    return j.groupBy(c("plataforma_empleo").alias("familia")).agg(
        F.count("*").alias("total"), F.count_if(full).alias("minimos"), F.count_if(DT.in_force(c("fecha_cierre"), c("fecha_publicacion"), OFFERS.day)).alias("vigentes"), F.count_if(c("m").isNotNull()).alias("descartadas"), F.count_if(c("m") == "sin_cargo").alias("sin_cargo"),
        F.count_if(c("m") == "sin_url").alias("sin_url"), F.count_if(c("m").like("fecha_cierre%")).alias("vencidas"), F.count_if(c("m").like("publicacion%")).alias("antiguas"), F.count_if(c("m").isNull() & c("v.review")).alias("revisar"),
    )


_OLD = "SELECT c_custkey AS id, concat(lower(c_name), '@x.cl') AS email, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'Maule' END AS region, CASE WHEN c_custkey % 4 = 0 THEN 'abogado' END AS termino, 'diaria' AS freq, c_custkey % 5 <> 0 AS active FROM customer WHERE c_custkey % 2 = 0"
_NEW = "SELECT c_custkey + 1000000 AS id, concat(c_name, '@X.cl') AS email, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE ' Maule ' END AS region, CASE WHEN c_custkey % 8 = 0 THEN 'abogado' ELSE '' END AS termino, CASE c_custkey % 3 WHEN 0 THEN ' SEMANAL' WHEN 1 THEN 'mensual' END AS freq FROM customer WHERE c_custkey % 3 <> 1 OR c_custkey % 4 = 0"


@query(f"""WITH o AS (SELECT *, lower(email) || chr(1) || coalesce(trim(region), '') || chr(1) || coalesce(trim(termino), '') AS k FROM ({_OLD})), n AS (SELECT *, lower(email) || chr(1) || coalesce(trim(region), '') || chr(1) || coalesce(trim(termino), '') AS k, CASE WHEN lower(trim(freq)) IN ('diaria', 'semanal') THEN lower(trim(freq)) ELSE 'diaria' END AS f FROM ({_NEW}))
 SELECT coalesce(o.id, n.id) AS id, coalesce(o.email, n.email) AS email, CASE WHEN o.id IS NULL THEN trim(n.region) ELSE o.region END AS region, CASE WHEN o.id IS NULL THEN trim(n.termino) ELSE o.termino END AS termino, coalesce(n.f, o.freq) AS freq, coalesce(n.id IS NOT NULL, FALSE) OR coalesce(o.active, FALSE) AS active, o.id IS NULL AS added FROM o FULL JOIN n ON o.k = n.k""", cte=False)
def k09_subscription_upsert(spark, sf_dir):
    c = A.read(spark, sf_dir, "customer")
    c.createOrReplaceTempView("plz_customer")
    old = spark.sql(_OLD.replace("FROM customer", "FROM plz_customer")).withColumn("updated", F.lit(None).cast("timestamp"))
    new = spark.sql(_NEW.replace("FROM customer", "FROM plz_customer"))
    return C.subscribed(old, new, ["region", "termino"], OFFERS.instant).drop("updated")


@query("""SELECT i.id, CASE WHEN m.id IS NOT NULL THEN coalesce(nullif(m.site, ''), CASE WHEN f.id IS NOT NULL THEN f.site ELSE i.site END) WHEN f.id IS NOT NULL THEN f.site ELSE i.site END AS sitio, CASE WHEN m.id IS NOT NULL THEN m.url WHEN f.id IS NOT NULL THEN f.url ELSE i.url END AS url, CASE WHEN m.id IS NOT NULL THEN m.platform WHEN f.id IS NOT NULL THEN f.platform ELSE i.platform END AS plataforma,
 CASE WHEN i.id % 15 < 4 AND NOT (m.id IS NOT NULL OR f.id IS NOT NULL OR coalesce(i.state = 'Verificado', FALSE)) THEN 'Sitio caído' WHEN m.id IS NOT NULL OR f.id IS NOT NULL THEN 'Verificado' ELSE i.state END AS estado
 FROM (SELECT id, concat('https://i', id, '.cl') AS site, url_empleo AS url, plataforma_empleo AS platform, CASE WHEN id % 4 = 0 THEN 'Verificado' WHEN id % 4 = 1 THEN 'Por verificar' END AS state FROM instituciones) i LEFT JOIN (SELECT id, concat('https://f', id, '.cl') AS site, 'f' AS url, 'Sitio propio' AS platform FROM instituciones WHERE id % 6 = 0) f ON f.id = i.id LEFT JOIN (SELECT id, CASE WHEN id % 20 = 0 THEN '' ELSE concat('https://m', id, '.cl') END AS site, 'm' AS url, 'WordPress' AS platform FROM instituciones WHERE id % 10 = 0) m ON m.id = i.id""")
def k13_catalog_patch(spark, sf_dir):
    i = A.institutions(spark, sf_dir)
    catalog = i.selectExpr("id", "concat('https://i', id, '.cl') AS site", "url_empleo AS url", "plataforma_empleo AS platform", "CASE WHEN id % 4 = 0 THEN 'Verificado' WHEN id % 4 = 1 THEN 'Por verificar' END AS state")
    found = i.where("id % 6 = 0").selectExpr("id", "concat('https://f', id, '.cl') AS site", "'f' AS url", "'Sitio propio' AS platform")
    manual = i.where("id % 10 = 0").selectExpr("id", "CASE WHEN id % 20 = 0 THEN '' ELSE concat('https://m', id, '.cl') END AS site", "'m' AS url", "'WordPress' AS platform")
    out = C.patched(catalog, found, manual, i.where("id % 15 < 4").select("id"))
    return out.select("id", F.col("site").alias("sitio"), "url", F.col("platform").alias("plataforma"), F.col("state").alias("estado"))


@query("SELECT coalesce(n.k, o.k) AS k, coalesce(n.v, o.v) AS v FROM (SELECT 'clave' || (n_nationkey % 10)::VARCHAR AS k, max(n_name) AS v FROM nation GROUP BY 1) o FULL JOIN (SELECT 'clave' || (s_suppkey % 14)::VARCHAR AS k, max(s_name) AS v FROM supplier GROUP BY 1) n ON o.k = n.k", cte=False)
def k12_config_upsert(spark, sf_dir):
    from plazamill.operators import merge

    key = lambda c, n: F.concat(F.lit("clave"), (F.col(c) % n).cast("string")).alias("k")
    old = A.read(spark, sf_dir, "nation").groupBy(key("n_nationkey", 10)).agg(F.max("n_name").alias("v"))
    new = A.read(spark, sf_dir, "supplier").groupBy(key("s_suppkey", 14)).agg(F.max("s_name").alias("v"))
    return merge.upsert(old, new, "k", ["v"]).select("k", "v")


@query(f"SELECT id, sha1(coalesce(institucion_id::VARCHAR, institucion_nombre, '') || '|' || {sql_key('cargo')} || '|' || coalesce(fecha_cierre::VARCHAR, '')) AS huella FROM ofertas")
def s14_fingerprint(spark, sf_dir):
    parts = [F.coalesce(F.col("institucion_id").cast("string"), "institucion_nombre", F.lit("")), E.key(F.col("cargo")), F.coalesce(F.col("fecha_cierre").cast("string"), F.lit(""))]
    return A.offers(spark, sf_dir).select("id", F.sha1(F.concat_ws("|", *parts)).alias("huella"))

"""The composed results of the serving and operations endpoints, each whole.

A payload of several parts comes as rows (parte, clave, valor) or with its totals on every row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plazamill.context import EVENTS, OFFERS
from plazamill.functions import labels as LB
from plazamill.functions import text as T
from plazamill.operators import alerts as AL
from plazamill.operators import offers as O
from plazamill.operators import search as SR
from plazamill.sources import adapters as A

from .aggregates import a09_admin_totals, a10_evaluation_summary, a11_url_validity, a16_decision_stats, a18_reason_crosstab, a19_platform_decision, a20_histograms, a21_coverage
from .base import SQL, lit, query
from .labels import MAILS, dealt
from .listing import ACTIVE, BASE, CONTRACT, D, NOW, P01, SEEN, STATUS, joined, latest
from .pages import V21, _sources
from .policy import LAST

def total_and_pages(rows: DataFrame, counted: DataFrame, size: int) -> DataFrame:
    """Rows of a page with the total of the whole result and its number of pages (one row, broadcast)."""
    n = counted.agg(F.count("*").alias("total")).withColumn("paginas", F.ceil(F.col("total") / size))
    return rows.crossJoin(F.broadcast(n))


def body(name: str) -> str:
    """The SQL of a registered query without the common relations, for use inside another."""
    return SQL[name].split("FROM lineitem)\n", 1)[-1]


def long_form(part: str, frame: DataFrame, keys: list[str]) -> DataFrame:
    """(parte, clave, valor) of a frame: one row per value column, the keys joined."""
    values = [c for c in frame.columns if c not in keys]
    key = F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]) if keys else F.lit("")
    return frame.select(F.inline(F.array(*[F.struct(F.lit(part).alias("parte"), F.concat_ws(":", key, F.lit(v)).alias("clave"), F.col(v).cast("double").alias("valor")) for v in values])))


def sql_long(part: str, sql: str, keys: list[str], values: list[str]) -> str:
    key = "concat_ws('/', " + ", ".join(f"coalesce({k}::VARCHAR, '')" for k in keys) + ")" if keys else "''"
    return " UNION ALL ".join(f"SELECT '{part}' AS parte, {key} || ':{v}' AS clave, {v}::DOUBLE AS valor FROM ({sql})" for v in values)


_CLOSED = f"{STATUS} = 'closed' AND coalesce(o.region, i.region, '') ILIKE '%region 1%' AND {CONTRACT} ILIKE '%contrata%'"


@query(f"SELECT o.id, coalesce(nullif(trim(o.institucion_nombre), ''), i.nombre, 'Sin institución') AS institucion, coalesce(o.cargo, 'Sin cargo') AS cargo, 'cerrado' AS estado, o.fecha_cierre - {D} AS dias_restantes, t.total, ceil(t.total / 50.0)::BIGINT AS paginas {BASE} CROSS JOIN (SELECT count(*) AS total {BASE} WHERE {_CLOSED}) t WHERE {_CLOSED} ORDER BY {SEEN} DESC NULLS LAST, o.id LIMIT 50 OFFSET 50")
def q07_history(spark, sf_dir):
    rows = joined(spark, sf_dir).where(O.filters(OFFERS, region="region 1", kind="contrata", only_active=False, only_closed=True))
    shown = O.page(rows, [F.desc_nulls_last(O.seen_at()), F.asc("id")], 2, 50)
    s = O.projection(shown, OFFERS).select("id", "institucion", "cargo", O.legacy(F.col("estado")).alias("estado"), F.datediff("fecha_cierre", OFFERS.day).alias("dias_restantes"))
    return total_and_pages(s, rows, 50)


@query(f"SELECT o.cargo, count(*) AS total FROM ofertas o WHERE {ACTIVE} AND o.cargo ILIKE '2-%' GROUP BY 1 ORDER BY total DESC, cargo LIMIT 10")
def q08_suggestions(spark, sf_dir):
    rows = A.offers(spark, sf_dir).where(O.is_active(OFFERS) & F.col("cargo").ilike("2-%"))
    return rows.groupBy("cargo").agg(F.count("*").alias("total")).orderBy(F.desc("total"), "cargo").limit(10)


@query("SELECT id, valido, sugerencia, motivo, CASE WHEN valido THEN 'registrada' ELSE 'rechazada' END AS resultado FROM (" + SQL["s28_email"] + ")", cte=False)
def q09_subscribe(spark, sf_dir):
    """The answer to each request; valid ones go on to k09_subscription_upsert."""
    c = LB.mail_check(F.col("correo"))
    return dealt(spark, sf_dir, "c_custkey", "customer", correo=MAILS).select("id", c["valid"].alias("valido"), c["suggestion"].alias("sugerencia"), c["reason"].alias("motivo"), F.when(c["valid"], "registrada").otherwise("rechazada").alias("resultado"))


_STATES = ("active", "experimental", "manual_review", "js_required", "blocked", "broken", "no_data", "disabled")


@query(f"SELECT 'status' AS parte, s AS clave, coalesce(n, 0)::DOUBLE AS valor FROM (VALUES {', '.join(f'({lit(s)})' for s in _STATES)}) v(s) LEFT JOIN (SELECT status, count(*) AS n FROM ({V21}) GROUP BY 1) ON status = s UNION ALL SELECT 'kind', kind, count(*)::DOUBLE FROM ({V21}) GROUP BY 2 UNION ALL SELECT 'total', 'cobertura_activa_pct', round(100.0 * count(*) FILTER (WHERE status = 'active') / count(*), 1) FROM ({V21}) UNION ALL SELECT 'total', 'fuentes', count(*)::DOUBLE FROM ({V21})", cte=False)
def q10_source_summary(spark, sf_dir):
    """Counts by status (all of them) and kind, total and active share."""
    s = _sources(spark, sf_dir).select("s.status", "s.kind")
    every = spark.createDataFrame([(x,) for x in _STATES], "clave string")
    by = s.groupBy("status").agg(F.count("*").alias("n"))
    status = every.join(F.broadcast(by), F.col("clave") == F.col("status"), "left").select(F.lit("status").alias("parte"), "clave", F.coalesce("n", F.lit(0)).cast("double").alias("valor"))
    kind = s.groupBy(F.col("kind").alias("clave")).agg(F.count("*").cast("double").alias("valor")).select(F.lit("kind").alias("parte"), "clave", "valor")
    n = s.agg(F.round(100.0 * F.count_if(F.col("status") == "active") / F.count("*"), 1).alias("cobertura_activa_pct"), F.count("*").cast("double").alias("fuentes"))
    return status.union(kind).union(n.unpivot([], ["cobertura_activa_pct", "fuentes"], "clave", "valor").select(F.lit("total").alias("parte"), "clave", "valor"))


@query("SELECT i.id, i.nombre, CASE WHEN contains(lower(coalesce(i.sector, i.tipo)), 'municipal') THEN 'Ley 18.883' ELSE 'Ley 18.834' END AS ley FROM instituciones i")
def q11_institution_law(spark, sf_dir):
    i = A.institutions(spark, sf_dir)
    return i.select("id", "nombre", LB.law(F.col("nombre"), F.coalesce("sigla", "nombre_corto"), F.coalesce("sector", "tipo"), F.lit(None).cast("string"))["law"].alias("ley"))


@query("SELECT id, email, valido, sugerencia, desechable, motivo FROM (" + SQL["s28_email"] + ")", cte=False)
def q12_mail_check(spark, sf_dir):
    c = LB.mail_check(F.col("correo"))
    rows = dealt(spark, sf_dir, "c_custkey", "customer", correo=MAILS)
    return rows.select("id", c["address"].alias("email"), c["valid"].alias("valido"), c["suggestion"].alias("sugerencia"), c["disposable"].alias("desechable"), c["reason"].alias("motivo"))


@query()
def q13_search(spark, sf_dir):
    """Ranked search over the active postings with one typing error; its rule is checked by t21_search_typo."""
    rows = O.projection(joined(spark, sf_dir).where(O.is_active(OFFERS)), OFFERS)
    return SR.search(rows, "urgnt", ("cargo", "institucion", "descripcion"), 10)


_ALIAS = "('Region 1', 'Region 10')"


@query(f"SELECT o.id, o.cargo, coalesce(nullif(o.institucion_nombre, ''), 'Institución pública') AS institucion, o.ciudad, o.region, CAST(o.fecha_cierre AS VARCHAR) AS fecha_cierre, coalesce(o.actualizada_en, o.fecha_scraped, o.detectada_en, o.creada_en) AS lastmod, t.total FROM ofertas o CROSS JOIN (SELECT count(*) AS total FROM ofertas o WHERE {ACTIVE} AND o.region IN {_ALIAS}) t WHERE {ACTIVE} AND o.region IN {_ALIAS} ORDER BY o.fecha_cierre NULLS LAST, o.id DESC LIMIT 30")
def q14_landing(spark, sf_dir):
    rows = A.offers(spark, sf_dir).where(O.is_active(OFFERS) & F.col("region").isin("Region 1", "Region 10"))
    top = rows.orderBy(F.asc_nulls_last("fecha_cierre"), F.desc("id")).limit(30)
    shown = top.select("id", "cargo", F.coalesce(F.nullif("institucion_nombre", F.lit("")), F.lit("Institución pública")).alias("institucion"), "ciudad", "region", F.col("fecha_cierre").cast("string").alias("fecha_cierre"), F.coalesce("actualizada_en", "fecha_scraped", "detectada_en", "creada_en").alias("lastmod"))
    return total_and_pages(shown, rows, 30).drop("paginas")


_SLUG = "regexp_replace(substring(regexp_replace(regexp_replace(lower(i.nombre), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80), '-+$', '')"


@query(f"SELECT * FROM (SELECT '/oferta/' || o.id::VARCHAR AS loc, strftime(coalesce(o.actualizada_en, o.fecha_scraped, o.detectada_en, o.creada_en), '%Y-%m-%d') AS lastmod FROM ofertas o WHERE {ACTIVE} ORDER BY o.id DESC LIMIT 45000) UNION ALL SELECT '/empleos/institucion/' || i.id::VARCHAR || '-' || {_SLUG}, NULL FROM instituciones i WHERE EXISTS (SELECT 1 FROM ofertas o WHERE o.institucion_id = i.id AND {ACTIVE})")
def q15_sitemap(spark, sf_dir):
    live = A.offers(spark, sf_dir).where(O.is_active(OFFERS))
    offers = live.orderBy(F.desc("id")).limit(45_000).select(F.concat(F.lit("/oferta/"), F.col("id")).alias("loc"), F.date_format(F.coalesce("actualizada_en", "fecha_scraped", "detectada_en", "creada_en"), "yyyy-MM-dd").alias("lastmod"))
    i = A.institutions(spark, sf_dir).join(live.select(F.col("institucion_id").alias("id")), "id", "left_semi")
    return offers.unionByName(i.select(F.concat(F.lit("/empleos/institucion/"), F.col("id"), F.lit("-"), T.slug(F.col("nombre"))).alias("loc"), F.lit(None).cast("string").alias("lastmod")))


@query(f"{P01} {BASE} WHERE {ACTIVE} ORDER BY o.id LIMIT 10000", dates=("fecha_publicacion", "fecha_inicio", "fecha_cierre"))
def q16_index_feed(spark, sf_dir):
    rows = joined(spark, sf_dir).where(O.is_active(OFFERS)).orderBy("id").limit(10_000)
    return O.projection(rows, OFFERS)


_SUBS = {
    "sub_id": "c_custkey", "region": "CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Region ' || (c_custkey % 16)::VARCHAR WHEN 2 THEN '' ELSE 'region 1' END", "termino": "CASE c_custkey % 5 WHEN 0 THEN 'urgent' WHEN 1 THEN 'DETALLE' WHEN 2 THEN '1-' END",
    "contrato": "CASE c_custkey % 3 WHEN 0 THEN 'contrata' WHEN 1 THEN 'planta' END", "sector": "CASE c_custkey % 7 WHEN 0 THEN 'build' WHEN 1 THEN 'Salud' END", "activa": "c_custkey % 11 <> 0",
}
_SUBSQL = f"(SELECT {', '.join(f'{e} AS {n}' for n, e in _SUBS.items())} FROM customer)"


def _met(want: str, *columns: str) -> str:
    return f"(coalesce(s.{want}, '') = '' OR " + " OR ".join(f"coalesce({c}, '') ILIKE '%' || s.{want} || '%'" for c in columns) + ")"


@query(f"""SELECT s.sub_id, o.id AS offer_id, row_number() OVER (PARTITION BY s.sub_id ORDER BY {SEEN} DESC NULLS LAST, o.id) AS pos FROM {_SUBSQL} s CROSS JOIN (SELECT o.*, i.sector AS i_sector, i.tipo AS i_tipo, i.region AS i_region {BASE} WHERE {ACTIVE} AND {SEEN} >= {NOW} - INTERVAL 24 HOUR) o
 WHERE s.activa AND {_met('region', 'coalesce(o.region, o.i_region)')} AND {_met('termino', 'o.cargo', 'o.descripcion')} AND {_met('contrato', CONTRACT)} AND {_met('sector', 'coalesce(o.i_sector, o.sector, o.i_tipo)')} QUALIFY pos <= 20""")
def j12_alert_matches(spark, sf_dir):
    subs = A.read(spark, sf_dir, "customer").selectExpr(*[f"{e.replace('::VARCHAR', '')} AS {n}" for n, e in _SUBS.items()]).where("activa")
    fresh = joined(spark, sf_dir).where(O.is_active(OFFERS) & (O.seen_at() >= OFFERS.instant - F.expr("INTERVAL 24 HOURS")))
    offers = fresh.select(F.col("id").alias("offer_id"), O.seen_at().alias("visto"), F.coalesce("region", "i_region").alias("o_region"), F.col("cargo").alias("o_cargo"), F.col("descripcion").alias("o_texto"), O.contract().alias("o_contrato"), F.coalesce("i_sector", "sector", "i_tipo").alias("o_sector"))
    order = [F.desc_nulls_last("visto"), F.asc("offer_id")]
    return AL.matches(subs, offers, {"region": ["o_region"], "termino": ["o_cargo", "o_texto"], "contrato": ["o_contrato"], "sector": ["o_sector"]}, order)


@query("SELECT count(*) AS total_suscripciones, (SELECT count(DISTINCT sub_id) FROM (" + body("j12_alert_matches") + f")) AS enviados FROM {_SUBSQL} WHERE activa")
def q17_send_alerts(spark, sf_dir):
    """What a run of the alerts does: active subscriptions, and those with something to send."""
    n = A.read(spark, sf_dir, "customer").selectExpr(f"{_SUBS['activa']} AS activa").where("activa").agg(F.count("*").alias("total_suscripciones"))
    return n.crossJoin(F.broadcast(j12_alert_matches(spark, sf_dir).agg(F.count_distinct("sub_id").alias("enviados"))))


_SECTORS = f"SELECT coalesce(i.sector, 'Sin sector') AS sector, count(*) AS total {BASE} WHERE {ACTIVE} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"
_Q18 = " UNION ALL ".join([
    sql_long("totales", body("a09_admin_totals"), [], ["total", "activas", "inactivas", "urls_rotas", "urls_sin_validar", "nuevas_24h", "activas_vencidas"]), sql_long("por_sector", _SECTORS, ["sector"], ["total"]),
    sql_long("evaluaciones", f"SELECT * EXCLUDE (ultima) FROM ({body('a10_evaluation_summary')})", [], ["instituciones", "extract_n", "reject_n", "review_n"]), sql_long("url_validez", f"SELECT * EXCLUDE (ultimo) FROM ({body('a11_url_validity')})", [], ["validas", "rotas", "sin_validar"]),
])


@query(_Q18)
def q18_admin_stats(spark, sf_dir):
    sectors = joined(spark, sf_dir).where(O.is_active(OFFERS)).groupBy(F.coalesce("i_sector", F.lit("Sin sector")).alias("sector")).agg(F.count("*").alias("total")).orderBy(F.desc("total"), "sector").limit(10)
    parts = [long_form("totales", a09_admin_totals(spark, sf_dir), []), long_form("por_sector", sectors, ["sector"]), long_form("evaluaciones", a10_evaluation_summary(spark, sf_dir).drop("ultima"), []), long_form("url_validez", a11_url_validity(spark, sf_dir).drop("ultimo"), [])]
    return reduce(DataFrame.union, parts)


_Q19 = "o.activa AND (o.url_oferta_valida OR o.url_oferta_valida IS NULL) AND o.region ILIKE '%region 1%' AND (o.cargo ILIKE '%high%' OR o.institucion_nombre ILIKE '%high%' OR i.nombre ILIKE '%high%')"


@query(f"SELECT o.id, o.cargo, coalesce(nullif(trim(o.institucion_nombre), ''), i.nombre, 'Sin institución') AS institucion_display, coalesce(i.sigla, i.nombre_corto) AS inst_sigla, coalesce(i.sector, o.sector, 'Sin sector') AS sector_real, CAST(o.fecha_cierre AS VARCHAR) AS fecha_cierre, o.url_oferta_valida, o.overall_quality_score, t.total, ceil(t.total / 20.0)::BIGINT AS paginas {BASE} CROSS JOIN (SELECT count(*) AS total {BASE} WHERE {_Q19}) t WHERE {_Q19} ORDER BY coalesce(o.fecha_scraped, o.detectada_en, o.actualizada_en) DESC NULLS LAST, o.id LIMIT 20")
def q19_admin_offers(spark, sf_dir):
    c = F.col
    has = lambda x: F.coalesce(c(x).ilike("%high%"), F.lit(False))
    rows = joined(spark, sf_dir).where(c("activa") & (c("url_oferta_valida") | c("url_oferta_valida").isNull()) & c("region").ilike("%region 1%") & (has("cargo") | has("institucion_nombre") | has("i_nombre")))
    top = rows.orderBy(F.desc_nulls_last(F.coalesce("fecha_scraped", "detectada_en", "actualizada_en")), "id").limit(20)
    shown = top.select(
        "id", "cargo", F.coalesce(O.filled(F.trim("institucion_nombre")), "i_nombre", F.lit("Sin institución")).alias("institucion_display"), F.coalesce("i_sigla", "i_nombre_corto").alias("inst_sigla"),
        F.coalesce("i_sector", "sector", F.lit("Sin sector")).alias("sector_real"), c("fecha_cierre").cast("string").alias("fecha_cierre"), "url_oferta_valida", "overall_quality_score",
    )
    return total_and_pages(shown, rows, 20)


_RUNS = "SELECT user_id % 20 AS run, 'I' || (user_id % 7)::VARCHAR AS nombre, count(*) AS encontradas, count(*) FILTER (WHERE event_type = 'purchase') AS nuevas, count(*) FILTER (WHERE event_type = 'view') AS existian, count(*) FILTER (WHERE event_type = 'error') AS errores, max(ts) AS fin FROM events GROUP BY 1, 2"


@query(f"SELECT run, max(fin) AS started_at, sum(encontradas)::BIGINT AS encontradas, sum(nuevas)::BIGINT AS nuevas, string_agg(nombre || ':' || encontradas || ':' || nuevas || ':' || existian || ':' || errores, ',' ORDER BY -nuevas, nombre) AS instituciones, count(*) AS total_con_detalle FROM ({_RUNS}) GROUP BY run ORDER BY started_at DESC, run LIMIT 20", cte=False)
def q20_run_history(spark, sf_dir):
    """Runs, newest first, with the reports of their institutions, most new ones first."""
    e = A.read(spark, sf_dir, "events")
    is_ = lambda t: F.count_if(F.col("event_type") == t)
    reports = e.groupBy((F.col("user_id") % 20).alias("run"), F.concat(F.lit("I"), F.col("user_id") % 7).alias("nombre")).agg(F.count("*").alias("encontradas"), is_("purchase").alias("nuevas"), is_("view").alias("existian"), is_("error").alias("errores"), F.max("ts").alias("fin"))
    line = F.concat_ws(":", "nombre", "encontradas", "nuevas", "existian", "errores")
    sorted_ = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("nuevas")).alias("k"), "nombre", line.alias("l")))), lambda x: x["l"])
    runs = reports.groupBy("run").agg(F.max("fin").alias("started_at"), F.sum("encontradas").alias("encontradas"), F.sum("nuevas").alias("nuevas"), F.array_join(sorted_, ",").alias("instituciones"), F.count("*").alias("total_con_detalle"))
    return runs.orderBy(F.desc("started_at"), "run").limit(20)


@query(f"SELECT e.institucion_id, coalesce(i.nombre, 'fuente') AS nombre, i.sector, e.decision, e.retry_policy, e.evaluated_at FROM (SELECT *, row_number() OVER (PARTITION BY institucion_id ORDER BY evaluated_at DESC, id DESC) AS rn FROM evaluaciones WHERE decision = 'reject') e LEFT JOIN instituciones i ON i.id = e.institucion_id WHERE rn = 1 ORDER BY e.institucion_id LIMIT 200")
def q21_latest_evaluations(spark, sf_dir):
    last = latest(A.evaluations(spark, sf_dir).where("decision = 'reject'")).orderBy("institucion_id").limit(200).select("institucion_id", "decision", "retry_policy", "evaluated_at")
    i = A.institutions(spark, sf_dir).select("id", "nombre", "sector")
    return last.join(i, last["institucion_id"] == i["id"], "left").select("institucion_id", F.coalesce("nombre", F.lit("fuente")).alias("nombre"), "sector", "decision", "retry_policy", "evaluated_at")


_FOUND = "coalesce(o.fecha_scraped, o.detectada_en)"
_QUEUE = {
    "url_rota": ("o.url_oferta_valida = FALSE", "o.url_valida_chequeada_en DESC NULLS LAST"), "sin_sector": ("coalesce(o.sector, i.sector, '') = ''", f"{_FOUND} DESC NULLS LAST"), "calidad_baja": ("o.overall_quality_score < 0.4 OR o.needs_review", "o.overall_quality_score NULLS FIRST"),
    "sin_fecha": ("o.fecha_cierre IS NULL", f"{_FOUND} DESC NULLS LAST"), "texto_corto": ("length(coalesce(o.descripcion, '')) < 80", "length(coalesce(o.descripcion, ''))"),
}


@query(" UNION ALL ".join(f"SELECT '{n}' AS tipo, id, cargo, pos, count(*) OVER () AS total FROM (SELECT o.id, o.cargo, row_number() OVER (ORDER BY {order}, o.id) AS pos {BASE} WHERE o.activa AND ({where}) QUALIFY pos <= 50)" for n, (where, order) in _QUEUE.items()))
def q24_review_queue(spark, sf_dir):
    """Five kinds of doubt, the first 50 of each in its order."""
    c = F.col
    rows = joined(spark, sf_dir).where("activa").withColumn("hallada", F.coalesce("fecha_scraped", "detectada_en")).withColumn("largo", F.length(F.coalesce("descripcion", F.lit(""))))
    kinds = {
        "url_rota": (~c("url_oferta_valida"), F.desc_nulls_last("url_valida_chequeada_en")), "sin_sector": (F.coalesce("sector", "i_sector", F.lit("")) == "", F.desc_nulls_last("hallada")),
        "calidad_baja": ((c("overall_quality_score") < 0.4) | c("needs_review"), F.asc_nulls_first("overall_quality_score")), "sin_fecha": (c("fecha_cierre").isNull(), F.desc_nulls_last("hallada")), "texto_corto": (c("largo") < 80, F.asc("largo")),
    }
    from pyspark.sql import Window

    def part(name, where, order):
        top = rows.where(where).orderBy(order, "id").limit(50)
        w = Window.orderBy(order, "id")
        return top.select(F.lit(name).alias("tipo"), "id", "cargo", F.row_number().over(w).alias("pos"), F.count("*").over(Window.partitionBy()).alias("total"))  # at most 50 rows

    return reduce(DataFrame.union, [part(n, *x) for n, x in kinds.items()])


_DIAG = {
    "url_oferta_rota": "activa AND url_oferta_valida = FALSE", "needs_review": "activa AND needs_review", "vencidas_activas": f"activa AND fecha_cierre < {D}", "descripcion_corta": "activa AND length(coalesce(descripcion, '')) < 80", "sin_sector": "activa AND sector IS NULL AND institucion_id IS NULL",
    "sin_fecha_cierre": "activa AND fecha_cierre IS NULL", "url_no_chequeada_48h": f"activa AND url_valida_chequeada_en < {NOW} - INTERVAL 48 HOUR",
}


@query(f"""SELECT *, array_to_string(list_filter([CASE WHEN vencidas_activas > 0 THEN 'warning:bulk-desactivar' END, CASE WHEN url_oferta_rota > 50 THEN 'warning:revalidar-urls' END, CASE WHEN needs_review > 0 THEN 'info:revision' END, CASE WHEN horas > 26 THEN 'error:scraper-runs' END, CASE WHEN fuentes_error > 10 THEN 'warning:evaluaciones' END], lambda x: x IS NOT NULL), ',') AS alertas,
 CASE WHEN horas > 26 THEN 'error' WHEN vencidas_activas > 0 OR url_oferta_rota > 50 OR fuentes_error > 10 THEN 'warning' ELSE 'ok' END AS nivel_global
 FROM (SELECT {', '.join(f"count(*) FILTER (WHERE {w}) AS {n}" for n, w in _DIAG.items())} FROM ofertas) CROSS JOIN (SELECT round((epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(max(evaluated_at))) / 3600.0, 1) AS horas FROM evaluaciones)
 CROSS JOIN (SELECT count(*) FILTER (WHERE e.decision = 'reject') AS fuentes_error, count(*) FILTER (WHERE e.decision IS NULL) AS fuentes_sin_evaluar, count(*) FILTER (WHERE e.evaluated_at < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY) AS fuentes_eval_antigua FROM instituciones i LEFT JOIN (SELECT * FROM {LAST} WHERE rn = 1) e ON e.institucion_id = i.id)""")
def q25_diagnosis(spark, sf_dir):
    """Counters of offers, last run and sources, with the alerts they raise. A rejected source counts as failing."""
    c = F.col
    offers = A.offers(spark, sf_dir).agg(*[F.count_if(F.expr(w.replace(NOW, "TIMESTAMP '1998-06-01 12:00:00'").replace("INTERVAL 48 HOUR", "INTERVAL 48 HOURS"))).alias(n) for n, w in _DIAG.items()])
    e = A.evaluations(spark, sf_dir)
    run = e.agg(F.round((F.unix_micros(EVENTS.instant) - F.unix_micros(F.max("evaluated_at").cast("timestamp"))) / 3.6e9, 1).alias("horas"))
    last = latest(e).select("institucion_id", "decision", "evaluated_at")
    i = A.institutions(spark, sf_dir).select("id")
    sources = i.join(last, i["id"] == last["institucion_id"], "left").agg(
        F.count_if(c("decision") == "reject").alias("fuentes_error"), F.count_if(c("decision").isNull()).alias("fuentes_sin_evaluar"), F.count_if(c("evaluated_at") < EVENTS.instant - F.expr("INTERVAL 7 DAYS")).alias("fuentes_eval_antigua")
    )
    out = offers.crossJoin(run).crossJoin(sources)  # one row each
    a = AL.alerts(c("vencidas_activas"), c("url_oferta_rota"), c("needs_review"), c("horas"), c("fuentes_error"))
    return out.withColumn("alertas", F.array_join(a["alerts"], ",")).withColumn("nivel_global", a["level"])


_S = "SELECT c_custkey AS id, lower(c_name) || '@x.cl' AS email, CASE WHEN c_custkey % 3 = 0 THEN 'Maule' END AS region, CASE WHEN c_custkey % 4 = 0 THEN 'abogado' END AS termino, CASE WHEN c_custkey % 5 = 0 THEN 'Salud' END AS sector, c_acctbal > 0 AS activa FROM customer"


@query(f"SELECT s.id, s.email, s.region, s.termino, t.* FROM (SELECT * FROM ({_S}) WHERE activa ORDER BY id DESC LIMIT 200) s CROSS JOIN (SELECT count(*) AS total, count(*) FILTER (WHERE activa) AS activas, count(*) FILTER (WHERE NOT activa) AS inactivas, count(DISTINCT lower(email)) AS emails_unicos, count(region) AS con_region, count(termino) AS con_termino, count(sector) AS con_sector FROM ({_S})) t", cte=False)
def q26_subscriptions(spark, sf_dir):
    s = A.read(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "concat(lower(c_name), '@x.cl') AS email", "CASE WHEN c_custkey % 3 = 0 THEN 'Maule' END AS region", "CASE WHEN c_custkey % 4 = 0 THEN 'abogado' END AS termino", "CASE WHEN c_custkey % 5 = 0 THEN 'Salud' END AS sector", "c_acctbal > 0 AS activa")
    n = s.agg(F.count("*").alias("total"), F.count_if("activa").alias("activas"), F.count_if(~F.col("activa")).alias("inactivas"), F.count_distinct(F.lower("email")).alias("emails_unicos"), F.count("region").alias("con_region"), F.count("termino").alias("con_termino"), F.count("sector").alias("con_sector"))
    return s.where("activa").orderBy(F.desc("id")).limit(200).select("id", "email", "region", "termino").crossJoin(F.broadcast(n))


_CSV = {"id": "o.id", "institucion": "coalesce(nullif(trim(o.institucion_nombre), ''), i.nombre, '')", "cargo": "o.cargo", "region": "o.region", "sector": "coalesce(i.sector, o.sector, '')", "tipo_contrato": "o.tipo_contrato", "fecha_cierre": "o.fecha_cierre", "activa": "o.activa", "url_oferta": "o.url_oferta", "renta_bruta_max": "o.renta_bruta_max"}


@query(f"SELECT {', '.join(f'coalesce(({e})::VARCHAR, {chr(39)}{chr(39)}) AS {n}' for n, e in _CSV.items())} {BASE} WHERE o.activa AND i.sector = 'BUILDING' ORDER BY {_FOUND} DESC NULLS LAST, o.id LIMIT 5000")
def q27_export(spark, sf_dir):
    """CSV rows: all values as text, nulls empty, 5 000 rows at most."""
    rows = joined(spark, sf_dir).where(F.col("activa") & (F.col("i_sector") == "BUILDING")).orderBy(F.desc_nulls_last(F.coalesce("fecha_scraped", "detectada_en")), "id").limit(5000)
    own = {"institucion": F.coalesce(O.filled(F.trim("institucion_nombre")), "i_nombre", F.lit("")), "sector": F.coalesce("i_sector", "sector", F.lit(""))}
    return rows.select(*[F.coalesce(own.get(n, F.col(n)).cast("string"), F.lit("")).alias(n) for n in _CSV])


@query(f"SELECT id, CASE WHEN id % 7 = 0 THEN NOT activa WHEN id % 5 = 0 AND url_oferta_valida = FALSE THEN FALSE WHEN fecha_cierre < {D} THEN FALSE ELSE activa END AS activa, CASE WHEN id % 6 = 0 THEN upper(cargo) ELSE cargo END AS cargo, CASE WHEN id % 8 = 3 THEN FALSE ELSE needs_review END AS needs_review FROM ofertas")
def q28_mutations(spark, sf_dir):
    """A toggle, a bulk switch-off of broken ones, of expired ones, an edit of white-listed fields and a review mark, in
    the order of the requests."""
    c = F.col
    o = A.offers(spark, sf_dir)
    off = ((c("id") % 5 == 0) & ~c("url_oferta_valida")) | (c("fecha_cierre") < OFFERS.day)
    active = F.when(c("id") % 7 == 0, ~c("activa")).when(off, False).otherwise(c("activa"))
    return o.select("id", active.alias("activa"), F.when(c("id") % 6 == 0, F.upper("cargo")).otherwise(c("cargo")).alias("cargo"), F.when(c("id") % 8 == 3, False).otherwise(c("needs_review")).alias("needs_review"))


_Q29 = " UNION ALL ".join([
    sql_long("by_decision", body("a16_decision_stats"), ["decision"], ["n", "pct", "mean", "median", "p25", "p75", "lo", "hi"]), sql_long("by_reason", body("a18_reason_crosstab"), ["reason"], ["publish", "review", "reject", "extract"]), sql_long("by_platform", body("a19_platform_decision"), ["platform", "decision"], ["n"]),
    sql_long("score_buckets", body("a20_histograms"), ["score", "bucket"], ["n"]), sql_long("coverage", body("a21_coverage"), [], ["records", "quality", "policy", "reasons"]),
])


@query(_Q29)
def q29_classification_audit(spark, sf_dir):
    """The audit report: decisions, reasons, platforms, score buckets and coverage."""
    parts = [
        long_form("by_decision", a16_decision_stats(spark, sf_dir), ["decision"]), long_form("by_reason", a18_reason_crosstab(spark, sf_dir), ["reason"]), long_form("by_platform", a19_platform_decision(spark, sf_dir), ["platform", "decision"]),
        long_form("score_buckets", a20_histograms(spark, sf_dir), ["score", "bucket"]), long_form("coverage", a21_coverage(spark, sf_dir), []),
    ]
    return reduce(DataFrame.union, parts)


@query("SELECT motivo, total, count(*) AS instituciones, max(n)::BIGINT AS peor, any_value(remedio) AS remedio FROM (" + body("a24_historical_audit") + ") GROUP BY 1, 2")
def q30_historical_audit(spark, sf_dir):
    from .catalog import a24_historical_audit

    return a24_historical_audit(spark, sf_dir).groupBy("motivo", "total").agg(F.count("*").alias("instituciones"), F.max("n").alias("peor"), F.max("remedio").alias("remedio"))


@query("SELECT v.check_name, v.violations, v.pct, t.total FROM (" + body("v28_quality_report") + ") v CROSS JOIN (SELECT count(*) AS total FROM ofertas) t")
def q31_data_quality(spark, sf_dir):
    from .aggregates import v28_quality_report

    return v28_quality_report(spark, sf_dir).crossJoin(F.broadcast(A.offers(spark, sf_dir).agg(F.count("*").alias("total"))))

"""Serving queries over postings: projections, filters, joins, orders, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plazamill.context import EVENTS, OFFERS
from plazamill.operators import offers as O
from plazamill.sources import adapters as A

from .base import query

D = "DATE '1998-06-01'"
STATUS = f"""CASE WHEN NOT coalesce(o.activa, TRUE) THEN 'closed' WHEN lower(coalesce(o.estado, '')) IN ('cerrada','cerrado','cerrada_manual','vencido','finalizada','closed','expired') THEN 'closed'
 WHEN coalesce(o.fecha_inicio, o.fecha_publicacion) > {D} THEN 'upcoming' WHEN o.fecha_cierre < {D} THEN 'closed' WHEN o.fecha_cierre = {D} THEN 'closing_today' ELSE 'active' END"""
ACTIVE = f"({STATUS}) IN ('active', 'closing_today')"
BASE = "FROM ofertas o LEFT JOIN instituciones i ON i.id = o.institucion_id"
SEEN = "coalesce(o.fecha_scraped, o.detectada_en, o.actualizada_en, o.creada_en)"
CONTRACT = "coalesce(nullif(o.tipo_contrato, ''), nullif(o.tipo_cargo, ''))"
NOW = "TIMESTAMP '1998-06-01 12:00:00'"


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.with_institution(A.offers(spark, sf_dir), A.institutions(spark, sf_dir))


@query(f"SELECT o.id, {STATUS} AS status FROM ofertas o")
def f01_offer_status(spark, sf_dir):
    return A.offers(spark, sf_dir).select("id", O.status(OFFERS).alias("status"))


@query(f"SELECT o.id FROM ofertas o WHERE {ACTIVE}")
def f02_active_offers(spark, sf_dir):
    return A.offers(spark, sf_dir).where(O.is_active(OFFERS)).select("id")


@query(f"""SELECT o.id {BASE} WHERE {ACTIVE} AND coalesce(o.region, i.region, '') ILIKE '%region 1%' AND ({CONTRACT} ILIKE '%planta%' OR {CONTRACT} ILIKE '%contrata%') AND (o.renta_bruta_min >= 500000 OR o.renta_bruta_max >= 500000)""")
def f03_filter_builder(spark, sf_dir):
    return joined(spark, sf_dir).where(O.filters(OFFERS, region="region 1", kind="planta, contrata", pay_from=500000)).select("id")


@query(f"SELECT o.id {BASE} WHERE (o.cargo ILIKE '%high%' OR coalesce(i.nombre, o.institucion_nombre, '') ILIKE '%high%' OR coalesce(o.descripcion, '') ILIKE '%high%')")
def f04_free_text(spark, sf_dir):
    return joined(spark, sf_dir).where(O.filters(OFFERS, q="high", only_active=False)).select("id")


@query(f"SELECT o.id {BASE} WHERE coalesce(i.sector, o.sector, i.tipo, '') ILIKE '%build%'")
def f05_contains_sector(spark, sf_dir):
    return joined(spark, sf_dir).where(O.filters(OFFERS, sector="build", only_active=False)).select("id")


@query(f"SELECT o.id {BASE} WHERE (o.ciudad ILIKE '%Comuna 1%' OR o.ciudad ILIKE '%Comuna 22%')")
def f06_towns_list(spark, sf_dir):
    return joined(spark, sf_dir).where(O.filters(OFFERS, towns="Comuna 1, Comuna 22", city="Comuna 5", only_active=False)).select("id")


@query("SELECT o.id FROM ofertas o WHERE o.renta_bruta_min >= 2000000 OR o.renta_bruta_max >= 2000000")
def f07_pay_at_least(spark, sf_dir):
    return A.offers(spark, sf_dir).where(O.filters(OFFERS, pay_from=2000000, only_active=False)).select("id")


@query(f"SELECT o.id FROM ofertas o WHERE o.fecha_cierre BETWEEN {D} AND {D} + 5")
def f08_closing_soon(spark, sf_dir):
    return A.offers(spark, sf_dir).where(O.filters(OFFERS, closing_soon=True, only_active=False)).select("id")


@query(f"SELECT o.id FROM ofertas o WHERE {SEEN} >= {NOW} - INTERVAL 48 HOUR")
def f09_new_48h(spark, sf_dir):
    return A.offers(spark, sf_dir).where(O.filters(OFFERS, fresh=True, only_active=False)).select("id")


@query(f"SELECT o.id {BASE} WHERE o.activa AND (o.url_oferta_valida OR o.url_oferta_valida IS NULL) AND i.sector = 'BUILDING'")
def f10_admin_tristate(spark, sf_dir):
    ok = F.col("url_oferta_valida") | F.col("url_oferta_valida").isNull()
    return joined(spark, sf_dir).where(F.col("activa") & ok & (F.col("i_sector") == "BUILDING")).select("id")


@query(f"SELECT o.id, o.fecha_cierre {BASE} WHERE {ACTIVE} AND coalesce(o.region, i.region) IN ('Region 1', 'Region 2', 'ASIA') ORDER BY o.fecha_cierre NULLS LAST, o.id DESC LIMIT 30", dates=("fecha_cierre",))
def f11_landing_aliases(spark, sf_dir):
    rows = joined(spark, sf_dir).where(O.is_active(OFFERS) & F.coalesce("region", "i_region").isin("Region 1", "Region 2", "ASIA"))
    return rows.orderBy(F.asc_nulls_last("fecha_cierre"), F.desc("id")).limit(30).select("id", "fecha_cierre")


@query("SELECT cargo, count(*) AS total FROM ofertas WHERE cargo ILIKE '1-%' OR cargo ILIKE '2-h%' GROUP BY cargo ORDER BY total DESC, cargo LIMIT 10")
def f12_prefix_suggestions(spark, sf_dir):
    rows = A.offers(spark, sf_dir).where(F.col("cargo").ilike("1-%") | F.col("cargo").ilike("2-h%"))
    return rows.groupBy("cargo").agg(F.count("*").alias("total")).orderBy(F.desc("total"), "cargo").limit(10)


@query("""SELECT count(*) FILTER (WHERE url_oferta_valida = FALSE) AS broken, count(*) FILTER (WHERE coalesce(sector, '') = '') AS no_sector,
 count(*) FILTER (WHERE needs_review OR overall_quality_score < 0.6) AS low_quality, count(*) FILTER (WHERE fecha_cierre IS NULL) AS undated, count(*) FILTER (WHERE length(coalesce(descripcion, '')) < 80) AS short_text FROM ofertas WHERE activa""")
def f13_review_queue(spark, sf_dir):
    c = F.col
    return A.offers(spark, sf_dir).where("activa").agg(
        F.count_if(~c("url_oferta_valida")).alias("broken"),
        F.count_if(F.coalesce("sector", F.lit("")) == "").alias("no_sector"),
        F.count_if(c("needs_review") | (c("overall_quality_score") < 0.6)).alias("low_quality"),
        F.count_if(c("fecha_cierre").isNull()).alias("undated"),
        F.count_if(F.length(F.coalesce("descripcion", F.lit(""))) < 80).alias("short_text"),
    )


@query(f"SELECT o.id, o.url_valida_chequeada_en FROM ofertas o WHERE o.activa AND o.url_oferta IS NOT NULL AND (o.url_valida_chequeada_en IS NULL OR o.url_valida_chequeada_en < {NOW} - INTERVAL 72 HOUR) ORDER BY o.url_valida_chequeada_en NULLS FIRST, o.id LIMIT 500")
def f14_url_recheck(spark, sf_dir):
    at = F.col("url_valida_chequeada_en")
    rows = A.offers(spark, sf_dir).where(F.col("activa") & F.col("url_oferta").isNotNull() & (at.isNull() | (at < OFFERS.instant - F.expr("INTERVAL 72 HOURS"))))
    return rows.orderBy(F.asc_nulls_first("url_valida_chequeada_en"), "id").limit(500).select("id", "url_valida_chequeada_en")


CHECKS = {
    "renta_min_fuera": "renta_bruta_min IS NOT NULL AND NOT renta_bruta_min BETWEEN 300000 AND 20000000",
    "renta_max_fuera": "renta_bruta_max IS NOT NULL AND NOT renta_bruta_max BETWEEN 300000 AND 20000000",
    "renta_invertida": "renta_bruta_min > renta_bruta_max",
    "fechas_invertidas": "fecha_cierre < fecha_publicacion",
    "publicacion_fuera": "fecha_publicacion < DATE '1996-01-01' OR fecha_publicacion > DATE '1999-06-01'",
    "horas_fuera": "horas_semanales IS NOT NULL AND NOT horas_semanales BETWEEN 1 AND 88",
}


@query("SELECT " + ", ".join(f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in CHECKS.items()) + " FROM ofertas")
def f15_quality_violations(spark, sf_dir):
    return A.offers(spark, sf_dir).agg(*[F.count_if(F.expr(c)).alias(n) for n, c in CHECKS.items()])


@query("SELECT id FROM ofertas WHERE regexp_matches(url_oferta, '^https?://[^/ ]+')")
def f16_http_url(spark, sf_dir):
    url = F.col("url_oferta")
    good = F.try_parse_url(url, F.lit("HOST")).isNotNull() & F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https")
    return A.offers(spark, sf_dir).where(good).select("id")


@query("SELECT id FROM ofertas o WHERE activa AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.id AND l.l_returnflag = 'R')")
def f17_not_seen(spark, sf_dir):
    seen = A.read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return A.offers(spark, sf_dir).where("activa").join(seen, "id", "left_anti").select("id")


@query(f"SELECT o.id {BASE} WHERE {ACTIVE} AND o.institucion_id = 100 OR ({ACTIVE} AND o.area_profesional ILIKE '%area 3%')")
def f20_institution_or_area(spark, sf_dir):
    j = joined(spark, sf_dir)
    return j.where(O.filters(OFFERS, institution=100) | O.filters(OFFERS, area="area 3")).select("id")


P01 = f"""SELECT o.id, o.institucion_id, coalesce(nullif(trim(o.institucion_nombre), ''), i.nombre, 'Sin institución') AS institucion, coalesce(i.sigla, i.nombre_corto) AS sigla, coalesce(o.cargo, 'Sin cargo') AS cargo,
 coalesce(o.descripcion, '') AS descripcion, coalesce(o.requisitos, o.requisitos_texto, '') AS requisitos, {CONTRACT} AS tipo_contrato, coalesce(o.region, i.region) AS region, o.ciudad, coalesce(i.sector, o.sector, i.tipo) AS sector,
 o.renta_bruta_min, o.renta_bruta_max, o.grado_eus, coalesce(o.jornada, CASE WHEN o.horas_semanales IS NOT NULL THEN o.horas_semanales::VARCHAR || ' hrs / semana' END) AS jornada, o.area_profesional, o.fecha_publicacion, o.fecha_inicio, o.fecha_cierre,
 coalesce(o.url_oferta, o.url_original) AS url_oferta, coalesce(o.url_bases, o.url_original, o.url_oferta) AS url_bases, o.url_oferta_valida, {STATUS} AS estado, {SEEN} AS fecha_scraped, coalesce(o.actualizada_en, o.creada_en) AS fecha_actualizado,
 i.plataforma_empleo AS plataforma, i.url_empleo AS institucion_url_empleo"""


@query(f"{P01} {BASE}", dates=("fecha_publicacion", "fecha_inicio", "fecha_cierre"))
def p01_canonical_projection(spark, sf_dir):
    return O.projection(joined(spark, sf_dir), OFFERS)


@query(f"""SELECT id, CASE WHEN NOT activa THEN 'cerrado' WHEN fecha_cierre < {D} THEN 'vencido' ELSE 'activo' END AS estado, greatest(0, coalesce(fecha_cierre - {D}, 0)) AS dias_restantes,
 CASE WHEN fecha_cierre IS NULL THEN 'sin_plazo' WHEN fecha_cierre - {D} <= 2 THEN 'urgente' WHEN fecha_cierre - {D} <= 5 THEN 'pronto' ELSE 'vigente' END AS semaforo FROM ofertas""")
def p07_state_view(spark, sf_dir):
    return O.state_view(A.offers(spark, sf_dir), OFFERS)


@query(f"SELECT o.id, o.fecha_cierre - {D} AS dias_restantes, {STATUS} AS estado_normalizado, CASE {STATUS} WHEN 'active' THEN 'activo' WHEN 'closing_today' THEN 'activo' WHEN 'upcoming' THEN 'proximo' ELSE 'cerrado' END AS estado FROM ofertas o")
def p08_serialised(spark, sf_dir):
    s = O.status(OFFERS)
    return A.offers(spark, sf_dir).select("id", F.datediff("fecha_cierre", OFFERS.day).alias("dias_restantes"), s.alias("estado_normalizado"), O.legacy(s).alias("estado"))


@query(f"SELECT o.id, o.cargo, i.nombre AS institucion, o.activa, o.fecha_cierre, o.url_oferta_valida {BASE} ORDER BY o.fecha_cierre NULLS LAST, o.id LIMIT 50", dates=("fecha_cierre",))
def p10_admin_list(spark, sf_dir):
    rows = joined(spark, sf_dir).orderBy(F.asc_nulls_last("fecha_cierre"), "id").limit(50)
    return rows.select("id", "cargo", F.col("i_nombre").alias("institucion"), "activa", "fecha_cierre", "url_oferta_valida")


@query("SELECT id, coalesce(detectada_en, creada_en) AS started FROM ofertas")
def p11_present_columns(spark, sf_dir):
    rows = A.offers(spark, sf_dir)
    return rows.select("id", O.present(rows, "started_at", "detectada_en", "creada_en").alias("started"))


@query(f"SELECT o.id, o.institucion_id, i.nombre {BASE}")
def j01_offer_institution(spark, sf_dir):
    return joined(spark, sf_dir).select("id", "institucion_id", F.col("i_nombre").alias("nombre"))


@query(f"SELECT i.id, i.nombre, count(o.id) FILTER (WHERE {ACTIVE}) AS activas FROM instituciones i LEFT JOIN ofertas o ON o.institucion_id = i.id GROUP BY i.id, i.nombre")
def j02_institution_counts(spark, sf_dir):
    n = A.offers(spark, sf_dir).where(O.is_active(OFFERS) & F.col("institucion_id").isNotNull()).groupBy(F.col("institucion_id").alias("id")).agg(F.count("*").alias("activas"))
    return A.institutions(spark, sf_dir).join(n, "id", "left").select("id", "nombre", F.coalesce("activas", F.lit(0)).alias("activas"))


@query("SELECT e.id, e.institucion_id, i.nombre FROM evaluaciones e LEFT JOIN instituciones i ON i.id = e.institucion_id")
def j03_evaluation_institution(spark, sf_dir):
    return A.evaluations(spark, sf_dir).join(A.institutions(spark, sf_dir).select(F.col("id").alias("institucion_id"), "nombre"), "institucion_id", "left").select("id", "institucion_id", "nombre")


def latest(evaluations: DataFrame) -> DataFrame:
    """Per institution its newest evaluation; ties to the larger id."""
    row = F.struct(*[F.col(c) for c in evaluations.columns])
    return evaluations.groupBy(F.col("institucion_id").alias("__k")).agg(F.max_by(row, F.struct("evaluated_at", "id")).alias("r")).select("r.*")


@query("SELECT i.id, e.decision, e.evaluated_at FROM instituciones i LEFT JOIN LATERAL (SELECT decision, evaluated_at FROM evaluaciones x WHERE x.institucion_id = i.id ORDER BY evaluated_at DESC, x.id DESC LIMIT 1) e ON TRUE")
def j04_lateral_latest(spark, sf_dir):
    last = latest(A.evaluations(spark, sf_dir)).select("institucion_id", "decision", "evaluated_at")
    i = A.institutions(spark, sf_dir)
    return i.join(last, i["id"] == last["institucion_id"], "left").select("id", "decision", "evaluated_at")


@query(f"SELECT i.id, (SELECT count(*) FROM ofertas o WHERE o.institucion_id = i.id AND {ACTIVE}) AS oferta_count FROM instituciones i WHERE (SELECT count(*) FROM ofertas o WHERE o.institucion_id = i.id AND {ACTIVE}) = 0")
def j05_institutions_without_offers(spark, sf_dir):
    rows = j02_institution_counts(spark, sf_dir)
    return rows.where("activas = 0").select("id", F.col("activas").alias("oferta_count"))


@query(f"SELECT i.id FROM instituciones i WHERE EXISTS (SELECT 1 FROM ofertas o WHERE o.institucion_id = i.id AND {ACTIVE})")
def j06_institutions_with_offers(spark, sf_dir):
    live = A.offers(spark, sf_dir).where(O.is_active(OFFERS)).select(F.col("institucion_id").alias("id"))
    return A.institutions(spark, sf_dir).join(live, "id", "left_semi").select("id")


@query("SELECT o.id FROM ofertas o WHERE o.fuente_id = 2 AND o.activa AND o.id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O')")
def j07_not_any_seen(spark, sf_dir):
    seen = A.read(spark, sf_dir, "lineitem").where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("id"))
    return A.offers(spark, sf_dir).where("fuente_id = 2 AND activa").join(seen, "id", "left_anti").select("id")


def _page(order: str):
    def run(spark, sf_dir):
        return O.page(A.offers(spark, sf_dir).where(O.is_active(OFFERS)), O.listing_order(order, OFFERS), 2, 25).select("id")

    return run


_ORDERS = {
    "cierre": "fecha_cierre", "recientes": "fecha_publicacion DESC NULLS LAST", "renta_desc": "greatest(coalesce(renta_bruta_max, renta_bruta_min), coalesce(renta_bruta_min, renta_bruta_max)) DESC NULLS LAST",
    "renta_asc": "least(coalesce(renta_bruta_min, renta_bruta_max), coalesce(renta_bruta_max, renta_bruta_min)) NULLS LAST", "cargo": "cargo NULLS LAST", "institucion": "institucion_nombre NULLS LAST",
}
for _name, _sql in _ORDERS.items():
    _f = _page(_name)
    _f.__name__ = f"o01_order_{_name}"
    query(f"SELECT id FROM ofertas o WHERE {ACTIVE} ORDER BY CASE WHEN fecha_cierre IS NULL THEN 1 ELSE 0 END, {_sql}, id LIMIT 25 OFFSET 25")(_f)


@query(f"SELECT count(*) AS total, ceil(count(*) / 20.0)::BIGINT AS paginas FROM ofertas o WHERE {ACTIVE}")
def o03_page_count(spark, sf_dir):
    return A.offers(spark, sf_dir).where(O.is_active(OFFERS)).agg(F.count("*").alias("total"), F.ceil(F.count("*") / 20).alias("paginas"))


@query(f"SELECT o.id, o.fecha_cierre FROM ofertas o WHERE {STATUS} = 'closed' ORDER BY o.fecha_cierre DESC NULLS LAST, o.id LIMIT 20 OFFSET 40", dates=("fecha_cierre",))
def o04_history(spark, sf_dir):
    rows = A.offers(spark, sf_dir).where(O.filters(OFFERS, only_active=False, only_closed=True))
    return O.page(rows, [F.desc_nulls_last("fecha_cierre"), F.asc("id")], 3, 20).select("id", "fecha_cierre")


@query("SELECT id, overall_quality_score FROM ofertas WHERE activa ORDER BY overall_quality_score NULLS FIRST, id LIMIT 40")
def o05_nulls_first(spark, sf_dir):
    return A.offers(spark, sf_dir).where("activa").orderBy(F.asc_nulls_first("overall_quality_score"), "id").limit(40).select("id", "overall_quality_score")


@query(f"SELECT o.id FROM ofertas o WHERE {ACTIVE} ORDER BY o.fecha_cierre NULLS LAST, o.id DESC LIMIT 30")
def o06_landing_top(spark, sf_dir):
    return A.offers(spark, sf_dir).where(O.is_active(OFFERS)).orderBy(F.asc_nulls_last("fecha_cierre"), F.desc("id")).limit(30).select("id")


@query(f"SELECT o.id FROM ofertas o WHERE {ACTIVE} ORDER BY o.id LIMIT 10000")
def o08_index_feed_cap(spark, sf_dir):
    return A.offers(spark, sf_dir).where(O.is_active(OFFERS)).orderBy("id").limit(10_000).select("id")


@query(f"SELECT '/oferta/' || o.id::VARCHAR AS loc, strftime(coalesce(o.actualizada_en, o.creada_en), '%Y-%m-%d') AS lastmod, '0.8' AS priority FROM ofertas o WHERE {ACTIVE} UNION ALL SELECT '/institucion/' || i.id::VARCHAR, NULL, '0.6' FROM instituciones i WHERE EXISTS (SELECT 1 FROM ofertas o WHERE o.institucion_id = i.id AND {ACTIVE})")
def x10_sitemap(spark, sf_dir):
    live = A.offers(spark, sf_dir).where(O.is_active(OFFERS))
    offers = live.select(F.concat(F.lit("/oferta/"), F.col("id")).alias("loc"), F.date_format(F.coalesce("actualizada_en", "creada_en"), "yyyy-MM-dd").alias("lastmod"), F.lit("0.8").alias("priority"))
    places = j06_institutions_with_offers(spark, sf_dir).select(F.concat(F.lit("/institucion/"), F.col("id")).alias("loc"), F.lit(None).cast("string").alias("lastmod"), F.lit("0.6").alias("priority"))
    return offers.unionByName(places)


@query("SELECT id, coalesce(cargo, '') AS cargo, coalesce(institucion_nombre, '') AS institucion, coalesce(renta_bruta_min::VARCHAR, '') AS renta_min FROM ofertas ORDER BY id LIMIT 5000")
def x08_export_rows(spark, sf_dir):
    rows = A.offers(spark, sf_dir).orderBy("id").limit(5000)
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return rows.select("id", blank("cargo").alias("cargo"), blank("institucion_nombre").alias("institucion"), blank("renta_bruta_min").alias("renta_min"))


@query(f"SELECT o.id, coalesce(o.cargo, 'Sin cargo') AS cargo, coalesce(o.region, i.region) AS region, {ACTIVE} AS activo {BASE}")
def x09_index_documents(spark, sf_dir):
    return joined(spark, sf_dir).select("id", F.coalesce("cargo", F.lit("Sin cargo")).alias("cargo"), F.coalesce("region", "i_region").alias("region"), O.is_active(OFFERS).alias("activo"))


@query("SELECT id, json_extract_string(signals_json, '$.k')::BIGINT AS k, quality_score FROM evaluaciones WHERE evaluated_at >= TIMESTAMP '2024-01-20 00:00:00' ORDER BY evaluated_at DESC, id DESC LIMIT 200")
def x06_events_since(spark, sf_dir):
    rows = A.evaluations(spark, sf_dir).where(F.col("evaluated_at") >= EVENTS.instant - F.expr("INTERVAL 11 DAYS"))
    return rows.orderBy(F.desc("evaluated_at"), F.desc("id")).limit(200).select("id", F.get_json_object("signals_json", "$.k").cast("long").alias("k"), "quality_score")

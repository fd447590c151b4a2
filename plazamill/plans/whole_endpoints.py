"""Search, statistics, institution and source endpoints with all their columns, totals and parts.

A payload of several parts comes as rows (parte, clave, ...), one part after another.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plazamill.context import OFFERS
from plazamill.operators import offers as O
from plazamill.sources import adapters as A

from .base import query
from .endpoints import total_and_pages
from .listing import ACTIVE, BASE, CONTRACT, D, NOW, P01, SEEN, joined, latest
from .policy import LAST

DAYS = ("fecha_publicacion", "fecha_inicio", "fecha_cierre")
_UNDATED = "CASE WHEN fecha_cierre IS NULL THEN 1 ELSE 0 END"
_LEGACY = "CASE estado WHEN 'active' THEN 'activo' WHEN 'closing_today' THEN 'activo' WHEN 'upcoming' THEN 'proximo' ELSE 'cerrado' END"


def sql_page(where: str, order: str, size: int, offset: int) -> str:
    rows = f"SELECT * FROM ({P01} {BASE} WHERE {where}) ORDER BY {order} LIMIT {size} OFFSET {offset}"
    return f"SELECT p.* REPLACE ({_LEGACY} AS estado), estado AS estado_normalizado, fecha_cierre - {D} AS dias_restantes, t.total, ceil(t.total / {size}.0)::BIGINT AS paginas FROM ({rows}) p CROSS JOIN (SELECT count(*) AS total {BASE} WHERE {where}) t"


def offer_page(rows: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """A page of serialised postings with the total: the order is taken over the canonical row, as shown."""
    shown = O.page(O.projection(rows, OFFERS), order, number, size)
    columns = [c for c in shown.columns if c != "estado"]
    served = shown.select(*columns, O.legacy(F.col("estado")).alias("estado"), F.col("estado").alias("estado_normalizado"), F.datediff("fecha_cierre", OFFERS.day).alias("dias_restantes"))
    return total_and_pages(served, rows, size)


_FOUND = f"{ACTIVE} AND coalesce(i.sector, o.sector, i.tipo, '') ILIKE '%auto%' AND (o.renta_bruta_min >= 900000 OR o.renta_bruta_max >= 900000)"
_BY_PAY = f"{_UNDATED}, least(coalesce(renta_bruta_min, renta_bruta_max), coalesce(renta_bruta_max, renta_bruta_min)) NULLS LAST, id DESC"


@query(sql_page(_FOUND, _BY_PAY, 20, 20), dates=DAYS)
def q01_offer_page(spark, sf_dir):
    """Search by sector and pay, the second page by ascending pay."""
    rows = joined(spark, sf_dir).where(O.filters(OFFERS, sector="auto", pay_from=900_000))
    low = F.least(F.coalesce("renta_bruta_min", "renta_bruta_max"), F.coalesce("renta_bruta_max", "renta_bruta_min"))
    return offer_page(rows, [F.col("fecha_cierre").isNull().cast("int"), low.asc_nulls_last(), F.desc("id")], 2, 20)


@query(sql_page(f"o.institucion_id = 100 AND {ACTIVE}", f"{_UNDATED}, fecha_cierre NULLS LAST, fecha_scraped DESC NULLS LAST, id", 20, 0), dates=DAYS)
def q05_institution_page(spark, sf_dir):
    rows = joined(spark, sf_dir).where((F.col("institucion_id") == 100) & O.is_active(OFFERS))
    return offer_page(rows, [F.col("fecha_cierre").isNull().cast("int"), F.asc_nulls_last("fecha_cierre"), F.desc_nulls_last("fecha_scraped"), F.asc("id")], 1, 20)


_TEXT = "strftime(max({seen}), '%Y-%m-%d %H:%M:%S')"


@query(f"""SELECT 'conteos' AS parte, 'activas_hoy' AS clave, count(*) FILTER (WHERE {ACTIVE}) AS total, NULL::BIGINT AS nuevas, NULL AS texto FROM ofertas o
 UNION ALL SELECT 'conteos', 'nuevas_48h', count(*) FILTER (WHERE {SEEN} >= {NOW} - INTERVAL 48 HOUR AND {ACTIVE}), NULL, NULL FROM ofertas o UNION ALL SELECT 'conteos', 'cierran_hoy', count(*) FILTER (WHERE fecha_cierre = {D} AND {ACTIVE}), NULL, NULL FROM ofertas o
 UNION ALL SELECT 'conteos', 'instituciones_activas', count(DISTINCT institucion_id) FILTER (WHERE {ACTIVE}), NULL, NULL FROM ofertas o UNION ALL SELECT 'ultima_actualizacion', '', NULL, NULL, {_TEXT.format(seen=SEEN)} FROM ofertas o
 UNION ALL SELECT * FROM (SELECT 'por_sector', coalesce(i.sector, o.sector, i.tipo, 'Sin sector') AS s, count(*) AS n, NULL, NULL {BASE} WHERE {ACTIVE} GROUP BY 2 ORDER BY n DESC, s LIMIT 8)
 UNION ALL SELECT 'historico_mensual', strftime(date_trunc('month', {SEEN}), '%Y-%m'), count(*), NULL, NULL FROM ofertas o WHERE {SEEN} >= {NOW} - INTERVAL 12 MONTH GROUP BY 2
 UNION ALL SELECT * FROM (SELECT 'mas_activas', coalesce(i.id::VARCHAR, ''), count(*) AS n, count(*) FILTER (WHERE {SEEN} >= {NOW} - INTERVAL 7 DAY) AS w, coalesce(i.nombre, 'Sin institucion') AS nombre {BASE} WHERE {ACTIVE} GROUP BY i.id, i.nombre ORDER BY n DESC, w DESC, nombre LIMIT 5)""")
def q03_site_statistics(spark, sf_dir):
    """The five parts of the site's statistics: counts, last change, sectors, months, most active institutions."""
    seen, active = O.seen_at(), O.is_active(OFFERS)
    offers, both = A.offers(spark, sf_dir), joined(spark, sf_dir).where(active)
    part = lambda rows, name, key, total=None, fresh=None, text=None: rows.select(F.lit(name).alias("parte"), key.cast("string").alias("clave"), *[(F.lit(None) if c is None else c).cast(t).alias(n) for c, t, n in ((total, "long", "total"), (fresh, "long", "nuevas"), (text, "string", "texto"))])
    ago = lambda x: OFFERS.instant - F.expr(f"INTERVAL {x}")
    n = offers.agg(
        F.count_if(active).alias("activas_hoy"), F.count_if((seen >= ago("48 HOURS")) & active).alias("nuevas_48h"), F.count_if((F.col("fecha_cierre") == OFFERS.day) & active).alias("cierran_hoy"),
        F.count_distinct(F.when(active, F.col("institucion_id"))).alias("instituciones_activas"), F.max(seen).alias("ultima"),
    )
    counts = [part(n, "conteos", F.lit(c), F.col(c)) for c in ("activas_hoy", "nuevas_48h", "cierran_hoy", "instituciones_activas")]
    sectors = both.groupBy(F.coalesce("i_sector", "sector", "i_tipo", F.lit("Sin sector")).alias("s")).count().orderBy(F.desc("count"), "s").limit(8)
    months = offers.where(seen >= ago("12 MONTHS")).groupBy(F.date_format(seen, "yyyy-MM").alias("m")).count()
    most = both.groupBy("i_id", F.coalesce("i_nombre", F.lit("Sin institucion")).alias("nombre")).agg(F.count("*").alias("n"), F.count_if(seen >= ago("7 DAYS")).alias("w")).orderBy(F.desc("n"), F.desc("w"), "nombre").limit(5)
    parts = [
        *counts, part(n, "ultima_actualizacion", F.lit(""), text=F.date_format("ultima", "yyyy-MM-dd HH:mm:ss")), part(sectors, "por_sector", F.col("s"), F.col("count")), part(months, "historico_mensual", F.col("m"), F.col("count")),
        part(most, "mas_activas", F.coalesce(F.col("i_id").cast("string"), F.lit("")), F.col("n"), F.col("w"), F.col("nombre")),
    ]
    return reduce(DataFrame.unionByName, parts)


_OWN = "FROM ofertas o WHERE institucion_id = 100"


@query(f"""SELECT 'total_historico' AS parte, '' AS clave, count(*)::DOUBLE AS valor {_OWN} UNION ALL SELECT 'promedio_por_mes', '', coalesce(round(avg(n), 2), 0) FROM (SELECT count(*) AS n {_OWN} GROUP BY date_trunc('month', {SEEN}))
 UNION ALL SELECT * FROM (SELECT 'tipos_contrato_frecuentes', coalesce({CONTRACT}, 'sin_dato') AS t, count(*)::DOUBLE AS n {_OWN} GROUP BY 2 ORDER BY n DESC, t LIMIT 5) UNION ALL SELECT * FROM (SELECT 'cargos_frecuentes', cargo, count(*)::DOUBLE AS n {_OWN} GROUP BY cargo ORDER BY n DESC, cargo NULLS LAST LIMIT 10)""")
def q06_institution_statistics(spark, sf_dir):
    """The four parts of an institution's statistics: all postings, monthly average, contracts and titles."""
    own = A.offers(spark, sf_dir).where("institucion_id = 100")
    part = lambda rows, name, key, value: rows.select(F.lit(name).alias("parte"), key.alias("clave"), value.cast("double").alias("valor"))
    months = own.groupBy(F.date_trunc("month", O.seen_at()).alias("m")).count().agg(F.coalesce(F.round(F.avg("count"), 2), F.lit(0.0)).alias("v"))
    kinds = own.groupBy(F.coalesce(O.contract(), F.lit("sin_dato")).alias("t")).count().orderBy(F.desc("count"), "t").limit(5)
    titles = own.groupBy("cargo").count().orderBy(F.desc("count"), F.asc_nulls_last("cargo")).limit(10)
    parts = [part(own.agg(F.count("*").alias("v")), "total_historico", F.lit(""), F.col("v")), part(months, "promedio_por_mes", F.lit(""), F.col("v")), part(kinds, "tipos_contrato_frecuentes", F.col("t"), F.col("count")), part(titles, "cargos_frecuentes", F.col("cargo"), F.col("count"))]
    return reduce(DataFrame.unionByName, parts)


_SHOWN = ("id", "nombre", "sigla", "sector", "region", "url_empleo", "plataforma_empleo")
#: What an evaluation says of its source; the events table has its decision, retry policy, score, time, platform, reason.
_SAID = {"platform": "recommended_extractor", "retry_policy": "retry_policy", "quality_score": "confidence", "reason": "availability"}


@query(f"""SELECT {", ".join(f"i.{c}" for c in _SHOWN)}, coalesce(e.decision, 'sin_evaluar') AS ultima_decision, {", ".join(f"e.{a} AS {b}" for a, b in _SAID.items())}, e.evaluated_at AS ultima_evaluacion, coalesce(n.n, 0) AS oferta_count FROM instituciones i
 LEFT JOIN (SELECT * FROM {LAST} WHERE rn = 1) e ON e.institucion_id = i.id LEFT JOIN (SELECT institucion_id, count(*) AS n FROM ofertas WHERE activa GROUP BY 1) n ON n.institucion_id = i.id WHERE coalesce(n.n, 0) > 0 AND i.sector = 'BUILDING' ORDER BY oferta_count DESC, i.nombre""")
def q22_source_list(spark, sf_dir):
    """Sources of a sector that have active postings, each with its latest evaluation."""
    i = A.institutions(spark, sf_dir).where("sector = 'BUILDING'").select(*_SHOWN)
    counts = A.offers(spark, sf_dir).where("activa").groupBy(F.col("institucion_id").alias("__i")).agg(F.count("*").alias("oferta_count"))
    last = latest(A.evaluations(spark, sf_dir)).select(F.col("institucion_id").alias("__e"), F.col("decision"), *[F.col(a).alias(f"__{b}") for a, b in _SAID.items()], F.col("evaluated_at").alias("ultima_evaluacion"))
    rows = i.join(counts, F.col("id") == F.col("__i")).join(last, F.col("id") == F.col("__e"), "left")
    return rows.select(*_SHOWN, F.coalesce("decision", F.lit("sin_evaluar")).alias("ultima_decision"), *[F.col(f"__{b}").alias(b) for b in _SAID.values()], "ultima_evaluacion", "oferta_count").orderBy(F.desc("oferta_count"), "nombre")


_INST = ("nombre", "sigla", "nombre_corto", "sector", "tipo", "region", "url_empleo", "plataforma_empleo", "activa")
_EVAL = ("decision", "platform", "retry_policy", "quality_score", "reason", "evaluated_at")
_LAST10 = ("cargo", "activa", "estado", "fecha_cierre", "url_oferta_valida", "fecha_scraped")


def _said(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')" if column in ("evaluated_at", "fecha_scraped") else f"lower({column}::VARCHAR)"


def _sql_detail(part: str, columns: tuple[str, ...], source: str, number: str) -> str:
    return " UNION ALL ".join(f"SELECT '{part}' AS parte, {number} AS n, '{c}' AS campo, {_said(c)} AS valor FROM ({source})" for c in columns)


@query(f"""{_sql_detail('institucion', _INST, 'SELECT * FROM instituciones WHERE id = 100', '1')} UNION ALL {_sql_detail('evaluacion', _EVAL, f'SELECT * FROM {LAST} WHERE rn = 1 AND institucion_id = 100', '1')} UNION ALL
 {_sql_detail('ultimas_ofertas', ('id', *_LAST10), 'SELECT *, row_number() OVER (ORDER BY coalesce(fecha_scraped, detectada_en) DESC NULLS LAST, id DESC) AS n FROM ofertas WHERE institucion_id = 100 QUALIFY n <= 10', 'n')}""")
def q23_source_detail(spark, sf_dir):
    """A source: its row, its latest evaluation and its last ten postings, field by field, values as lower-case text."""

    def fields(rows: DataFrame, part: str, columns, number) -> DataFrame:
        said = lambda c: F.lower(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") if dict(rows.dtypes)[c].startswith("timestamp") else F.col(c).cast("string"))
        each = F.array(*[F.struct(F.lit(c).alias("campo"), said(c).alias("valor")) for c in columns])
        return rows.select(F.lit(part).alias("parte"), number.cast("long").alias("n"), F.inline(each))

    i = A.institutions(spark, sf_dir).where("id = 100")
    e = latest(A.evaluations(spark, sf_dir).where("institucion_id = 100"))
    last = A.offers(spark, sf_dir).where("institucion_id = 100").orderBy(F.coalesce("fecha_scraped", "detectada_en").desc_nulls_last(), F.desc("id")).limit(10)
    place = F.row_number().over(Window.partitionBy("institucion_id").orderBy(F.coalesce("fecha_scraped", "detectada_en").desc_nulls_last(), F.desc("id")))
    parts = [fields(i, "institucion", _INST, F.lit(1)), fields(e, "evaluacion", _EVAL, F.lit(1)), fields(last.withColumn("n", place), "ultimas_ofertas", ("id", *_LAST10), F.col("n"))]
    return reduce(DataFrame.unionByName, parts)


@query("""SELECT 'activas' AS parte, '' AS clave, count(*)::VARCHAR AS valor FROM ofertas WHERE activa UNION ALL SELECT 'sector', coalesce(sector, ''), count(*)::VARCHAR FROM ofertas WHERE activa GROUP BY sector UNION ALL SELECT 'region', coalesce(region, ''), count(*)::VARCHAR FROM ofertas WHERE activa GROUP BY region
 UNION ALL SELECT * FROM (SELECT 'ultimas', id::VARCHAR, concat_ws('|', cargo, institucion_nombre, region, fecha_cierre::VARCHAR) FROM ofertas ORDER BY creada_en DESC, id DESC LIMIT 10) UNION ALL SELECT * FROM (SELECT 'ejecuciones', id::VARCHAR, decision FROM evaluaciones ORDER BY evaluated_at DESC, id DESC LIMIT 5)""")
def q32_adhoc_counts(spark, sf_dir):
    """The five statements of the operator's manual: active postings, by sector, by region, the last ten, the last runs."""
    offers = A.offers(spark, sf_dir)
    active = offers.where("activa")
    part = lambda rows, name, key, value: rows.select(F.lit(name).alias("parte"), key.cast("string").alias("clave"), value.cast("string").alias("valor"))
    by = lambda c: part(active.groupBy(c).count(), c, F.coalesce(c, F.lit("")), F.col("count"))
    last = offers.orderBy(F.desc("creada_en"), F.desc("id")).limit(10)
    runs = A.evaluations(spark, sf_dir).orderBy(F.desc("evaluated_at"), F.desc("id")).limit(5)
    shown = F.concat_ws("|", "cargo", "institucion_nombre", "region", F.col("fecha_cierre").cast("string"))
    return reduce(DataFrame.unionByName, [part(active.agg(F.count("*").alias("n")), "activas", F.lit(""), F.col("n")), by("sector"), by("region"), part(last, "ultimas", F.col("id"), shown), part(runs, "ejecuciones", F.col("id"), F.col("decision"))])

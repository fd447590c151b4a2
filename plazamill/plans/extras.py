"""Single projections and small decisions that larger queries contain, each on its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from plazamill.context import OFFERS
from plazamill.functions import text as T
from plazamill.operators import offers as O
from plazamill.sources import adapters as A
from plazamill.sources import records

from .base import query
from .listing import ACTIVE, BASE, CONTRACT, SEEN, STATUS, joined
from .scalars import _N, _sql_date, notices, sql_normal


@query(f"SELECT o.id, coalesce(nullif(trim(o.institucion_nombre), ''), i.nombre, 'Sin institución') AS institucion {BASE}")
def p02_institution_label(spark, sf_dir):
    return joined(spark, sf_dir).select("id", F.coalesce(O.filled(F.trim("institucion_nombre")), "i_nombre", F.lit("Sin institución")).alias("institucion"))


@query(f"SELECT o.id, {CONTRACT} AS tipo FROM ofertas o")
def p03_contract_type(spark, sf_dir):
    return A.offers(spark, sf_dir).select("id", O.contract().alias("tipo"))


@query("SELECT id, coalesce(jornada, horas_semanales::VARCHAR || ' hrs / semana') AS jornada FROM ofertas")
def p04_working_time(spark, sf_dir):
    return A.offers(spark, sf_dir).select("id", F.coalesce("jornada", F.concat(F.col("horas_semanales").cast("string"), F.lit(" hrs / semana"))).alias("jornada"))


@query(f"SELECT o.id, coalesce(i.sector, o.sector, i.tipo) AS listado, i.sector AS admin, coalesce(o.sector, i.sector) AS revision {BASE}")
def p05_sector_precedence(spark, sf_dir):
    return joined(spark, sf_dir).select("id", F.coalesce("i_sector", "sector", "i_tipo").alias("listado"), F.col("i_sector").alias("admin"), F.coalesce("sector", "i_sector").alias("revision"))


@query(f"SELECT o.id, {SEEN} AS visto, coalesce(o.actualizada_en, o.creada_en) AS actualizado FROM ofertas o")
def p06_effective_times(spark, sf_dir):
    return A.offers(spark, sf_dir).select("id", O.seen_at().alias("visto"), F.coalesce("actualizada_en", "creada_en").alias("actualizado"))


@query(f"SELECT o.sector, count(*) AS total FROM ofertas o WHERE {ACTIVE} GROUP BY 1 ORDER BY total DESC, sector NULLS LAST LIMIT 10")
def a03_top_sectors(spark, sf_dir):
    return A.offers(spark, sf_dir).where(O.is_active(OFFERS)).groupBy("sector").agg(F.count("*").alias("total")).orderBy(F.desc("total"), F.asc_nulls_last("sector")).limit(10)


@query("SELECT id FROM instituciones WHERE plataforma_empleo IN ('WordPress') AND activa")
def f19_runnable(spark, sf_dir):
    return A.institutions(spark, sf_dir).where(F.col("plataforma_empleo").isin("WordPress") & F.col("activa")).select("id")


@query(f"SELECT o.id FROM ofertas o WHERE {STATUS} = 'upcoming' ORDER BY o.id LIMIT 20")
def f21_state_before_paging(spark, sf_dir):
    """The recomputed state filters before the page is cut, so pages are full."""
    return O.page(A.offers(spark, sf_dir).where(O.status(OFFERS) == "upcoming"), [F.asc("id")], 1, 20).select("id")


_LAST = "([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})"


@query(f"SELECT id, CAST({_sql_date(_LAST, (3, 2, 1), 'u')} AS VARCHAR) AS fecha FROM (SELECT id, list_last(regexp_extract_all(texto, '{_LAST}')) AS u FROM {_N})", cte=False)
def d11_last_date(spark, sf_dir):
    from plazamill.functions import dates as DT

    last = F.element_at(F.nullif(F.regexp_extract_all("texto", F.lit(_LAST), F.lit(0)), F.array().cast("array<string>")), -1)
    return notices(spark, sf_dir).select("id", DT.first_date(last).cast("string").alias("fecha"))




@query("SELECT user_id % 20 AS run_id, count(*) AS instituciones, sum((event_type = 'purchase')::BIGINT)::BIGINT AS nuevas, sum((event_type = 'error')::BIGINT)::BIGINT AS errores, '[' || string_agg('{\"institucion\":' || event_id || ',\"nuevas\":' || (event_type = 'purchase')::BIGINT || ',\"errores\":' || (event_type = 'error')::BIGINT || '}', ',' ORDER BY event_id) || ']' AS detalle FROM events GROUP BY 1", cte=False)
def x13_run_log(spark, sf_dir):
    n = lambda t: (F.col("event_type") == t).cast("long")
    reports = A.read(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("run_id"), F.col("event_id").alias("institucion"), n("purchase").alias("nuevas"), n("error").alias("errores"))
    return records.run_log(reports)


@query("SELECT user_id, min(event_id) AS event_id FROM events GROUP BY 1", cte=False)
def r01_first_seen(spark, sf_dir):
    """Batch form of streaming.state.first_seen."""
    return A.read(spark, sf_dir, "events").groupBy("user_id").agg(F.min("event_id").alias("event_id"))

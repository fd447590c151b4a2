"""State maintenance over the adapted tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plazamill.context import OFFERS
from plazamill.functions import text as T
from plazamill.operators import merge as K
from plazamill.operators import rules as R
from plazamill.sources import adapters as A

from .base import query
from .listing import NOW, D
from .scalars import ACC, _sql_sector

COLS = ["cargo", "region", "renta_bruta_min"]
_OLD = "(SELECT id, cargo, region, renta_bruta_min, activa, fecha_cierre FROM ofertas WHERE id % 3 <> 0)"
_NEW = "(SELECT id, CASE WHEN id % 10 = 2 THEN '' WHEN id % 4 = 0 THEN concat('nuevo ', coalesce(cargo, 'x')) ELSE cargo END AS cargo, region, renta_bruta_min FROM ofertas WHERE id % 2 = 0)"


def state(spark, sf_dir):
    return A.offers(spark, sf_dir).where("id % 3 <> 0").select("id", *COLS, "activa", "fecha_cierre")


def delta(spark, sf_dir):
    return A.offers(spark, sf_dir).where("id % 2 = 0").selectExpr("id", "CASE WHEN id % 10 = 2 THEN '' WHEN id % 4 = 0 THEN concat('nuevo ', coalesce(cargo, 'x')) ELSE cargo END AS cargo", "region", "renta_bruta_min")


def _merged_sql(value) -> str:
    return f"SELECT coalesce(o.id, n.id) AS id, {', '.join(f'CASE WHEN n.id IS NOT NULL THEN {value(c)} ELSE o.{c} END AS {c}' for c in COLS)}, o.activa, o.fecha_cierre, o.id IS NULL AS es_insert, n.id IS NOT NULL AND o.id IS NOT NULL AS es_update FROM {_OLD} o FULL JOIN {_NEW} n ON o.id = n.id"


@query(_merged_sql(lambda c: f"n.{c}"), dates=("fecha_cierre",))
def k01_upsert_overwrite(spark, sf_dir):
    return K.upsert(state(spark, sf_dir), delta(spark, sf_dir), "id", COLS)


@query(_merged_sql(lambda c: f"coalesce(n.{c}, o.{c})"), dates=("fecha_cierre",))
def k02_upsert_if_not_null(spark, sf_dir):
    return K.upsert(state(spark, sf_dir), delta(spark, sf_dir), "id", COLS, "if_not_null")


@query(_merged_sql(lambda c: f"coalesce(nullif(n.{c}, ''), o.{c})" if c != "renta_bruta_min" else f"coalesce(n.{c}, o.{c})"), dates=("fecha_cierre",))
def k03_upsert_if_not_empty(spark, sf_dir):
    return K.upsert(state(spark, sf_dir), delta(spark, sf_dir), "id", COLS, "if_not_empty")


def closable(spark, sf_dir):
    return A.offers(spark, sf_dir).select("id", "activa", "fecha_cierre", F.when(F.col("id") % 21 == 0, F.col("creada_en").cast("timestamp")).alias("cerrada_en"))


_CLOSABLE = "(SELECT id, activa, fecha_cierre, CASE WHEN id % 21 = 0 THEN creada_en END AS cerrada_en FROM ofertas)"


@query(f"SELECT id, activa AND seen AS activa, CASE WHEN activa AND NOT seen THEN {NOW} ELSE cerrada_en END AS cerrada_en FROM (SELECT *, id % 5 <> 0 AS seen FROM {_CLOSABLE})")
def k04_close_missing(spark, sf_dir):
    s = closable(spark, sf_dir)
    return K.close_missing(s, s.where("id % 5 <> 0").select("id"), "id", OFFERS.instant).select("id", "activa", "cerrada_en")


@query(f"SELECT id, activa AND NOT coalesce(fecha_cierre < {D}, FALSE) AS activa, CASE WHEN activa AND coalesce(fecha_cierre < {D}, FALSE) THEN coalesce(cerrada_en, {NOW}) ELSE cerrada_en END AS cerrada_en FROM {_CLOSABLE}")
def k05_close_expired(spark, sf_dir):
    return K.close_expired(closable(spark, sf_dir), OFFERS.day, OFFERS.instant).select("id", "activa", "cerrada_en")


@query(f"SELECT n.id, n.cargo, CASE WHEN o.id IS NULL THEN 'INSERT' ELSE 'UPDATE' END AS origen FROM {_NEW} n LEFT JOIN {_OLD} o ON o.id = n.id")
def k06_snapshots(spark, sf_dir):
    return K.snapshots(k01_upsert_overwrite(spark, sf_dir)).select("id", "cargo", "origen")


@query(f"SELECT o.id, o.cargo FROM {_OLD} o JOIN {_NEW} n ON o.id = n.id WHERE o.cargo IS DISTINCT FROM n.cargo OR o.region IS DISTINCT FROM n.region OR o.renta_bruta_min IS DISTINCT FROM n.renta_bruta_min")
def k07_history_on_change(spark, sf_dir):
    s = state(spark, sf_dir)
    return K.history(s, K.upsert(s, delta(spark, sf_dir), "id", COLS), "id", COLS).select("id", "cargo")


@query("SELECT fuente_id, count(*) AS total, count(*) FILTER (WHERE activa) AS activas FROM ofertas GROUP BY 1")
def k11_source_counters(spark, sf_dir):
    return A.offers(spark, sf_dir).groupBy("fuente_id").agg(F.count("*").alias("total"), F.count_if("activa").alias("activas"))


@query("SELECT id, activa AND NOT (coalesce(url_oferta_valida = FALSE, FALSE) OR id IN (1, 2, 3)) AS activa FROM ofertas")
def k10_bulk_deactivate(spark, sf_dir):
    broken = F.coalesce(~F.col("url_oferta_valida"), F.lit(False)) | F.col("id").isin(1, 2, 3)
    return A.offers(spark, sf_dir).select("id", (F.col("activa") & ~broken).alias("activa"))


@query(f"SELECT id, 'EE-998-' || s || '-' || lpad((row_number() OVER (PARTITION BY s ORDER BY creada_en, id) + CASE s WHEN 'MUN' THEN 40 ELSE 0 END)::VARCHAR, 6, '0') AS codigo FROM (SELECT id, creada_en, {_sql_sector('f')} AS s FROM (SELECT id, creada_en, lower(translate(coalesce(sector, ''), {ACC})) AS f FROM ofertas))")
def w07_sequence_codes(spark, sf_dir):
    counters = spark.createDataFrame([("998", "MUN", 40)], "anio string, sector string, ultimo int")
    sector = R.sector_code(F.lower(T.strip_accents(F.coalesce("sector", F.lit("")))))
    return K.sequence_codes(A.offers(spark, sf_dir), "1998", sector, [F.asc("creada_en"), F.asc("id")], counters, F.to_date("creada_en")).select("id", "codigo")


@query("""SELECT id, institucion_id, (sum((ex AND f = 0)::INT) OVER (PARTITION BY institucion_id, p ORDER BY id))::BIGINT AS ceros FROM (SELECT *, sum((ex AND f > 0)::INT) OVER (PARTITION BY institucion_id ORDER BY id) AS p FROM (SELECT id, institucion_id, decision <> 'review' AS ex, CASE WHEN decision = 'publish' THEN 1 ELSE 0 END AS f FROM evaluaciones))""")
def w08_zero_streak(spark, sf_dir):
    runs = A.evaluations(spark, sf_dir).select("id", "institucion_id", (F.col("decision") != "review").alias("ex"), F.when(F.col("decision") == "publish", 1).otherwise(0).alias("f"))
    return K.zero_streak(runs, "institucion_id", "id", "ex", "f").select("id", "institucion_id", "ceros")


@query("""SELECT coalesce(p.id, s.id) AS id, coalesce(nullif(p.nombre, ''), s.nombre) AS nombre, coalesce(nullif(p.sigla, ''), s.sigla) AS sigla FROM (SELECT id, CASE WHEN id % 4 = 0 THEN '' ELSE nombre END AS nombre, sigla FROM instituciones WHERE id % 3 <> 0) p FULL JOIN (SELECT id, upper(nombre) AS nombre, 'X' AS sigla FROM instituciones WHERE id % 2 = 0) s ON p.id = s.id""")
def x04_catalog_merge(spark, sf_dir):
    """The primary wins; the secondary fills nulls and blanks and adds ids."""
    i = A.institutions(spark, sf_dir)
    p = i.where("id % 3 <> 0").select("id", F.when(F.col("id") % 4 == 0, "").otherwise(F.col("nombre")).alias("nombre"), "sigla")
    s = i.where("id % 2 = 0").select(F.col("id").alias("s_id"), F.upper("nombre").alias("s_nombre"), F.lit("X").alias("s_sigla"))
    own = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"s_{c}")).alias(c)
    return p.join(s, p["id"] == s["s_id"], "full").select(F.coalesce("id", "s_id").alias("id"), own("nombre"), own("sigla"))


@query("SELECT user_id, strftime(to_timestamp(floor(epoch(ts) / 600) * 600) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS ventana, count(*) AS fallos FROM events WHERE event_type = 'error' GROUP BY 1, 2 HAVING count(*) >= 2", cte=False)
def r04_failure_windows(spark, sf_dir):
    rows = A.read(spark, sf_dir, "events").where("event_type = 'error'").groupBy("user_id", F.window(F.col("ts").cast("timestamp"), "10 minutes").alias("w")).agg(F.count("*").alias("fallos"))
    return rows.where("fallos >= 2").select("user_id", F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("ventana"), "fallos")


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS dia, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2", cte=False)
def r05_daily_windows(spark, sf_dir):
    rows = A.read(spark, sf_dir, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return rows.select(F.date_format("w.start", "yyyy-MM-dd").alias("dia"), "event_type", "n", "total")



"""The driver's tables as postings, institutions, evaluations and snapshots.

Each expression is plain SQL that Spark and DuckDB read alike, so a query and its check start from equal rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

OFFERS = {
    "id": "o_orderkey",
    "institucion_id": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_custkey END",
    "institucion_nombre": "CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 9 = 0 THEN '  ' ELSE concat(' Servicio ', CAST(o_custkey AS VARCHAR(20)), ' ') END",
    "cargo": "CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_orderpriority END",
    "descripcion": "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE concat('Detalle de ', o_orderpriority) END",
    "requisitos": "CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 'Título profesional' END",
    "requisitos_texto": "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'Ver bases' END",
    "tipo_contrato": "CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'Planta' WHEN 2 THEN NULL ELSE 'Contrata' END",
    "tipo_cargo": "CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'honorarios' ELSE 'contrata' END",
    "region": "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('Region ', CAST(o_orderkey % 16 AS VARCHAR(20))) END",
    "ciudad": "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE concat('Comuna ', CAST(o_orderkey % 30 AS VARCHAR(20))) END",
    "sector": "CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'Municipal' WHEN 2 THEN 'Salud' WHEN 3 THEN 'Poder Judicial' WHEN 4 THEN 'Educación' WHEN 5 THEN 'Ejecutivo Central' ELSE '' END",
    "renta_bruta_min": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) * 10 END",
    "renta_bruta_max": "CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) * 10 + 50000 * (o_orderkey % 3 - 1) END",
    "grado_eus": "CASE WHEN o_orderkey % 6 = 1 THEN CAST(o_orderkey % 25 AS VARCHAR(20)) ELSE NULL END",
    "jornada": "CASE WHEN o_orderkey % 4 = 1 THEN 'Completa' ELSE NULL END",
    "horas_semanales": "CASE WHEN o_orderkey % 9 = 2 THEN NULL ELSE CAST(o_orderkey % 45 AS INT) END",
    "area_profesional": "CASE WHEN o_orderkey % 5 = 3 THEN NULL ELSE concat('Area ', CAST(o_orderkey % 12 AS VARCHAR(20))) END",
    "fecha_publicacion": "CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END",
    "fecha_inicio": "CASE WHEN o_orderkey % 19 = 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INT) ELSE NULL END",
    "fecha_cierre": "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INT) END",
    "url_oferta": "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE concat('https://www.portal', CAST(o_orderkey % 20 AS VARCHAR(20)), '.cl/oferta/', CAST(o_orderkey AS VARCHAR(20))) END",
    "url_original": "concat('https://portal', CAST(o_orderkey % 20 AS VARCHAR(20)), '.cl/o?id=', CAST(o_orderkey AS VARCHAR(20)))",
    "url_bases": "CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE concat('https://bases.cl/', CAST(o_orderkey AS VARCHAR(20)), '.pdf') END",
    "url_oferta_valida": "CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN FALSE ELSE TRUE END",
    "url_valida_chequeada_en": "CASE WHEN o_orderkey % 3 = 1 THEN NULL ELSE o_orderdate END",
    "activa": "o_orderstatus <> 'F'",
    "estado": "CASE o_orderstatus WHEN 'P' THEN '' WHEN 'F' THEN 'cerrada' ELSE 'activo' END",
    "fecha_scraped": "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderdate END",
    "detectada_en": "CASE WHEN o_orderkey % 12 = 0 THEN NULL ELSE o_orderdate END",
    "actualizada_en": "CASE WHEN o_orderkey % 24 = 0 THEN NULL ELSE o_orderdate END",
    "creada_en": "o_orderdate",
    "fuente_id": "CAST(o_orderkey % 6 AS INT)",
    "needs_review": "o_orderkey % 14 = 3",
    "overall_quality_score": "CASE WHEN o_orderkey % 10 = 4 THEN NULL ELSE CAST(o_orderkey % 100 AS DOUBLE) / 100 END",
}
INSTITUTIONS = {
    "id": "c_custkey",
    "nombre": "c_name",
    "sigla": "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat('S', CAST(c_custkey AS VARCHAR(20))) END",
    "nombre_corto": "substring(c_name, 1, 8)",
    "sector": "CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_mktsegment END",
    "tipo": "'Servicio'",
    "region": "r_name",
    "url_empleo": "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE concat('https://empleo', CAST(c_custkey % 50 AS VARCHAR(20)), '.cl/trabaje') END",
    "plataforma_empleo": "CASE c_custkey % 4 WHEN 0 THEN 'WordPress' WHEN 1 THEN 'Trabajando' WHEN 2 THEN NULL ELSE 'Propia' END",
    "activa": "c_custkey % 20 <> 7",
}
EVALUATIONS = {
    "id": "event_id",
    "institucion_id": "user_id",
    "evaluated_at": "ts",
    "decision": "CASE event_type WHEN 'click' THEN 'extract' WHEN 'view' THEN 'review' WHEN 'error' THEN 'reject' ELSE 'publish' END",
    "retry_policy": "CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'critical' WHEN 2 THEN 'high' WHEN 3 THEN 'medium' ELSE 'low' END",
    "quality_score": "CASE WHEN event_id % 13 = 0 THEN NULL ELSE round(least(value / 100, 1), 4) END",
    "policy_score": "CASE WHEN event_id % 17 = 0 THEN NULL ELSE round(least(value / 50, 2) - 1, 4) END",
    "signals_json": "props",
    "reason": "CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'missing_title' WHEN 2 THEN 'expired' WHEN 3 THEN 'news_page' WHEN 4 THEN 'no_dates' ELSE 'duplicate' END",
    "second_reason": "CASE event_id % 4 WHEN 0 THEN 'expired' WHEN 1 THEN 'no_dates' ELSE NULL END",
    "platform": "CASE event_id % 3 WHEN 0 THEN 'wordpress' WHEN 1 THEN 'buk' ELSE NULL END",
}
SNAPSHOTS = {
    "oferta_id": "l_orderkey",
    "linea": "l_linenumber",
    "capturado_en": "l_shipdate",
    "cargo": "l_returnflag",
    "renta": "CAST(floor(l_extendedprice) AS BIGINT)",
    "estado": "l_linestatus",
}


def _select(exprs: dict[str, str]) -> list[str]:
    return [f"{e} AS {n}" for n, e in exprs.items()]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """The rows dealt by key over all cores, for expressions that cost much a row: a file of few row groups, however
    many rows they hold, would keep the other cores idle."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, key)


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").selectExpr(*_select(OFFERS))


def institutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation and region have fixed sizes (25 and 5 rows), so they are broadcast by Spark's own size estimate."""
    n, r, c = (read(spark, sf_dir, t) for t in ("nation", "region", "customer"))
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).selectExpr(*_select(INSTITUTIONS))


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr(*_select(EVALUATIONS))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").selectExpr(*_select(SNAPSHOTS))


#: The same relations for the check, as common table expressions.
CTE = f"""WITH ofertas AS (SELECT {", ".join(_select(OFFERS))} FROM orders),
instituciones AS (SELECT {", ".join(_select(INSTITUTIONS))} FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
evaluaciones AS (SELECT {", ".join(_select(EVALUATIONS))} FROM events),
snapshots AS (SELECT {", ".join(_select(SNAPSHOTS))} FROM lineitem)"""

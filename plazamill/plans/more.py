"""Further operators: set operations, catalogs, small text rules, audit details."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plazamill.context import OFFERS
from plazamill.functions import text as T
from plazamill.operators import merge as K
from plazamill.operators import offers as O
from plazamill.sources import adapters as A

from .base import query
from .listing import ACTIVE, BASE, D, joined
from .scalars import _N, ACC, notices, sql_normal


@query("SELECT id, cargo FROM ofertas WHERE institucion_id = 100 AND id > 10")
def x01_bound_parameters(spark, sf_dir):
    A.offers(spark, sf_dir).createOrReplaceTempView("plz_ofertas")
    return spark.sql("SELECT id, cargo FROM plz_ofertas WHERE institucion_id = :inst AND id > :low", args={"inst": 100, "low": 10})


@query("(SELECT region AS lugar FROM ofertas UNION SELECT ciudad FROM ofertas) EXCEPT (SELECT ciudad FROM ofertas WHERE needs_review INTERSECT SELECT ciudad FROM ofertas WHERE activa)")
def u01_set_operations(spark, sf_dir):
    """Distinct places of either kind, without the towns that stand among both the doubtful and the active offers."""
    o = A.offers(spark, sf_dir)
    towns = lambda c: o.where(c).select(F.col("ciudad").alias("lugar"))
    either = o.select(F.col("region").alias("lugar")).union(o.select("ciudad")).distinct()
    return either.subtract(towns("needs_review").intersect(towns("activa")))


@query("SELECT id, plataforma_empleo FROM instituciones WHERE plataforma_empleo IN ('WordPress', 'Propia') AND activa ORDER BY id LIMIT 25")
def f22_source_list(spark, sf_dir):
    return A.institutions(spark, sf_dir).where(F.col("plataforma_empleo").isin("WordPress", "Propia") & F.col("activa")).orderBy("id").limit(25).select("id", "plataforma_empleo")


@query("SELECT id FROM instituciones WHERE url_empleo IS NOT NULL AND NOT contains(url_empleo, 'empleo7.cl') ORDER BY id LIMIT 100")
def f18_discovery_filter(spark, sf_dir):
    host = T.host(F.col("url_empleo"))
    return A.institutions(spark, sf_dir).where(F.col("url_empleo").isNotNull() & (host != "empleo7.cl")).orderBy("id").limit(100).select("id")


@query("SELECT id, least(coalesce(renta_bruta_min, renta_bruta_max), coalesce(renta_bruta_max, renta_bruta_min)) AS clave FROM ofertas")
def o02_pay_key(spark, sf_dir):
    return A.offers(spark, sf_dir).select("id", F.least(F.coalesce("renta_bruta_min", "renta_bruta_max"), F.coalesce("renta_bruta_max", "renta_bruta_min")).alias("clave"))


@query("SELECT institucion_id, arg_min(id, struct_pack(a := -coalesce(quality_score, 0), b := evaluated_at, c := id)) AS mejor FROM evaluaciones GROUP BY 1")
def o07_best_evidence(spark, sf_dir):
    return A.evaluations(spark, sf_dir).groupBy("institucion_id").agg(F.min_by("id", F.struct(-F.coalesce("quality_score", F.lit(0.0)), F.col("evaluated_at"), F.col("id"))).alias("mejor"))


@query("SELECT fuente_id, id FROM (SELECT fuente_id, id, row_number() OVER (PARTITION BY fuente_id ORDER BY fecha_publicacion DESC NULLS LAST, id) AS rn FROM ofertas) WHERE rn <= 20")
def w10_top_per_group(spark, sf_dir):
    w = Window.partitionBy("fuente_id").orderBy(F.desc_nulls_last("fecha_publicacion"), "id")
    return A.offers(spark, sf_dir).withColumn("rn", F.row_number().over(w)).where("rn <= 20").select("fuente_id", "id")


@query("SELECT decision, reason, n FROM (SELECT decision, coalesce(reason, 'none') AS reason, count(*) AS n, row_number() OVER (PARTITION BY decision ORDER BY count(*) DESC, coalesce(reason, 'none')) AS rn FROM evaluaciones GROUP BY 1, 2) WHERE rn <= 3")
def a25_top_reasons(spark, sf_dir):
    n = A.evaluations(spark, sf_dir).groupBy("decision", F.coalesce("reason", F.lit("none")).alias("reason")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("decision").orderBy(F.desc("n"), "reason")
    return n.withColumn("rn", F.row_number().over(w)).where("rn <= 3").drop("rn")


@query("SELECT event_id, 'k' AS clave, json_extract_string(props, '$.k')::BIGINT AS valor FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL", cte=False)
def a27_json_map(spark, sf_dir):
    rows = A.read(spark, sf_dir, "events").select("event_id", F.explode(F.from_json("props", "map<string,long>")).alias("clave", "valor"))
    return rows.where("clave = 'k' AND valor IS NOT NULL")


@query("SELECT id, TRY_CAST(json_extract_string(signals_json, '$.k') AS BIGINT) % 7 AS resto FROM evaluaciones")
def m01_json_access(spark, sf_dir):
    return A.evaluations(spark, sf_dir).select("id", (F.get_json_object("signals_json", "$.k").try_cast("long") % 7).alias("resto"))


@query("SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE regexp_replace(substring(text, 1, 199), '[ ,.;:]+$', '') || '…' END AS corto FROM documents", cte=False)
def s07_smart_truncate(spark, sf_dir):
    cut = F.concat(F.regexp_replace(F.substring("text", 1, 199), "[ ,.;:]+\\z", ""), F.lit("…"))
    return A.read(spark, sf_dir, "documents").select("doc_id", F.when(F.length("text") <= 200, F.col("text")).otherwise(cut).alias("corto"))


@query("SELECT page_id, CASE WHEN regexp_matches(u, '[?&]page=[0-9]+') THEN regexp_replace(u, '([?&])page=[0-9]+', '\\1page=3') WHEN contains(u, '?') THEN u || '&page=3' ELSE u || '?page=3' END AS url FROM (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages)", cte=False)
def s17_set_page(spark, sf_dir):
    u = F.regexp_replace("url", "#.*$", "")
    out = F.when(u.rlike("[?&]page=[0-9]+"), F.regexp_replace(u, "([?&])page=[0-9]+", "$1page=3")).when(F.contains(u, F.lit("?")), F.concat(u, F.lit("&page=3"))).otherwise(F.concat(u, F.lit("?page=3")))
    return A.read(spark, sf_dir, "pages").select("page_id", out.alias("url"))


@query("SELECT id, nullif(regexp_extract(url_original, '[?&]id=([^&#]*)', 1), '') AS externo FROM ofertas")
def s18_query_value(spark, sf_dir):
    return A.offers(spark, sf_dir).select("id", F.expr("try_parse_url(url_original, 'QUERY', 'id')").alias("externo"))




@query(f"SELECT id, CASE WHEN d IS NULL THEN 'sin plazo' WHEN d < 0 THEN 'cerrado' WHEN d = 0 THEN 'cierra hoy' WHEN d = 1 THEN 'queda 1 día' ELSE 'quedan ' || d::VARCHAR || ' días' END AS etiqueta FROM (SELECT id, fecha_cierre - {D} AS d FROM ofertas)")
def d14_deadline_label(spark, sf_dir):
    d = F.datediff("fecha_cierre", OFFERS.day)
    label = F.when(d.isNull(), "sin plazo").when(d < 0, "cerrado").when(d == 0, "cierra hoy").when(d == 1, "queda 1 día").otherwise(F.concat(F.lit("quedan "), d.cast("string"), F.lit(" días")))
    return A.offers(spark, sf_dir).select("id", label.alias("etiqueta"))


@query("SELECT i.id, coalesce(n.nombre, i.nombre) AS nombre FROM instituciones i LEFT JOIN (SELECT id, upper(nombre) AS nombre FROM instituciones WHERE id % 4 = 0) n ON n.id = i.id")
def k08_institution_sync(spark, sf_dir):
    i = A.institutions(spark, sf_dir).select("id", "nombre")
    return K.upsert(i, i.where("id % 4 = 0").withColumn("nombre", F.upper("nombre")), "id", ["nombre"], "if_not_null").select("id", "nombre")



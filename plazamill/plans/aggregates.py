"""Statistics over postings and evaluations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plazamill.context import EVENTS, OFFERS
from plazamill.operators import offers as O
from plazamill.sources import adapters as A

from .base import query
from .listing import ACTIVE, BASE, CHECKS, CONTRACT, NOW, SEEN, STATUS, D, joined, latest


@query(f"""SELECT count(*) FILTER (WHERE {ACTIVE}) AS activas_hoy, count(*) FILTER (WHERE {SEEN} >= {NOW} - INTERVAL 48 HOUR AND {ACTIVE}) AS nuevas_48h, count(*) FILTER (WHERE o.fecha_cierre = {D} AND {ACTIVE}) AS cierran_hoy,
 count(DISTINCT o.institucion_id) FILTER (WHERE {ACTIVE}) AS instituciones_activas FROM ofertas o""")
def a01_dashboard(spark, sf_dir):
    live = O.is_active(OFFERS)
    return A.offers(spark, sf_dir).agg(
        F.count_if(live).alias("activas_hoy"),
        F.count_if(live & (O.seen_at() >= OFFERS.instant - F.expr("INTERVAL 48 HOURS"))).alias("nuevas_48h"),
        F.count_if(live & (F.col("fecha_cierre") == OFFERS.day)).alias("cierran_hoy"),
        F.count_distinct(F.when(live, F.col("institucion_id"))).alias("instituciones_activas"),
    )


@query(f"SELECT max({SEEN}) AS ultima FROM ofertas o")
def a02_last_update(spark, sf_dir):
    return A.offers(spark, sf_dir).agg(F.max(O.seen_at()).alias("ultima"))


@query(f"SELECT coalesce(i.sector, o.sector, i.tipo, 'Sin sector') AS sector, count(*) AS total {BASE} WHERE {ACTIVE} GROUP BY 1 ORDER BY total DESC, sector LIMIT 8")
def q03_active_by_sector(spark, sf_dir):
    rows = joined(spark, sf_dir).where(O.is_active(OFFERS)).groupBy(F.coalesce("i_sector", "sector", "i_tipo", F.lit("Sin sector")).alias("sector"))
    return rows.agg(F.count("*").alias("total")).orderBy(F.desc("total"), "sector").limit(8)


@query(f"SELECT strftime(date_trunc('month', {SEEN}), '%Y-%m') AS mes, count(*) AS total FROM ofertas o WHERE {SEEN} >= {NOW} - INTERVAL 12 MONTH GROUP BY 1")
def a04_monthly_history(spark, sf_dir):
    rows = A.offers(spark, sf_dir).where(O.seen_at() >= OFFERS.instant - F.expr("INTERVAL 12 MONTHS"))
    return rows.groupBy(F.date_format(O.seen_at(), "yyyy-MM").alias("mes")).agg(F.count("*").alias("total"))


@query(f"SELECT i.id, coalesce(i.nombre, 'Sin institucion') AS nombre, count(*) AS activas, count(*) FILTER (WHERE {SEEN} >= {NOW} - INTERVAL 7 DAY) AS nuevas_semana {BASE} WHERE {ACTIVE} GROUP BY i.id, i.nombre ORDER BY activas DESC, nuevas_semana DESC, nombre LIMIT 5")
def a05_most_active(spark, sf_dir):
    fresh = O.seen_at() >= OFFERS.instant - F.expr("INTERVAL 7 DAYS")
    rows = joined(spark, sf_dir).where(O.is_active(OFFERS)).groupBy(F.col("i_id").alias("id"), F.coalesce("i_nombre", F.lit("Sin institucion")).alias("nombre"))
    return rows.agg(F.count("*").alias("activas"), F.count_if(fresh).alias("nuevas_semana")).orderBy(F.desc("activas"), F.desc("nuevas_semana"), "nombre").limit(5)


@query(f"SELECT institucion_id, round(avg(n), 2) AS promedio FROM (SELECT o.institucion_id, date_trunc('month', {SEEN}) AS mes, count(*) AS n FROM ofertas o GROUP BY 1, 2) GROUP BY 1")
def a06_monthly_average(spark, sf_dir):
    months = A.offers(spark, sf_dir).groupBy("institucion_id", F.date_trunc("month", O.seen_at()).alias("mes")).agg(F.count("*").alias("n"))
    return months.groupBy("institucion_id").agg(F.round(F.avg("n"), 2).alias("promedio"))


@query(f"SELECT coalesce({CONTRACT}, 'sin_dato') AS tipo, count(*) AS total FROM ofertas o GROUP BY 1 ORDER BY total DESC, tipo LIMIT 5")
def a07_contract_frequency(spark, sf_dir):
    return A.offers(spark, sf_dir).groupBy(F.coalesce(O.contract(), F.lit("sin_dato")).alias("tipo")).agg(F.count("*").alias("total")).orderBy(F.desc("total"), "tipo").limit(5)


@query("SELECT cargo, count(*) AS total FROM ofertas WHERE cargo IS NOT NULL GROUP BY cargo ORDER BY total DESC, cargo LIMIT 10")
def a08_suggestions(spark, sf_dir):
    return A.offers(spark, sf_dir).where("cargo IS NOT NULL").groupBy("cargo").agg(F.count("*").alias("total")).orderBy(F.desc("total"), "cargo").limit(10)


@query(f"""SELECT count(*) AS total, count(*) FILTER (WHERE activa) AS activas, count(*) FILTER (WHERE NOT activa) AS inactivas, count(*) FILTER (WHERE url_oferta_valida = FALSE) AS urls_rotas, count(*) FILTER (WHERE url_oferta_valida IS NULL) AS urls_sin_validar,
 count(*) FILTER (WHERE {SEEN} >= {NOW} - INTERVAL 24 HOUR) AS nuevas_24h, count(*) FILTER (WHERE fecha_cierre < {D} AND activa) AS activas_vencidas FROM ofertas o""")
def a09_admin_totals(spark, sf_dir):
    c = F.col
    return A.offers(spark, sf_dir).agg(
        F.count("*").alias("total"), F.count_if(c("activa")).alias("activas"), F.count_if(~c("activa")).alias("inactivas"), F.count_if(~c("url_oferta_valida")).alias("urls_rotas"),
        F.count_if(c("url_oferta_valida").isNull()).alias("urls_sin_validar"), F.count_if(O.seen_at() >= OFFERS.instant - F.expr("INTERVAL 24 HOURS")).alias("nuevas_24h"),
        F.count_if((c("fecha_cierre") < OFFERS.day) & c("activa")).alias("activas_vencidas"),
    )


@query("SELECT count(DISTINCT institucion_id) AS instituciones, count(*) FILTER (WHERE decision = 'extract') AS extract_n, count(*) FILTER (WHERE decision = 'reject') AS reject_n, count(*) FILTER (WHERE decision = 'review') AS review_n, max(evaluated_at) AS ultima FROM evaluaciones")
def a10_evaluation_summary(spark, sf_dir):
    is_ = lambda d: F.count_if(F.col("decision") == d)
    return A.evaluations(spark, sf_dir).agg(F.count_distinct("institucion_id").alias("instituciones"), is_("extract").alias("extract_n"), is_("reject").alias("reject_n"), is_("review").alias("review_n"), F.max("evaluated_at").alias("ultima"))


@query("SELECT count(*) FILTER (WHERE url_oferta_valida) AS validas, count(*) FILTER (WHERE NOT url_oferta_valida) AS rotas, count(*) FILTER (WHERE url_oferta_valida IS NULL) AS sin_validar, max(url_valida_chequeada_en) AS ultimo FROM ofertas WHERE activa")
def a11_url_validity(spark, sf_dir):
    v = F.col("url_oferta_valida")
    return A.offers(spark, sf_dir).where("activa").agg(F.count_if(v).alias("validas"), F.count_if(~v).alias("rotas"), F.count_if(v.isNull()).alias("sin_validar"), F.max("url_valida_chequeada_en").alias("ultimo"))


@query("SELECT e.decision, count(*) AS n FROM (SELECT decision, row_number() OVER (PARTITION BY institucion_id ORDER BY evaluated_at DESC, id DESC) AS rn FROM evaluaciones) e WHERE rn = 1 GROUP BY 1")
def a12_problem_sources(spark, sf_dir):
    return latest(A.evaluations(spark, sf_dir)).groupBy("decision").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS total, count(DISTINCT lower(c_name)) AS correos, count(*) FILTER (WHERE c_acctbal > 0) AS activas FROM customer", cte=False)
def a13_subscription_summary(spark, sf_dir):
    return A.read(spark, sf_dir, "customer").agg(F.count("*").alias("total"), F.count_distinct(F.lower("c_name")).alias("correos"), F.count_if(F.col("c_acctbal") > 0).alias("activas"))


@query("SELECT institucion_id, round(coalesce(count(*) FILTER (WHERE decision <> 'publish') / nullif(count(*), 0)::DOUBLE, 0), 4) AS noise FROM evaluaciones GROUP BY 1")
def a14_noise_ratio(spark, sf_dir):
    return A.evaluations(spark, sf_dir).groupBy("institucion_id").agg(F.round(F.coalesce(F.count_if(F.col("decision") != "publish") / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)), 4).alias("noise"))


@query("""SELECT platform, count(*) AS n, round(avg((decision = 'publish')::INT), 4) AS publish_ratio, round(avg((decision <> 'publish')::INT), 4) AS flagged_ratio, greatest(0.0, least(1.0, round(1 - avg((decision <> 'publish')::INT), 4))) AS recall_proxy FROM evaluaciones GROUP BY 1""")
def a15_source_quality(spark, sf_dir):
    ok, bad = F.avg((F.col("decision") == "publish").cast("int")), F.avg((F.col("decision") != "publish").cast("int"))
    return A.evaluations(spark, sf_dir).groupBy("platform").agg(F.count("*").alias("n"), F.round(ok, 4).alias("publish_ratio"), F.round(bad, 4).alias("flagged_ratio"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(1 - bad, 4))).alias("recall_proxy"))


@query("""SELECT decision, count(*) AS n, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 4) AS pct, round(avg(quality_score), 4) AS mean, round(quantile_cont(quality_score, 0.5), 4) AS median, round(quantile_cont(quality_score, 0.25), 4) AS p25,
 round(quantile_cont(quality_score, 0.75), 4) AS p75, min(quality_score) AS lo, max(quality_score) AS hi FROM evaluaciones GROUP BY 1""")
def a16_decision_stats(spark, sf_dir):
    """Exact percentiles with linear interpolation; one sorted buffer per decision and value count, not per row."""
    x = "quality_score"
    rows = A.evaluations(spark, sf_dir).groupBy("decision").agg(
        F.count("*").alias("n"), F.round(F.avg(x), 4).alias("mean"), F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("p"), F.min(x).alias("lo"), F.max(x).alias("hi")
    )
    total = Window.partitionBy()
    return rows.select("decision", "n", F.round(F.col("n") / F.sum("n").over(total), 4).alias("pct"), "mean", F.round(F.col("p")[1], 4).alias("median"), F.round(F.col("p")[0], 4).alias("p25"), F.round(F.col("p")[2], 4).alias("p75"), "lo", "hi")


@query("SELECT round(quantile_cont(value, 0.9), 4) AS p90, round(quantile_cont(value, 0.1), 4) AS p10 FROM events", cte=False)
def a17_percentile(spark, sf_dir):
    p = F.percentile("value", F.array(F.lit(0.9), F.lit(0.1)))
    return A.read(spark, sf_dir, "events").agg(p.alias("p")).select(F.round(F.col("p")[0], 4).alias("p90"), F.round(F.col("p")[1], 4).alias("p10"))


@query("""SELECT reason, count(*) FILTER (WHERE decision = 'publish') AS publish, count(*) FILTER (WHERE decision = 'review') AS review, count(*) FILTER (WHERE decision = 'reject') AS reject, count(*) FILTER (WHERE decision = 'extract') AS extract FROM (
 SELECT decision, coalesce(reason, 'none') AS reason FROM evaluaciones UNION ALL SELECT decision, second_reason FROM evaluaciones WHERE second_reason IS NOT NULL AND second_reason IS DISTINCT FROM reason) GROUP BY 1""")
def a18_reason_crosstab(spark, sf_dir):
    """The primary reason once, other codes exploded without it."""
    codes = F.array_compact(F.array(F.coalesce("reason", F.lit("none")), F.when(~F.col("second_reason").eqNullSafe(F.col("reason")), F.col("second_reason"))))
    rows = A.evaluations(spark, sf_dir).select("decision", F.explode(codes).alias("reason"))
    counts = rows.groupBy("reason").pivot("decision", ["publish", "review", "reject", "extract"]).agg(F.count(F.lit(1)))
    return counts.na.fill(0)


@query("SELECT coalesce(platform, 'unknown') AS platform, decision, count(*) AS n FROM evaluaciones GROUP BY 1, 2")
def a19_platform_decision(spark, sf_dir):
    return A.evaluations(spark, sf_dir).groupBy(F.coalesce("platform", F.lit("unknown")).alias("platform"), "decision").agg(F.count("*").alias("n"))


_EDGES = (0.2, 0.4, 0.55, 0.7, 0.8, 0.9)
_LABELS = ["<0.20", "0.20-0.39", "0.40-0.54", "0.55-0.69", "0.70-0.79", "0.80-0.89", ">=0.90"]


def bucket(x):
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    out = F.when(x < _EDGES[0], _LABELS[0])
    for e, label in zip(_EDGES[1:], _LABELS[1:]):
        out = out.when(x < e, label)
    return out.otherwise(_LABELS[-1])


def _bucket_sql(x: str) -> str:
    return "CASE " + " ".join(f"WHEN greatest(0.0, least(1.0, {x})) < {e} THEN '{label}'" for e, label in zip(_EDGES, _LABELS)) + f" ELSE '{_LABELS[-1]}' END"


@query(f"SELECT 'quality' AS score, {_bucket_sql('quality_score')} AS bucket, count(*) AS n FROM evaluaciones WHERE quality_score IS NOT NULL GROUP BY 2 UNION ALL SELECT 'policy', {_bucket_sql('(policy_score + 1) / 2')}, count(*) FROM evaluaciones WHERE policy_score IS NOT NULL GROUP BY 2")
def a20_histograms(spark, sf_dir):
    scores = F.array(F.struct(F.lit("quality").alias("score"), F.col("quality_score").alias("x")), F.struct(F.lit("policy").alias("score"), ((F.col("policy_score") + 1) / 2).alias("x")))
    rows = A.evaluations(spark, sf_dir).select(F.inline(scores)).where("x IS NOT NULL")
    return rows.groupBy("score", bucket(F.col("x")).alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS records, count(quality_score) AS quality, count(policy_score) AS policy, count(reason) AS reasons FROM evaluaciones")
def a21_coverage(spark, sf_dir):
    return A.evaluations(spark, sf_dir).agg(F.count("*").alias("records"), F.count("quality_score").alias("quality"), F.count("policy_score").alias("policy"), F.count("reason").alias("reasons"))


ANOMALIES = {
    "publish_low_quality": "decision = 'publish' AND quality_score < 0.55",
    "reject_high_quality": "decision = 'reject' AND quality_score >= 0.8",
    "publish_negative_policy": "decision = 'publish' AND policy_score < 0",
    "reject_positive_policy": "decision = 'reject' AND policy_score >= 0.5",
    "review_extreme": "decision = 'review' AND (quality_score >= 0.9 OR quality_score < 0.2)",
    "flagged_without_reason": "decision IN ('review', 'reject') AND reason IS NULL",
    "publish_with_reason": "decision = 'publish' AND reason IS NOT NULL",
}


@query("SELECT anomaly, total, id FROM (SELECT *, count(*) OVER (PARTITION BY anomaly) AS total, row_number() OVER (PARTITION BY anomaly ORDER BY id) AS rn FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS anomaly, id FROM evaluaciones WHERE {c}" for n, c in ANOMALIES.items()) + ")) WHERE rn <= 5")
def a22_anomalies(spark, sf_dir):
    """Seven buckets in one scan; counts are partial sums, samples a limited window."""
    tags = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(n)) for n, c in ANOMALIES.items()]))
    rows = A.evaluations(spark, sf_dir).select("id", F.explode(tags).alias("anomaly"))
    w = Window.partitionBy("anomaly").orderBy("id")
    sample = rows.withColumn("rn", F.row_number().over(w)).where("rn <= 5").drop("rn")
    return sample.join(rows.groupBy("anomaly").agg(F.count("*").alias("total")), "anomaly").select("anomaly", "total", "id")


@query("SELECT institucion_id, n, publicadas, round(publicadas * 100.0 / n, 1) AS precision_pct FROM (SELECT institucion_id, count(*) AS n, count(*) FILTER (WHERE decision = 'publish') AS publicadas FROM evaluaciones GROUP BY 1) WHERE n >= 5 AND publicadas * 100.0 / n < 70")
def a25_low_precision(spark, sf_dir):
    rows = A.evaluations(spark, sf_dir).groupBy("institucion_id").agg(F.count("*").alias("n"), F.count_if(F.col("decision") == "publish").alias("publicadas"))
    pct = F.col("publicadas") * 100.0 / F.col("n")
    return rows.where((F.col("n") >= 5) & (pct < 70)).select("institucion_id", "n", "publicadas", F.round(pct, 1).alias("precision_pct"))


@query("SELECT s.estado, count(e.id) AS n FROM (VALUES ('publish'), ('review'), ('reject'), ('extract'), ('blocked'), ('manual')) s(estado) LEFT JOIN evaluaciones e ON e.decision = s.estado GROUP BY 1")
def a26_zero_filled(spark, sf_dir):
    names = spark.createDataFrame([(x,) for x in ("publish", "review", "reject", "extract", "blocked", "manual")], "estado string")
    n = A.evaluations(spark, sf_dir).groupBy(F.col("decision").alias("estado")).agg(F.count("*").alias("n"))
    return names.join(n, "estado", "left").select("estado", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT event_type AS sector, count(*) AS clicks FROM events GROUP BY 1 ORDER BY clicks DESC, sector LIMIT 3", cte=False)
def a31_clicks_by_sector(spark, sf_dir):
    return A.read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("sector")).agg(F.count("*").alias("clicks")).orderBy(F.desc("clicks"), "sector").limit(3)


@query("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY institucion_id ORDER BY evaluated_at DESC, id DESC) AS rn FROM evaluaciones WHERE decision <> 'view') WHERE rn = 1".replace("SELECT * FROM", "SELECT id, institucion_id, decision, evaluated_at FROM"))
def w01_distinct_on(spark, sf_dir):
    return latest(A.evaluations(spark, sf_dir).where("decision <> 'view'")).select("id", "institucion_id", "decision", "evaluated_at")


@query("SELECT institucion_id, coalesce(retry_policy, 'medium') AS retry_policy, coalesce(TRY_CAST(json_extract_string(signals_json, '$.k') AS INT), 0) AS zeros FROM (SELECT *, row_number() OVER (PARTITION BY institucion_id ORDER BY evaluated_at DESC, id DESC) AS rn FROM evaluaciones) WHERE rn = 1")
def w02_last_state(spark, sf_dir):
    k = F.get_json_object("signals_json", "$.k").try_cast("int")
    return latest(A.evaluations(spark, sf_dir)).select("institucion_id", F.coalesce("retry_policy", F.lit("medium")).alias("retry_policy"), F.coalesce(k, F.lit(0)).alias("zeros"))


@query("SELECT institucion_id, decision, arg_max(signals_json, struct_pack(a := evaluated_at, b := id)) AS payload FROM evaluaciones GROUP BY 1, 2")
def w03_latest_payload(spark, sf_dir):
    return A.evaluations(spark, sf_dir).groupBy("institucion_id", "decision").agg(F.max_by("signals_json", F.struct("evaluated_at", "id")).alias("payload"))


@query("SELECT url, min(page_id) AS page_id FROM pages GROUP BY url", cte=False)
def w04_first_seen(spark, sf_dir):
    return A.read(spark, sf_dir, "pages").groupBy("url").agg(F.min("page_id").alias("page_id"))


@query("SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY institucion_id, lower(coalesce(cargo, '')), fecha_cierre ORDER BY id) AS rn FROM ofertas) WHERE rn > 1")
def w06_fingerprint_duplicates(spark, sf_dir):
    """A sha1 of institution, folded title and closing date stands for the business key."""
    key = F.sha1(F.concat_ws("|", F.coalesce(F.col("institucion_id").cast("string"), F.lit("")), F.lower(F.coalesce("cargo", F.lit(""))), F.coalesce(F.col("fecha_cierre").cast("string"), F.lit(""))))
    w = Window.partitionBy("k").orderBy("id")
    return A.offers(spark, sf_dir).withColumn("k", key).withColumn("rn", F.row_number().over(w)).where("rn > 1").select("id")


@query("SELECT oferta_id, linea, capturado_en, renta - lag(renta) OVER (PARTITION BY oferta_id ORDER BY capturado_en, linea, renta) AS cambio FROM snapshots")
def w09_snapshot_timeline(spark, sf_dir):
    w = Window.partitionBy("oferta_id").orderBy("capturado_en", "linea", "renta")
    return A.snapshots(spark, sf_dir).select("oferta_id", "linea", "capturado_en", (F.col("renta") - F.lag("renta").over(w)).alias("cambio"))


@query("SELECT institucion_id, round((epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(max(evaluated_at))) / 3600.0, 1) AS horas FROM evaluaciones GROUP BY 1")
def d13_hours_since(spark, sf_dir):
    return A.evaluations(spark, sf_dir).groupBy("institucion_id").agg(F.round((F.unix_micros(EVENTS.instant) - F.unix_micros(F.max("evaluated_at").cast("timestamp"))) / 3.6e9, 1).alias("horas"))


@query("SELECT check_name, violations, round(100.0 * violations / total, 2) AS pct FROM (SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE {c}) AS {n}" for n, c in CHECKS.items()) + " FROM ofertas) UNPIVOT (violations FOR check_name IN (" + ", ".join(CHECKS) + "))")
def v28_quality_report(spark, sf_dir):
    row = A.offers(spark, sf_dir).agg(F.count("*").alias("total"), *[F.count_if(F.expr(c)).alias(n) for n, c in CHECKS.items()])
    return row.unpivot("total", list(CHECKS), "check_name", "violations").select("check_name", "violations", F.round(100.0 * F.col("violations") / F.col("total"), 2).alias("pct"))

"""Source policy, lookups, fuzzy joins and named queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plazamill.context import OFFERS
from plazamill.functions import dates as DT
from plazamill.functions import lookups as L
from plazamill.functions import money as M
from plazamill.functions import text as T
from plazamill.operators import fuzzy
from plazamill.operators import offers as O
from plazamill.operators import rules as R
from plazamill.operators import sources_policy as P
from plazamill.sources import adapters as A
from plazamill.sources import html

from .base import query
from .listing import ACTIVE, BASE, D, P01, joined, latest
from .scalars import _MONTHS, _N, _P, _sql_date, _sql_pesos, docs, notices, sql_normal

LAST = "(SELECT *, row_number() OVER (PARTITION BY institucion_id ORDER BY evaluated_at DESC, id DESC) AS rn FROM evaluaciones)"


def _case(x: str, table, default: str = "NULL") -> str:
    q = lambda s: s.replace("'", "''")
    return "CASE " + " ".join(f"WHEN contains({x}, '{q(k)}') THEN '{q(v)}'" for k, v in table) + f" ELSE {default} END"


_PLACES = "CASE c_custkey % 6 WHEN 0 THEN 'Región del Maule y Biobío' WHEN 1 THEN 'SANTIAGO, R.M. metropolitana' WHEN 2 THEN 'Ñuble' WHEN 3 THEN 'Firma en la costa' WHEN 4 THEN '' ELSE c_mktsegment END"
_KINDS = "CASE c_custkey % 5 WHEN 0 THEN 'Código del  Trabajo, planta' WHEN 1 THEN 'A honorarios' WHEN 2 THEN 'SUPLENCIA' WHEN 3 THEN NULL ELSE 'otra' END"


@query(f"SELECT c_custkey AS id, CASE WHEN t <> '' THEN {_case(sql_normal('t'), L.by_length(L.REGIONS))} END AS region FROM (SELECT c_custkey, {_PLACES} AS t FROM customer)", cte=False)
def l01_region(spark, sf_dir):
    return A.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), L.longest_key(F.expr(_PLACES), L.REGIONS).alias("region"))


@query(f"SELECT c_custkey AS id, {_case(sql_normal('t'), L.by_length(L.CONTRACTS))} AS tipo FROM (SELECT c_custkey, {_KINDS} AS t FROM customer)", cte=False)
def l02_contract(spark, sf_dir):
    return A.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), L.longest_key(F.expr(_KINDS), L.CONTRACTS).alias("tipo"))


@query("SELECT c_custkey AS id, regexp_replace(" + sql_normal("t") + ", '^(ilustre municipalidad de|i\\. municipalidad de|municipalidad de|municipio de)\\s+', '') AS nombre FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Ilustre Municipalidad de  Ñuñoa' WHEN 1 THEN 'I. MUNICIPALIDAD DE ' || c_name ELSE c_name END AS t FROM customer)", cte=False)
def s09_municipal_prefix(spark, sf_dir):
    t = F.expr("CASE c_custkey % 3 WHEN 0 THEN 'Ilustre Municipalidad de  Ñuñoa' WHEN 1 THEN concat('I. MUNICIPALIDAD DE ', c_name) ELSE c_name END")
    return A.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), T.without_municipal_prefix(t).alias("nombre"))




_PHRASES = ("plazo hasta", "hasta el", "cierra el", "recepcion")


def _first_near(text):
    """The first date within 150 characters of a closing phrase; else the nearest to come, the latest within 30 days past, the latest."""
    folded = F.lower(T.strip_accents(text))
    near = [F.when(F.instr(folded, p) > 0, DT.first_date(F.substring(text, F.instr(folded, p), F.lit(150)))) for p in _PHRASES]
    every = DT.all_dates(F.coalesce(text, F.lit("")))
    fresh = F.filter(every, lambda x: F.datediff(x, OFFERS.day) >= -30)
    return F.coalesce(*near, F.array_min(F.filter(fresh, lambda x: x >= OFFERS.day)), F.array_max(fresh), F.array_max(every))


def _sql_first(x: str) -> str:
    spa = "(?i)\\b([0-9]{1,2})\\s+de\\s+([a-záéíóúñ]+)\\s+de\\s+([0-9]{4})\\b"
    return f"coalesce({', '.join(_sql_date(p, g, x) for p, g in _P)}, CAST(try_strptime(regexp_extract({x}, '{spa}', 3) || '-' || list_position({_MONTHS}, lower(regexp_extract({x}, '{spa}', 2)))::VARCHAR || '-' || regexp_extract({x}, '{spa}', 1), '%Y-%m-%d') AS DATE))"


_FOLD = f"lower(translate(texto, '{T.ACCENTED}', '{T.PLAIN}'))"
_EVERY = " || ".join(f"list_transform(regexp_extract_all(coalesce(texto, ''), '\\b{p}\\b'), lambda x: {_sql_date(p, g, 'x')})" for p, g in _P)


@query(f"""SELECT id, CAST(coalesce({', '.join(f"CASE WHEN instr({_FOLD}, '{p}') > 0 THEN {_sql_first(f"substring(texto, instr({_FOLD}, '{p}'), 150)")} END" for p in _PHRASES)}, list_min(list_filter(e, lambda x: x >= {D})), list_max(list_filter(e, lambda x: x - {D} >= -30)), list_max(e)) AS VARCHAR) AS fecha
 FROM (SELECT id, texto, list_filter({_EVERY}, lambda x: x IS NOT NULL) AS e FROM {_N})""", cte=False)
def d03_closing_date(spark, sf_dir):
    return notices(spark, sf_dir).select("id", _first_near(F.col("texto")).cast("string").alias("fecha"))


@query(f"SELECT id, {_sql_pesos('texto')} AS pesos FROM (SELECT id, regexp_extract(texto, '\\$ ?([0-9.]+)', 1) AS texto FROM {_N})", cte=False)
def n01_pesos(spark, sf_dir):
    return notices(spark, sf_dir).select("id", M.pesos(F.regexp_extract("texto", "\\$ ?([0-9.]+)", 1)).alias("pesos"))


_FAMILY = "CASE event_id % 8 WHEN 0 THEN 'generic' WHEN 1 THEN 'wordpress' WHEN 2 THEN 'external_ats' WHEN 3 THEN 'trusted_portal' WHEN 4 THEN 'waf_protected' WHEN 5 THEN 'pdf_first_waf' ELSE 'js_intensive' END"
_HIST = f"SELECT event_id AS id, {_FAMILY} AS family, 0.75 + CAST(event_id % 3 AS DOUBLE) / 20 AS extract_threshold, 0.55 AS manual_threshold, event_id % 30 AS sample, CAST(event_id % 11 AS DOUBLE) / 10 AS prec, CAST(event_id % 7 AS DOUBLE) / 6 AS rec FROM events"
_FT = ", ".join(f"('{k}', {', '.join(map(str, v))})" for k, v in P.FAMILIES.items())


@query(f"""SELECT id, band, extract_applied, round(CASE WHEN ok THEN least(extract_applied - 0.05, greatest(0.35, round(manual_threshold + shift, 4))) ELSE manual_threshold END, 4) AS manual_applied FROM (SELECT *, CASE WHEN ok THEN least(0.95, greatest(0.55, round(extract_threshold + shift, 4))) ELSE extract_threshold END AS extract_applied FROM (
 SELECT h.*, coalesce(sample >= fl, FALSE) AS ok, CASE WHEN coalesce(sample >= fl, FALSE) AND prec >= gp AND rec >= gr THEN -d WHEN coalesce(sample >= fl, FALSE) AND (prec <= pp OR rec <= pr) THEN d ELSE 0 END AS shift, CASE WHEN fl IS NULL THEN 'unknown' WHEN sample < fl THEN 'insufficient_sample' WHEN prec >= gp AND rec >= gr THEN 'high_precision_recall' WHEN prec <= pp OR rec <= pr THEN 'low_precision_or_recall' ELSE 'stable' END AS band
 FROM ({_HIST}) h LEFT JOIN (VALUES {_FT}) f(family, fl, gp, gr, pp, pr, d) USING (family)))""", cte=False)
def v18_adaptive_thresholds(spark, sf_dir):
    rows = A.read(spark, sf_dir, "events").selectExpr("event_id AS id", f"{_FAMILY} AS family", "CAST(0.75 AS DOUBLE) + CAST(event_id % 3 AS DOUBLE) / 20 AS extract_threshold", "CAST(0.55 AS DOUBLE) AS manual_threshold", "event_id % 30 AS sample", "CAST(event_id % 11 AS DOUBLE) / 10 AS precision", "CAST(event_id % 7 AS DOUBLE) / 6 AS recall")
    return P.thresholds(rows).select("id", "band", "extract_applied", "manual_applied")


_HOURS = "CASE retry_policy " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in R.TIER_HOURS.items()) + " ELSE 12 END"
_LATE = "TIMESTAMP '2024-01-30 12:00:00'"


@query(f"""SELECT id, motivo, motivo <> 'cooldown' AS reevaluar FROM (SELECT i.id, CASE WHEN e.institucion_id IS NULL THEN 'sin_historial' WHEN (epoch({_LATE}) - epoch(evaluated_at)) / 3600.0 >= {_HOURS} THEN 'cooldown_vencido' WHEN z > 3 AND i.id % 2 = 0 THEN 'cooldown_bypass_one_time_zero_threshold' WHEN coalesce(retry_policy, '') IN ('critical', 'high') THEN 'cooldown_light_recheck_high_priority' WHEN z > 0 THEN 'cooldown_light_recheck_zero_streak' ELSE 'cooldown' END AS motivo
 FROM instituciones i LEFT JOIN (SELECT *, coalesce(TRY_CAST(json_extract_string(signals_json, '$.k') AS INT), 0) % 5 AS z FROM {LAST} WHERE rn = 1) e ON e.institucion_id = i.id)""")
def v24_cooldown_partition(spark, sf_dir):
    e = latest(A.evaluations(spark, sf_dir)).select("institucion_id", "retry_policy", "evaluated_at", (F.coalesce(F.get_json_object("signals_json", "$.k").try_cast("int"), F.lit(0)) % 5).alias("z"))
    i = A.institutions(spark, sf_dir).select("id")
    j = i.join(e, i["id"] == e["institucion_id"], "left")
    c = P.cooldown(F.col("id"), F.col("institucion_id").isNotNull(), F.col("retry_policy"), F.col("evaluated_at"), F.col("z"), F.col("id") % 2 != 0, F.to_timestamp(F.lit("2024-01-30 12:00:00")))
    return j.select("id", c["reason"].alias("motivo"), c["reevaluate"].alias("reevaluar"))






@query()
def j08_fuzzy_names(spark, sf_dir):
    """Names with one letter changed find their institution again."""
    c = A.read(spark, sf_dir, "customer")
    names = c.select(F.col("c_custkey").alias("id"), F.regexp_replace("c_name", "Customer", "Custumer").alias("nombre"))
    return fuzzy.best_match(names, c, "nombre", "c_custkey", "c_name")


@query()
def u13_html_candidates(spark, sf_dir):
    return html.candidates(A.read(spark, sf_dir, "pages"))


# --- named queries


@query(f"SELECT id, institucion, cargo, estado FROM ({P01} {BASE} WHERE {ACTIVE} AND coalesce(i.sector, o.sector, i.tipo, '') ILIKE '%auto%' ORDER BY CASE WHEN o.fecha_cierre IS NULL THEN 1 ELSE 0 END, o.fecha_cierre, o.id LIMIT 20)")
def q01_offer_search(spark, sf_dir):
    rows = joined(spark, sf_dir).where(O.filters(OFFERS, sector="auto"))
    return O.projection(O.page(rows, O.listing_order("cierre", OFFERS), 1, 20), OFFERS).select("id", "institucion", "cargo", "estado")


@query(f"{P01} {BASE} WHERE o.id = 3", dates=("fecha_publicacion", "fecha_inicio", "fecha_cierre"))
def q02_offer_by_id(spark, sf_dir):
    offers, i = A.offers(spark, sf_dir).where("id = 3"), A.institutions(spark, sf_dir)
    return O.projection(O.with_institution(offers, i), OFFERS)


@query(f"SELECT i.id, i.nombre, count(o.id) FILTER (WHERE {ACTIVE}) AS activas FROM instituciones i LEFT JOIN ofertas o ON o.institucion_id = i.id WHERE i.activa AND coalesce(i.sector, i.tipo, '') ILIKE '%mach%' GROUP BY i.id, i.nombre ORDER BY activas DESC, i.nombre LIMIT 20")
def q04_institutions(spark, sf_dir):
    from .listing import j02_institution_counts

    pick = A.institutions(spark, sf_dir).where(F.col("activa") & O.has(F.coalesce("sector", "tipo", F.lit("")), "mach")).select("id")
    return j02_institution_counts(spark, sf_dir).join(pick, "id", "left_semi").orderBy(F.desc("activas"), "nombre").limit(20)


@query(f"SELECT o.id FROM ofertas o WHERE o.institucion_id = 100 AND {ACTIVE} ORDER BY o.id")
def q05_institution_offers(spark, sf_dir):
    return A.offers(spark, sf_dir).where((F.col("institucion_id") == 100) & O.is_active(OFFERS)).orderBy("id").select("id")


@query(f"SELECT cargo, count(*) AS total FROM ofertas o WHERE institucion_id = 100 GROUP BY cargo ORDER BY total DESC, cargo NULLS LAST LIMIT 10")
def q06_institution_titles(spark, sf_dir):
    return A.offers(spark, sf_dir).where("institucion_id = 100").groupBy("cargo").agg(F.count("*").alias("total")).orderBy(F.desc("total"), F.asc_nulls_last("cargo")).limit(10)


@query(f"SELECT i.id, e.decision, coalesce(n.n, 0) AS oferta_count FROM instituciones i LEFT JOIN (SELECT * FROM {LAST} WHERE rn = 1) e ON e.institucion_id = i.id LEFT JOIN (SELECT institucion_id, count(*) AS n FROM ofertas o WHERE {ACTIVE} GROUP BY 1) n ON n.institucion_id = i.id")
def q22_sources(spark, sf_dir):
    from .listing import j02_institution_counts

    last = latest(A.evaluations(spark, sf_dir)).select("institucion_id", "decision")
    i = j02_institution_counts(spark, sf_dir)
    return i.join(last, i["id"] == last["institucion_id"], "left").select("id", "decision", F.col("activas").alias("oferta_count"))


@query("SELECT id, fecha_publicacion FROM ofertas WHERE institucion_id = 100 ORDER BY fecha_publicacion DESC NULLS LAST, id DESC LIMIT 10", dates=("fecha_publicacion",))
def q23_source_last_offers(spark, sf_dir):
    return A.offers(spark, sf_dir).where("institucion_id = 100").orderBy(F.desc_nulls_last("fecha_publicacion"), F.desc("id")).limit(10).select("id", "fecha_publicacion")


@query(f"SELECT coalesce(sector, 'sin') AS sector, coalesce(region, 'sin') AS region, count(*) AS total FROM ofertas GROUP BY 1, 2")
def q32_by_sector_region(spark, sf_dir):
    return A.offers(spark, sf_dir).groupBy(F.coalesce("sector", F.lit("sin")).alias("sector"), F.coalesce("region", F.lit("sin")).alias("region")).agg(F.count("*").alias("total"))

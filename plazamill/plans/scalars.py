"""Scalar functions and rules, run over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plazamill.context import EVENTS, OFFERS
from plazamill.functions import dates as DT
from plazamill.functions import money as M
from plazamill.functions import policy_lists as PL
from plazamill.functions import text as T
from plazamill.operators import rules as R
from plazamill.sources import adapters as A

from .base import query
from .listing import D

ACC = f"'{T.ACCENTED}', '{T.PLAIN}'"
#: DuckDB sides of the text functions.
SQL_CLEAN = "trim(regexp_replace({}, '[\\s ]+', ' ', 'g'))"


def sql_normal(x: str) -> str:
    return f"coalesce({SQL_CLEAN.format(f'lower(translate({x}, {ACC}))')}, '')"


def sql_fold(x: str) -> str:
    return f"coalesce(trim(lower(regexp_replace(translate({x}, {ACC}), '[^\\x00-\\x7F]', '', 'g'))), '')"


def docs(spark, sf_dir):
    return A.read(spark, sf_dir, "documents")


def _short(name: str, column, sql: str):
    """A text function over every document; long results are compared by digest."""

    def run(spark, sf_dir):
        return docs(spark, sf_dir).select("doc_id", F.md5(column(F.col("text"))).alias("digest"))

    run.__name__ = name
    return query(f"SELECT doc_id, md5({sql}) AS digest FROM documents", cte=False)(run)


_short("s01_strip_accents", T.strip_accents, f"translate(text, {ACC})")
_short("s02_normal_text", T.normal, sql_normal("text"))
_short("s03_clean_text", T.clean, SQL_CLEAN.format("text"))
_short("s04_ascii_fold", T.ascii_fold, sql_fold("text"))
_short("s05_cut_500", lambda c: T.cut(c, 500), f"nullif(substring({SQL_CLEAN.format('text')}, 1, 500), '')")
_short("s06_ellipsis_180", lambda c: T.ellipsis(c, 180), "CASE WHEN length(text) > 180 THEN substring(text, 1, 177) || '...' ELSE text END")
_short("s08_slug", T.slug, f"regexp_replace(substring(regexp_replace(regexp_replace(lower(translate(text, {ACC})), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80), '-+$', '')")
_short("s12_content_hash", lambda c: T.content_hash(c, F.col("source"), F.col("lang")), "sha256(coalesce(text, '') || '|' || coalesce(source, '') || '|' || coalesce(lang, ''))")
_short("s13_stable_id", lambda c: T.stable_id(c, F.col("source")), f"substring(sha1({SQL_CLEAN.format('lower(text)')} || '||' || lower(source)), 1, 20)")
_LINES = "list_filter(list_transform(list_filter(list_zip(string_split(text, chr(10)), generate_series(1, len(string_split(text, chr(10))))), lambda p: list_position(string_split(text, chr(10)), p[1]) = p[2]), lambda p: p[1]), lambda x: regexp_matches(x, '[A-Za-z]') AND NOT (length(x) > 200 AND NOT regexp_matches(x, '[.,;:]')))"
_short("s24_noise_lines", lambda c: F.array_join(F.filter(F.array_distinct(F.split(c, "\n")), lambda x: x.rlike("[A-Za-z]") & ~((F.length(x) > 200) & ~x.rlike("[.,;:]"))), "\n"), f"array_to_string({_LINES}, chr(10))")


@query("SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '^www\\.', '') AS host FROM pages", cte=False)
def s15_host(spark, sf_dir):
    return A.read(spark, sf_dir, "pages").select("page_id", T.host(F.col("url")).alias("host"))


@query("SELECT page_id, array_to_string(list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> ''), '>') AS segments FROM pages", cte=False)
def s16_path_segments(spark, sf_dir):
    return A.read(spark, sf_dir, "pages").select("page_id", F.array_join(T.path_segments(F.col("url")), ">").alias("segments"))


_PARTS = f"""SELECT page_id, u, lower(regexp_extract(u, '^([A-Za-z]+)://', 1)) AS scheme, regexp_replace(lower(regexp_extract(u, '^[A-Za-z]+://([^/?#:]+)', 1)), '^www\\.', '') AS host, regexp_replace(regexp_extract(u, '^[A-Za-z]+://[^/?#]+([^?#]*)', 1), '/+$', '') AS path,
 array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '\\?([^#]*)', 1), '&'), lambda p: regexp_matches(p, '^[^=]+=.+') AND NOT list_contains([{", ".join(f"'{t}'" for t in T.TRACKING)}], lower(split_part(p, '=', 1))))), '&') AS q
 FROM (SELECT page_id, regexp_replace(url, '#.*$', '') || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_source=x&b=2&a=1&empty=#top' AS u FROM pages)"""
_CANON = "scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN q = '' THEN '' ELSE '?' || q END"


def _dirty(spark, sf_dir):
    url = F.regexp_replace("url", "#.*$", "")
    return A.read(spark, sf_dir, "pages").select("page_id", F.concat(url, F.when(F.contains(F.col("url"), F.lit("?")), "&").otherwise("?"), F.lit("utm_source=x&b=2&a=1&empty=#top")).alias("u"))


@query(f"SELECT page_id, {_CANON} AS canonical FROM ({_PARTS})", cte=False)
def s10_canonical_url(spark, sf_dir):
    return _dirty(spark, sf_dir).select("page_id", T.canonical_url(F.col("u")).alias("canonical"))


@query(f"SELECT page_id, sha256({_CANON}) AS url_hash, sha256(lower(trim(u))) AS raw_hash FROM ({_PARTS})", cte=False)
def s11_url_hashes(spark, sf_dir):
    return _dirty(spark, sf_dir).select("page_id", T.url_hash(F.col("u")).alias("url_hash"), T.raw_url_hash(F.col("u")).alias("raw_hash"))


_SPAN = "replace(format('{:,}', %s), ',', '.')"


@query(f"""SELECT id, CASE WHEN renta_bruta_min IS NOT NULL AND renta_bruta_max IS NOT NULL AND renta_bruta_min <> renta_bruta_max THEN '$' || {_SPAN % 'renta_bruta_min'} || ' a $' || {_SPAN % 'renta_bruta_max'} WHEN renta_bruta_min IS NOT NULL AND renta_bruta_max IS NOT NULL THEN '$' || {_SPAN % 'renta_bruta_min'}
 WHEN renta_bruta_min IS NOT NULL THEN 'Desde $' || {_SPAN % 'renta_bruta_min'} WHEN renta_bruta_max IS NOT NULL THEN 'Hasta $' || {_SPAN % 'renta_bruta_max'} END AS renta FROM ofertas""")
def s29_pay_text(spark, sf_dir):
    return A.offers(spark, sf_dir).select("id", T.pay_range(F.col("renta_bruta_min"), F.col("renta_bruta_max")).alias("renta"))


_MONTHS = "[" + ", ".join(f"'{m}'" for m in DT.MONTHS) + "]"


@query(f"SELECT id, day(fecha_cierre)::VARCHAR || ' de ' || {_MONTHS}[month(fecha_cierre)] || ' de ' || year(fecha_cierre)::VARCHAR AS fecha FROM ofertas")
def s30_long_date(spark, sf_dir):
    return A.offers(spark, sf_dir).select("id", DT.long_date(F.col("fecha_cierre")).alias("fecha"))


#: A notice text with dates and amounts, alike in Spark and DuckDB.
NOTICE = """CASE o_orderkey % 6 WHEN 0 THEN concat('Plazo hasta el ', CAST(day(o_orderdate) AS VARCHAR(9)), '/', CAST(month(o_orderdate) AS VARCHAR(9)), '/', CAST(year(o_orderdate) AS VARCHAR(9)), ' y renta de $ 1.2', CAST(o_orderkey % 10 AS VARCHAR(9)), '0.000 mensual')
 WHEN 1 THEN concat('Cierra el ', CAST(day(o_orderdate) AS VARCHAR(9)), ' de ', CASE month(o_orderdate) WHEN 1 THEN 'enero' WHEN 2 THEN 'Febrero' WHEN 5 THEN 'mayo' WHEN 9 THEN 'septiembre' ELSE 'brumario' END, ' de ', CAST(year(o_orderdate) AS VARCHAR(9)))
 WHEN 2 THEN concat('Entre $', CAST(o_orderkey % 9 + 1 AS VARCHAR(9)), '50.000 y $', CAST(o_orderkey % 3 + 1 AS VARCHAR(9)), '.300.000 desde 31-02-1998 o 1997-', CAST(month(o_orderdate) AS VARCHAR(9)), '-', CAST(day(o_orderdate) AS VARCHAR(9)))
 WHEN 3 THEN concat('Recepción ', CAST(day(o_orderdate) AS VARCHAR(9)), '.', CAST(month(o_orderdate) AS VARCHAR(9)), '.1998 - ', CAST(day(o_orderdate) AS VARCHAR(9)), '-', CAST(month(o_orderdate) AS VARCHAR(9)), '-1999, monto anual $45.000.000')
 WHEN 4 THEN 'Sin fechas; jornada de 44 horas' ELSE NULL END"""


def notices(spark, sf_dir):
    return A.read(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", f"{NOTICE} AS texto")


_N = f"(SELECT o_orderkey AS id, {NOTICE} AS texto FROM orders)"
_P = [("([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})", (1, 2, 3)), ("([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})", (3, 2, 1)), ("([0-9]{1,2})-([0-9]{1,2})-([0-9]{4})", (3, 2, 1)), ("([0-9]{1,2})\\.([0-9]{1,2})\\.([0-9]{4})", (3, 2, 1))]


def _sql_date(p: str, groups, x: str = "texto") -> str:
    y, m, d = (f"regexp_extract({x}, '\\b{p}\\b', {g})" for g in groups)
    return f"CAST(try_strptime({y} || '-' || {m} || '-' || {d}, '%Y-%m-%d') AS DATE)"


_SPA = "(?i)\\b([0-9]{1,2})\\s+de\\s+([a-záéíóúñ]+)\\s+de\\s+([0-9]{4})\\b"
_SQL_FIRST = f"coalesce({', '.join(_sql_date(p, g) for p, g in _P)}, CAST(try_strptime(regexp_extract(texto, '{_SPA}', 3) || '-' || list_position({_MONTHS}, lower(regexp_extract(texto, '{_SPA}', 2)))::VARCHAR || '-' || regexp_extract(texto, '{_SPA}', 1), '%Y-%m-%d') AS DATE))"


@query(f"SELECT id, CAST({_SQL_FIRST} AS VARCHAR) AS fecha FROM {_N}", cte=False)
def d01_first_date(spark, sf_dir):
    return notices(spark, sf_dir).select("id", DT.first_date(F.col("texto")).cast("string").alias("fecha"))


@query("SELECT id, " + " + ".join(f"len(list_filter(regexp_extract_all(coalesce(texto, ''), '\\b{p}\\b'), lambda x: {_sql_date(p, g, 'x')} IS NOT NULL))" for p, g in _P) + f" AS n FROM {_N}", cte=False)
def d02_all_dates(spark, sf_dir):
    return notices(spark, sf_dir).select("id", F.size(DT.all_dates(F.coalesce("texto", F.lit("")))).cast("long").alias("n"))


_YEARS = "[" + ", ".join(f"CAST(try_strptime('{y}-' || m || '-' || d, '%Y-%m-%d') AS DATE)" for y in (1997, 1998, 1999)) + "]"


@query(f"""SELECT id, CAST(coalesce(list_min(list_filter(c, lambda x: x >= {D})), list_max(c)) AS VARCHAR) AS fecha FROM (SELECT id, list_filter({_YEARS}, lambda x: x IS NOT NULL AND x - {D} BETWEEN -30 AND 365) AS c FROM (SELECT o_orderkey AS id, day(o_orderdate)::VARCHAR AS d, month(o_orderdate)::VARCHAR AS m FROM orders))""", cte=False)
def d04_year_inference(spark, sf_dir):
    rows = A.read(spark, sf_dir, "orders")
    return rows.select(F.col("o_orderkey").alias("id"), DT.with_year(F.dayofmonth("o_orderdate"), F.month("o_orderdate"), OFFERS.day).cast("string").alias("fecha"))


@query("SELECT id, CAST(coalesce(CAST(try_strptime(t, '%Y-%m-%d') AS DATE), CAST(try_strptime(t, '%d/%m/%Y') AS DATE), CAST(try_strptime(t, '%d-%m-%Y') AS DATE)) AS VARCHAR) AS fecha FROM (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN '1998-05-07' WHEN 1 THEN '31/12/1998' WHEN 2 THEN '30-02-1998' ELSE 'pronto' END AS t FROM orders)", cte=False)
def d10_coerced(spark, sf_dir):
    t = F.expr("CASE o_orderkey % 4 WHEN 0 THEN '1998-05-07' WHEN 1 THEN '31/12/1998' WHEN 2 THEN '30-02-1998' ELSE 'pronto' END")
    return A.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), DT.coerced(t).cast("string").alias("fecha"))


@query(f"SELECT id, CASE WHEN dias < 0 OR dias > 30 THEN NULL WHEN dias = 0 THEN 'hoy' WHEN dias = 1 THEN 'ayer' ELSE 'hace ' || dias::VARCHAR || ' días' END AS frescura FROM (SELECT id, {D} - fecha_publicacion AS dias FROM ofertas)")
def d12_freshness(spark, sf_dir):
    n = F.datediff(OFFERS.day, "fecha_publicacion")
    text = F.when((n < 0) | (n > 30), None).when(n == 0, "hoy").when(n == 1, "ayer").otherwise(F.concat(F.lit("hace "), n.cast("string"), F.lit(" días")))
    return A.offers(spark, sf_dir).select("id", text.alias("frescura"))


def _sql_pesos(x: str) -> str:
    n = f"TRY_CAST(regexp_replace({x}, '[^0-9]', '', 'g') AS BIGINT)"
    return f"CASE WHEN {n} BETWEEN 300000 AND 30000000 THEN {n} END"


_RANGE = "entre\\s+\\$?\\s*([0-9][0-9.,]*[0-9])\\s+y\\s+\\$?\\s*([0-9][0-9.,]*[0-9])"


@query(f"""SELECT id, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN least(a, b) ELSE uno END AS minimo, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN greatest(a, b) END AS maximo FROM (SELECT id, {_sql_pesos(f"regexp_extract(lower(texto), '{_RANGE}', 1)")} AS a, {_sql_pesos(f"regexp_extract(lower(texto), '{_RANGE}', 2)")} AS b, {_sql_pesos("regexp_extract(texto, '\\$\\s*([0-9][0-9.,]*[0-9])', 1)")} AS uno FROM {_N})""", cte=False)
def n02_pay_extracted(spark, sf_dir):
    p = M.pay_between(F.col("texto"))
    return notices(spark, sf_dir).select("id", p["low"].alias("minimo"), p["high"].alias("maximo"))


@query(f"""SELECT id, CASE WHEN r IS NULL THEN CASE WHEN lo < 250000 THEN hi ELSE lo END END AS lo, CASE WHEN r IS NULL THEN hi END AS hi, r AS motivo FROM (SELECT id, lo, hi, CASE WHEN hi >= 15000000 THEN 'renta_descarte_monto_inverosimil' WHEN hi < 250000 THEN 'renta_descarte_monto_irrelevante' WHEN hi >= 2000000000 THEN 'x' WHEN hi >= 10000000 AND NOT regexp_matches(ctx, '{"|".join(M.CONTEXT)}') THEN 'renta_no_confiable_sin_contexto' END AS r
 FROM (SELECT id, ctx, least(coalesce(a, b), coalesce(b, a)) AS lo, greatest(coalesce(a, b), coalesce(b, a)) AS hi FROM (SELECT id, CASE WHEN renta_bruta_min > 0 THEN renta_bruta_min * 5 END AS a, CASE WHEN renta_bruta_max > 0 THEN renta_bruta_max * 5 END AS b, CASE WHEN id % 2 = 0 THEN 'Renta Bruta mensual' ELSE 'Monto' END AS t, {sql_fold("CASE WHEN id % 2 = 0 THEN 'Renta Bruta mensual' ELSE 'Monto' END")} AS ctx FROM ofertas)))""")
def n04_pay_assessed(spark, sf_dir):
    p = M.assessed(F.col("renta_bruta_min") * 5, F.col("renta_bruta_max") * 5, F.when(F.col("id") % 2 == 0, "Renta Bruta mensual").otherwise("Monto"))
    return A.offers(spark, sf_dir).select("id", p["low"].alias("lo"), p["high"].alias("hi"), p["reason"].alias("motivo"))


@query(f"SELECT id, CASE WHEN m AND a THEN 'mixed' WHEN m THEN 'mensual' WHEN a THEN 'anual' END AS unidad FROM (SELECT id, regexp_matches(t, 'mensual|mes') AS m, regexp_matches(t, 'anual|ano') AS a FROM (SELECT id, {sql_fold('texto')} AS t FROM {_N}))", cte=False)
def n06_pay_unit(spark, sf_dir):
    return notices(spark, sf_dir).select("id", M.unit(F.col("texto")).alias("unidad"))


@query("SELECT id, TRY_CAST(nullif(regexp_extract(texto, '([0-9]{1,2}) horas', 1), '') AS INT) AS horas FROM " + _N, cte=False)
def l06_working_hours(spark, sf_dir):
    return notices(spark, sf_dir).select("id", F.regexp_extract("texto", "([0-9]{1,2}) horas", 1).try_cast("int").alias("horas"))


def _sql_sector(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'{x} LIKE {chr(39)}{p}{chr(39)}' for p in ps)} THEN '{c}'" for ps, c in R.SECTORS) + " ELSE 'OTR' END"


@query(f"SELECT id, {_sql_sector('s')} AS codigo FROM (SELECT o.id, lower(translate(coalesce(nullif(o.sector, ''), i.sector, ''), {ACC})) AS s FROM ofertas o LEFT JOIN instituciones i ON i.id = o.institucion_id)")
def l05_sector_code(spark, sf_dir):
    from .listing import joined

    s = F.lower(T.strip_accents(F.coalesce(F.nullif("sector", F.lit("")), "i_sector", F.lit(""))))
    return joined(spark, sf_dir).select("id", R.sector_code(s).alias("codigo"))


@query(f"""SELECT id, coalesce(fecha_cierre < {D}, FALSE) OR (fecha_cierre IS NULL AND coalesce({D} - fecha_publicacion > 180, FALSE)) AS descartar, CASE WHEN fecha_cierre < {D} THEN 'fecha_cierre_vencida' WHEN fecha_cierre >= {D} THEN NULL WHEN {D} - fecha_publicacion > 365 THEN 'publicacion_excede_365_dias' WHEN {D} - fecha_publicacion > 180 THEN 'publicacion_excede_180_dias_sin_cierre' END AS motivo,
 fecha_cierre IS NULL AND coalesce({D} - fecha_publicacion BETWEEN 91 AND 180, FALSE) AS revisar FROM ofertas""")
def v05_vigency(spark, sf_dir):
    v = R.vigency(F.col("fecha_publicacion"), F.col("fecha_cierre"), OFFERS.day)
    return A.offers(spark, sf_dir).select("id", v["discard"].alias("descartar"), v["reason"].alias("motivo"), v["review"].alias("revisar"))


@query(f"SELECT id, CASE WHEN fecha_cierre IS NOT NULL THEN fecha_cierre >= {D} WHEN fecha_publicacion IS NOT NULL THEN {D} - fecha_publicacion <= 60 ELSE TRUE END AS vigente FROM ofertas")
def v02_in_force(spark, sf_dir):
    return A.offers(spark, sf_dir).select("id", DT.in_force(F.col("fecha_cierre"), F.col("fecha_publicacion"), OFFERS.day).alias("vigente"))


@query("SELECT id, CASE WHEN trim(coalesce(cargo, '')) = '' THEN 'sin_cargo' WHEN trim(coalesce(url_oferta, '')) = '' THEN 'sin_url' WHEN length(trim(cargo)) < 5 THEN 'cargo_demasiado_corto' END AS motivo FROM ofertas")
def v06_minimum_fields(spark, sf_dir):
    return A.offers(spark, sf_dir).select("id", R.minimum_fields(F.col("cargo"), F.col("url_oferta")).alias("motivo"))


#: Titles that the policy judges, alike in Spark and DuckDB.
TITLE = """CASE o_orderkey % 12 WHEN 0 THEN 'Concurso público: vacante de planta, ver bases y requisitos' WHEN 1 THEN 'Noticias del servicio' WHEN 2 THEN 'Llamado a becas para funcionarios' WHEN 3 THEN 'Cargo a contrata, sólo difusión interna' WHEN 4 THEN 'Aviso'
 WHEN 5 THEN 'Suplencia: postulación hasta el viernes' WHEN 6 THEN 'Nómina de seleccionados, concurso cerrado' WHEN 7 THEN '' WHEN 8 THEN 'Trabaja con nosotros' WHEN 9 THEN 'Resultados del concurso público' WHEN 10 THEN NULL ELSE concat('Empleo ', o_orderpriority) END"""
LINK = "CASE o_orderkey % 5 WHEN 0 THEN '/Noticias/2024' WHEN 1 THEN '/blog' WHEN 2 THEN NULL ELSE '/empleos' END"
_URLS = "|".join(PL.NEGATIVE_URL)


@query(f"""SELECT id, round(greatest(-1.0, least(1.0, s)), 4) AS score, round(s, 4) >= 0.2 AND hits > 0 AND NOT inside AS acepta, array_to_string(list_filter([CASE WHEN hits > 0 THEN 'positive_signals_detected' END, CASE WHEN bad_url THEN 'negative_url_pattern' END, CASE WHEN bad_text THEN 'negative_text_pattern' END, CASE WHEN inside THEN 'internal_only_signal' END,
 CASE WHEN length(b) < 8 THEN 'insufficient_text' END, CASE WHEN round(s, 4) >= 0.2 AND hits > 0 AND NOT inside THEN 'policy_accept' ELSE 'policy_reject' END], lambda x: x IS NOT NULL), ',') AS codigos FROM (SELECT *, least(0.75, hits * 0.1) - bad_url::INT * 0.45 - bad_text::INT * 0.35 - inside::INT * 0.6 - (length(b) < 8)::INT * 0.25 AS s FROM (
 SELECT id, b, ({" + ".join(f"contains(b, '{p}')::INT" for p in PL.POSITIVE)})::DOUBLE AS hits, regexp_matches(u, '{_URLS}') AS bad_url, regexp_matches(b, '{"|".join(PL.NEGATIVE)}') AS bad_text, regexp_matches(b, '{"|".join(PL.INTERNAL)}') AS inside FROM (SELECT o_orderkey AS id, {sql_fold(TITLE)} AS b, {sql_fold(LINK)} AS u FROM orders)))""", cte=False)
def v03_policy_score(spark, sf_dir):
    p = R.policy(F.col("b"), F.col("u"), list(PL.POSITIVE), "|".join(PL.NEGATIVE), _URLS, "|".join(PL.INTERNAL))
    rows = A.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), T.ascii_fold(F.expr(TITLE)).alias("b"), T.ascii_fold(F.expr(LINK)).alias("u"))
    return rows.select("id", p.alias("p")).select("id", "p.score", F.col("p.accept").alias("acepta"), F.array_join("p.reasons", ",").alias("codigos"))


_HOURS = "CASE retry_policy " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in R.TIER_HOURS.items()) + " ELSE 12 END"


@query(f"SELECT institucion_id, {_HOURS} AS horas, (epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(evaluated_at)) / 3600.0 >= {_HOURS} AS toca FROM (SELECT *, row_number() OVER (PARTITION BY institucion_id ORDER BY evaluated_at DESC, id DESC) AS rn FROM evaluaciones) WHERE rn = 1")
def v23_cooldown(spark, sf_dir):
    from .listing import latest

    tier = F.col("retry_policy")
    return latest(A.evaluations(spark, sf_dir)).select("institucion_id", R.cooldown_hours(tier).alias("horas"), R.due(tier, F.col("evaluated_at"), EVENTS.instant).alias("toca"))

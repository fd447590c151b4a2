"""Labels from text, driven by texts in which every branch occurs; the SQL follows the rules' own wording."""

from __future__ import annotations

from pyspark.sql import functions as F

from plazamill.functions import dates as DT
from plazamill.functions import labels as LB
from plazamill.functions import lookups as L
from plazamill.functions import tables as TB
from plazamill.functions import text as T
from plazamill.operators import alerts as AL
from plazamill.sources import adapters as A

from .base import lit, picked, query, sql_any, sql_count, sql_first, sql_word
from .scalars import sql_fold, sql_normal

KEY = "o_orderkey"


def dealt(spark, sf_dir, key: str = KEY, table: str = "orders", wide: bool = False, **texts):
    """One row per row of a table with texts dealt over its key; dealt_sql says the same. wide: the keys are spread over
    all cores first."""
    rows = A.read(spark, sf_dir, table)
    return (A.spread(rows.select(key), key) if wide else rows).selectExpr(f"{key} AS id", *[f"{picked(key, v)} AS {n}" for n, v in texts.items()])


def dealt_sql(key: str = KEY, table: str = "orders", **texts) -> str:
    return f"(SELECT {key} AS id, {', '.join(f'{picked(key, v)} AS {n}' for n, v in texts.items())} FROM {table})"


TITLES = (
    "Abogado jurídico", "Médico cirujano", "Ingeniero civil", "Trabajador Social de programa", "Psicóloga clínica", "psicologo", "Contador auditor", "Economista", "Analista de sistemas", "Apoyo TI ", "Diseñador gráfico",
    "Profesor de historia", "Periodista", "Administrativo de oficina", "Agrónomo", "Geólogo", "Inspector municipal", "Director de obras", "Secretaria", "TENS urgencia", "Chofer", "Jefe de gabinete", "Guardia", "", None, "Matrón", "Digitador", "Conductor",
)


@query(f"SELECT id, {sql_first('lower(cargo)', LB.AREAS, 'Administración')} AS area FROM {dealt_sql(cargo=TITLES)}", cte=False)
def l03_area(spark, sf_dir):
    return dealt(spark, sf_dir, cargo=TITLES).select("id", LB.area(F.col("cargo")).alias("area"))


@query(f"SELECT id, {sql_first('lower(cargo)', LB.LEVELS, 'Profesional')} AS nivel FROM {dealt_sql(cargo=TITLES)}", cte=False)
def l04_level(spark, sf_dir):
    return dealt(spark, sf_dir, cargo=TITLES).select("id", LB.level(F.col("cargo")).alias("nivel"))


TERMS = (
    "Honorario a suma alzada, media jornada, teletrabajo", "CONTRATA con Jornada Completa, modalidad híbrida", "Planta; jornada parcial; presencial", "Código del Trabajo, remota", "codigo del trabajo a plazo fijo",
    "Plazo fijo de 6 meses", "Reemplazo por 44 horas", "Sin datos", None, "hibrido o presencial, contrata y planta",
)


def _pattern_case(x, table):
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '(?i){p}') THEN '{v}'" for p, v in table) + " END"


@query(f"SELECT id, {_pattern_case('t', LB.CONTRACTS)} AS contrato, {_pattern_case('t', LB.WORKDAYS)} AS jornada, {_pattern_case('t', LB.MODALITIES)} AS modalidad FROM (SELECT id, coalesce(texto, '') AS t FROM {dealt_sql(texto=TERMS)})", cte=False)
def l07_contract_terms(spark, sf_dir):
    c = LB.contract_terms(F.col("texto"))
    return dealt(spark, sf_dir, texto=TERMS).select("id", c["contract"].alias("contrato"), c["workday"].alias("jornada"), c["modality"].alias("modalidad"))


PLACES = ("Oficina en Las Condes, Santiago", "Punta Arenas, Magallanes", "TEMUCO, Araucanía", "Biobío y Concepción", "Los Ríos - Valdivia", "Isla de Pascua", "", None, "Viña del Mar, Valparaíso", "Talca", "Ñuñoa", "Iquique, Tarapaca")


def _region_case(x):
    return "CASE " + " ".join(f"WHEN contains({x}, {lit(k)}) THEN {lit(v)}" for k, v in L.by_length(L.REGIONS)) + " END"


@query(f"""SELECT id, CASE WHEN t <> '' THEN CASE WHEN {sql_any('t', LB.CAPITAL)} THEN 'Metropolitana de Santiago' ELSE {_region_case(sql_normal(sql_word('t', LB.REGION_CUES)))} END END AS region,
 array_to_string(list_transform(string_split({sql_word('t', LB.TOWNS)}, ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS ciudad, trim(split_part(lugar, ',', 1)) AS primera, CASE WHEN contains(lugar, ',') THEN trim(list_last(string_split(lugar, ','))) ELSE trim(lugar) END AS resto,
 nullif(trim(regexp_extract(info, '(?i)regi[oó]n\\s+(?:de\\s+|del\\s+)?([a-záéíóúñ\\s]+?)(?:\\s*[,|•]|$)', 1)), '') AS buk FROM (SELECT id, lugar, lower(lugar) AS t, lugar || ' | Región de ' || lugar || ' | jornada' AS info FROM {dealt_sql(lugar=PLACES)})""", cte=False)
def l08_places(spark, sf_dir):
    p = LB.place_cues(F.col("lugar"), lambda cue: L.longest_key(cue, L.REGIONS))
    rows = dealt(spark, sf_dir, lugar=PLACES).withColumn("info", F.concat("lugar", F.lit(" | Región de "), "lugar", F.lit(" | jornada")))
    parts = F.split("lugar", ",")
    buk = F.regexp_extract("info", "(?iu)regi[oó]n\\s+(?:de\\s+|del\\s+)?([a-záéíóúñ\\s]+?)(?:\\s*[,|•]|$)", 1)
    return rows.select("id", p["region"].alias("region"), p["town"].alias("ciudad"), F.trim(F.get(parts, 0)).alias("primera"), F.trim(F.element_at(parts, -1)).alias("resto"), F.nullif(F.trim(buk), F.lit("")).alias("buk"))


HEADINGS = ("Inicio|Concurso público 2024", "Aviso", "Inicio|Noticias del servicio", "", "Cargo: Analista contable. Grado 12")
PAGE_TITLES = ("Portal", "Nombre del cargo: Jefe de finanzas\nOtros", "Se requiere: enfermera. Postule", None)


@query(f"""SELECT id, coalesce(nullif(trim(regexp_extract(j, '(?i)nombre del cargo[:\\s]+([^\\n.]+)', 1)), ''), nullif(trim(regexp_extract(j, '(?i)cargo[:\\s]+([^\\n.]+)', 1)), ''), nullif(trim(regexp_extract(j, '(?i)se requiere[:\\s]+([^\\n.]+)', 1)), ''), trim(list_filter(h, lambda x: len(regexp_split_to_array(trim(x), '\\s+')) >= 2)[1]), titulo) AS cargo
 FROM (SELECT id, titulo, string_split(encabezados, '|') AS h, coalesce(titulo, '') || chr(10) || replace(encabezados, '|', ' ') || chr(10) AS j FROM {dealt_sql(titulo=PAGE_TITLES, encabezados=HEADINGS)})""", cte=False)
def l09_job_title(spark, sf_dir):
    rows = dealt(spark, sf_dir, titulo=PAGE_TITLES, encabezados=HEADINGS)
    return rows.select("id", LB.job_title(F.col("titulo"), F.split("encabezados", "\\|"), F.lit("")).alias("cargo"))


FILES = ("https://a.cl/docs/Bases_concurso.pdf", "https://a.cl/bases/otro.pdf", "https://a.cl/Perfil.PDF", "https://a.cl/TDR.docx", "https://a.cl/terminos de referencia.pdf", "https://a.cl/anexo-1.pdf?x=1", "convocatoria.pdf", "", None)


@query(f"SELECT id, f LIKE '%.pdf' AND regexp_matches(f, '{LB.ATTACHMENTS}') AS pertinente FROM (SELECT id, lower(list_last(string_split(url, '/'))) AS f FROM {dealt_sql(url=FILES)})", cte=False)
def l12_attachments(spark, sf_dir):
    return dealt(spark, sf_dir, url=FILES).select("id", LB.attachment_matters(F.col("url")).alias("pertinente"))


TOWN_NAMES = ("Municipalidad de La Florida", "Municipalidad de Alto  Hospicio", "Ñuñoa", "Municipalidad de Los Ángeles", "Municipalidad de El Quisco", "MUNICIPALIDAD DE CAÑETE")
TOWN_SITES = ("https://www.laflorida.cl", "https://munialto.cl", "http://www.nunoa.cl", "https://losangeles.cl", "https://www.elquisco.cl")
_SLUG = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(nombre), 'municipalidad\\s+de\\s+', '', 'g'), '^la\\s+', ''), '^el\\s+', ''), '^los\\s+', ''), '^las\\s+', '')"


@query(f"""SELECT id, array_to_string(list_sort(list_filter(list_distinct(['https://' || bare, 'http://' || bare] || flatten(list_transform(list_filter([s1, s2], lambda s: s <> ''), lambda s: flatten(list_transform(['www.', ''], lambda p: ['https://' || p || s || '.cl', 'https://' || p || s || '.gob.cl', 'https://' || p || 'municipalidad' || s || '.cl', 'https://' || p || 'municipalidadde' || s || '.cl', 'https://' || p || 'muni' || s || '.cl', 'https://' || p || 'i' || s || '.cl', 'http://' || p || s || '.cl']))))), lambda u: u <> url AND u <> replace(url, 'https://', 'http://'))), ' ') AS sitios
 FROM (SELECT id, url, regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/]+)', 1), '^www\\.', '') AS bare, regexp_replace(t, '[^a-z0-9]', '', 'g') AS s1, regexp_replace(regexp_replace(t, '[^a-z0-9]', '-', 'g'), '^-+|-+$', '', 'g') AS s2 FROM (SELECT id, url, translate({_SLUG}, 'áéíóúñü', 'aeiounu') AS t FROM {dealt_sql('c_custkey', 'customer', nombre=TOWN_NAMES, url=TOWN_SITES)}))""", cte=False)
def s19_domain_variations(spark, sf_dir):
    rows = dealt(spark, sf_dir, "c_custkey", "customer", nombre=TOWN_NAMES, url=TOWN_SITES)
    return rows.select("id", F.array_join(LB.domain_variations(F.col("url"), F.col("nombre")), " ").alias("sitios"))


LINK_TEXTS = ("Concurso Público 2024", "Trabaja con nosotros", "Empleos y concursos", "Noticias", " OMIL ", "Ofertas de empleo y bolsa de trabajo", "a" * 101, "Inicio")
LINK_HREFS = ("/concursos-publicos/", "/2024/05/convocatoria", "/noticias/empleo/", "/rrhh/bases.pdf", "/carrera", "/2023/1/12/vacantes.PDF", "/", "https://x.cl/omil/", "/noticia/trabaja")


def _list(words):
    return "[" + ", ".join(lit(w) for w in words) + "]"


def _hits(words, x, mark):
    return f"list_transform(list_filter({_list(words)}, lambda w: contains({x}, w)), lambda w: '{mark}' || w)"


@query(f"""SELECT id, 5 * len(a) + 4 * len(b) + CASE WHEN 5 * len(a) + 4 * len(b) < 4 THEN 3 * len(c) + 2 * len(d) ELSE 0 END - 10 * fecha::INT - 5 * noticia::INT - 3 * pdf::INT - 3 * largo::INT AS puntaje,
 array_to_string(a || b || CASE WHEN 5 * len(a) + 4 * len(b) < 4 THEN c || d ELSE [] END || list_filter([CASE WHEN fecha THEN '-fecha' END, CASE WHEN noticia THEN '-noticia' END, CASE WHEN pdf THEN '-pdf' END, CASE WHEN largo THEN '-texto_largo' END], lambda x: x IS NOT NULL), ',') AS traza
 FROM (SELECT id, {_hits(TB.LINK_STRONG_TEXT, 't', 'T+')} AS a, {_hits(TB.LINK_STRONG_HREF, 'h', 'H+')} AS b, {_hits(TB.LINK_WEAK_TEXT, 't', 't+')} AS c, {_hits(TB.LINK_WEAK_HREF, 'h', 'h+')} AS d, regexp_matches(h, '/20[0-9][0-9]/[0-9]{{1,2}}(?:/[0-9]{{1,2}})?/') AS fecha, regexp_matches(h, '/noticias?/') AS noticia, h LIKE '%.pdf' AS pdf, largo
 FROM (SELECT id, trim(lower(texto)) AS t, trim(lower(url)) AS h, length(texto) > 100 AS largo FROM {dealt_sql(texto=LINK_TEXTS, url=LINK_HREFS)}))""", cte=False)
def s20_link_score(spark, sf_dir):
    s = LB.link_score(F.col("texto"), F.col("url"))
    return dealt(spark, sf_dir, texto=LINK_TEXTS, url=LINK_HREFS).select("id", s["score"].alias("puntaje"), F.array_join(s["trace"], ",").alias("traza"))


PLATFORM_NAMES = ("WordPress", "Sitio propio Joomla", "SPA JavaScript", "Vue.js SPA", "HiringRoom", "Buk (RRHH)", "Drupal", "empleospublicos.cl", "PHP propio", None)
_OWN = ", ".join(lit(p) for p in LB.PLATFORMS)


@query(f"SELECT id, CASE WHEN p IN ({_OWN}) THEN p ELSE 'Sitio propio' END AS plataforma, CASE WHEN p IN ('WordPress', 'Sitio propio Joomla') THEN 'Media' WHEN p IN ('empleospublicos.cl', 'HiringRoom', 'Buk (RRHH)', 'Trabajando.cl/OMIL') THEN 'Baja' WHEN p IN ('SPA JavaScript', 'Vue.js SPA') THEN 'Alta' ELSE 'Media' END AS dificultad, CASE WHEN p IN ('SPA JavaScript', 'Vue.js SPA') THEN 'Sí' ELSE 'No' END AS requiere_js FROM {dealt_sql('c_custkey', 'customer', p=PLATFORM_NAMES)}", cte=False)
def s21_platform_difficulty(spark, sf_dir):
    p = LB.platform(F.col("p"))
    return dealt(spark, sf_dir, "c_custkey", "customer", p=PLATFORM_NAMES).select("id", p["platform"].alias("plataforma"), p["difficulty"].alias("dificultad"), p["needs_js"].alias("requiere_js"))


MAILS = (" Ana.Soto@Gmail.com ", "ana@gmial.com", "x@gmail.cl", "sin-arroba", "a@b", "uno@yopmail.com", "dos@hotnail.cl", "tres@@x.cl", "a" * 65 + "@correo.cl", "pepe+1@servicio.gob.cl", "", None, "q@outlook.co", "ñ@correo.cl", "z@live.co")


@query(f"""SELECT id, m IS NULL AS valido, e AS email, CASE WHEN m IS NULL THEN CASE WHEN d = 'gmail.cl' THEN l || '@gmail.com' ELSE l || '@' || (CASE {" ".join(f"WHEN d IN ({', '.join(lit(x) for x in v)}) THEN '{k}'" for k, v in TB.MISSPELT.items() if v)} END) END END AS sugerencia, coalesce(m LIKE 'Dominio%', FALSE) AS desechable, m AS motivo
 FROM (SELECT *, CASE WHEN NOT coalesce(regexp_full_match(e, '[a-z0-9._%+\\-]+@[a-z0-9.\\-]+\\.[a-z]{{2,}}'), FALSE) THEN 'Formato de email inválido' WHEN length(l) > 64 THEN 'Parte local del email demasiado corta o larga' WHEN d IN ({', '.join(lit(x) for x in TB.DISPOSABLE)}) THEN 'Dominio de email temporal o desechable. Usa un email permanente.' END AS m
 FROM (SELECT id, lower(trim(correo)) AS e, split_part(lower(trim(correo)), '@', 1) AS l, split_part(lower(trim(correo)), '@', 2) AS d FROM {dealt_sql('c_custkey', 'customer', correo=MAILS)}))""", cte=False)
def s28_email(spark, sf_dir):
    c = LB.mail_check(F.col("correo"))
    rows = dealt(spark, sf_dir, "c_custkey", "customer", correo=MAILS)
    return rows.select("id", c["valid"].alias("valido"), c["address"].alias("email"), c["suggestion"].alias("sugerencia"), c["disposable"].alias("desechable"), c["reason"].alias("motivo"))


REGIONS = (" rm ", "R.M.", "Biobío", "O'Higgins", "Región de Prueba", "REGIÓN  austral", "Aysén", "Otra", "", "  ", None, "la  araucania")
CONTRACTS = ("Planta", "A CONTRATA", "Honorarios (suma alzada)", "Código del Trabajo", "Suplencia", "No informa", "Otro", "¿?", "  ", None, "Sin especificar", "comisión")
_RK = "upper(" + f"trim(regexp_replace(replace(translate(r, '{T.ACCENTED}', '{T.PLAIN}'), '.', ''), '\\s+', ' ', 'g'))" + ")"
_CK = f"trim(regexp_replace(regexp_replace(lower(translate(trim(tipo), '{T.ACCENTED}', '{T.PLAIN}')), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"""SELECT id, CASE WHEN coalesce(r, '') = '' THEN '' WHEN alias IS NOT NULL THEN alias WHEN regexp_matches(r, '(?i)^regi[oó]n\\s+') THEN r ELSE 'Región de ' || r END AS region,
 CASE WHEN coalesce(k, '') = '' THEN 'sin_datos' WHEN contains(k, 'planta') THEN 'planta' WHEN contains(k, 'contrata') THEN 'contrata' WHEN contains(k, 'honorario') THEN 'honorarios' WHEN contains(k, 'codigo') AND contains(k, 'trabajo') THEN 'codigo_trabajo' WHEN {sql_any('k', ('reemplazo', 'suplencia'))} THEN 'reemplazo' WHEN {sql_any('k', ('no informa', 'no especifica', 'sin especificar'))} THEN 'no_informa' ELSE 'otro' END AS tipo
 FROM (SELECT id, r, {_CK} AS k, CASE {_RK} {" ".join(f"WHEN {lit(a)} THEN {lit(n)}" for a, n in TB.REGION_ALIASES.items())} END AS alias FROM (SELECT id, trim(region) AS r, tipo FROM {dealt_sql(region=REGIONS, tipo=CONTRACTS)}))""", cte=False)
def s31_display_names(spark, sf_dir):
    rows = dealt(spark, sf_dir, region=REGIONS, tipo=CONTRACTS)
    return rows.select("id", LB.region_name(F.col("region")).alias("region"), LB.contract_key(F.col("tipo")).alias("tipo"))


HTMLS = (
    '<meta name="generator" content="WordPress 6.4">', "<META NAME='generator' CONTENT='Joomla! 4'>", '<meta name="generator" content="Drupal 10">', '<link href="/wp-includes/x.css">', '<script src="/media/jui/a.js">', '<div id="app"></div><script src="vue.min.js">',
    '<div id="root">', "<p>hola</p>",
)
POWERED = ("PHP/8.1", None, "ASP.NET")
LINKS = ("/inicio|https://x.trabajando.cl/a|https://buk.works", "https://EMPRESA.buk.cl/jobs", "/a|/b", "https://www.hiringroomcampus.com|x", "", "https://reqlut.com")
_OUT = "CASE " + " ".join(f"WHEN regexp_matches(lower(x), '{p}') THEN '{n}'" for p, n in LB.OUTSIDE) + " END"
_GEN = """regexp_extract(h, '<meta\\s+name=["\\x27]generator["\\x27]\\s+content=["\\x27]([^"\\x27]+)', 1)"""


@query(f"""SELECT id, CASE WHEN contains(g, 'wordpress') THEN 'WordPress|meta:' || g[1:40] WHEN contains(g, 'joomla') THEN 'Sitio propio Joomla|meta:' || g[1:40] WHEN contains(g, 'drupal') THEN 'Sitio propio|Drupal meta:' || g[1:40] WHEN {sql_any('h', ('/wp-content/', '/wp-includes/'))} THEN 'WordPress|wp-content' WHEN {sql_any('h', ('/components/com_', 'media/jui/', '/templates/system/'))} THEN 'Sitio propio Joomla|paths joomla'
 WHEN {sql_any('h', ('id="app"', 'id="root"'))} AND {sql_any('h', ('vue.js', 'vue.min', 'react-dom'))} THEN 'SPA JavaScript|SPA Vue/React' WHEN contains(lower(coalesce(servidor, '')), 'php') THEN 'PHP propio|X-Powered-By:PHP' ELSE 'Sitio propio|html estatico' END AS pagina, {_OUT.replace('lower(x)', 'lower(f)')} AS externa, f AS enlace
 FROM (SELECT id, servidor, h, {_GEN} AS g, list_filter(string_split(enlaces, '|'), lambda x: {_OUT} IS NOT NULL)[1] AS f FROM (SELECT id, servidor, enlaces, lower(html) AS h FROM {dealt_sql(html=HTMLS, servidor=POWERED, enlaces=LINKS)}))""", cte=False)
def s32_platform(spark, sf_dir):
    p, o = LB.page_platform(F.col("html"), F.col("servidor")), LB.outside_platform(F.split("enlaces", "\\|"))
    return dealt(spark, sf_dir, html=HTMLS, servidor=POWERED, enlaces=LINKS).select("id", F.concat_ws("|", p["platform"], p["reason"]).alias("pagina"), o["platform"].alias("externa"), o["link"].alias("enlace"))


RANGES = (
    "Postulación 01/03/2024 - 15/03/2024", "del 1-4-2024 a 30-4-2024", "Desde 05/05/2024 y luego 09/05/2024, cierre 20/05/2024", "Sólo 07/06/2024", "31/02/2024 – 01/03/2024", "sin fechas", None, "02/02/2024a03/02/2024",
)
_DMY = "[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{4}"


def _dmy(x):
    return f"CAST(CAST(try_strptime(replace({x}, '/', '-'), '%d-%m-%Y') AS DATE) AS VARCHAR)"


@query(f"""SELECT id, {_dmy("CASE WHEN r <> '' THEN regexp_extract(t, '(" + _DMY + ")\\s*(?:-|–|—|a)\\s*(" + _DMY + ")', 1) ELSE f[1] END")} AS desde, {_dmy("CASE WHEN r <> '' THEN regexp_extract(t, '(" + _DMY + ")\\s*(?:-|–|—|a)\\s*(" + _DMY + ")', 2) ELSE list_last(f) END")} AS hasta
 FROM (SELECT id, t, regexp_extract(t, '{_DMY}\\s*(?:-|–|—|a)\\s*{_DMY}') AS r, regexp_extract_all(t, '{_DMY}') AS f FROM (SELECT id, trim(regexp_replace(texto, '\\s+', ' ', 'g')) AS t FROM {dealt_sql(texto=RANGES)}))""", cte=False)
def d09_date_range(spark, sf_dir):
    r = DT.date_range(F.col("texto"))
    return dealt(spark, sf_dir, texto=RANGES).select("id", r["start"].cast("string").alias("desde"), r["stop"].cast("string").alias("hasta"))


NOTICE_TITLES = (
    "Concurso público para proveer cargo", "Licitación pública de obras", "Gran FESTIVAL de la canción", "Inauguración de la plaza", "Llamado a concurso: beca", "Aviso", "", "   ", None, "Concurso literario juvenil", "Reemplazo de auxiliar", "Ordenanza local",
)
NOTICE_BODIES = ("Enviar currículum y antecedentes", "Nada que ver", None, "Se busca vacante con honorarios", "Ceremonia")


@query(f"""SELECT id, coalesce(d, '') <> '' AND hard IS NULL AND soft IS NULL AND good IS NOT NULL AS acepta, CASE WHEN coalesce(d, '') = '' THEN 'contenido_vacio' WHEN hard IS NOT NULL OR soft IS NOT NULL THEN 'keyword_negativa' WHEN good IS NOT NULL THEN 'ok' ELSE 'sin_keywords' END AS motivo, CASE WHEN coalesce(d, '') = '' THEN '' ELSE coalesce(hard, soft, good, '') END AS palabra
 FROM (SELECT id, trim(titulo) AS d, {sql_word('t', TB.HARD_REJECT_WORDS)} AS hard, {sql_word('t', TB.REJECT_WORDS)} AS soft, {sql_word("t || ' ' || c", TB.JOB_WORDS)} AS good FROM (SELECT id, titulo, {sql_normal('titulo')} AS t, {sql_normal('cuerpo')} AS c FROM {dealt_sql(titulo=NOTICE_TITLES, cuerpo=NOTICE_BODIES)}))""", cte=False)
def v01_job_gate(spark, sf_dir):
    g = LB.job_gate(F.col("titulo"), F.col("cuerpo"))
    return dealt(spark, sf_dir, titulo=NOTICE_TITLES, cuerpo=NOTICE_BODIES).select("id", g["accept"].alias("acepta"), g["reason"].alias("motivo"), g["word"].alias("palabra"))


POST_TITLES = ("Resultado del concurso público", "Enfermera para CESFAM", "Aviso", "Acta de reunión", "x", "Noticia general", "Jefa de obras", None)
POST_BODIES = ("El cargo es a contrata", "postulación", "", None, "selección para el cargo de planta")


@query(f"""SELECT id, CASE WHEN length(trim(regexp_replace(coalesce(titulo, '') || ' ' || coalesce(cuerpo, ''), '\\s+', ' ', 'g'))) < 8 OR {sql_any('t', TB.WP_TITLE_REJECT)} THEN FALSE WHEN {sql_any('t', TB.WP_TITLE_JOB)} THEN TRUE ELSE {sql_count('c', ('concurso', 'cargo', 'postulacion', 'seleccion', 'contrata', 'planta'))} >= 2 END AS acepta
 FROM (SELECT id, titulo, cuerpo, {sql_normal('titulo')} AS t, {sql_normal('cuerpo')} AS c FROM {dealt_sql(titulo=POST_TITLES, cuerpo=POST_BODIES)})""", cte=False)
def v26_blog_gate(spark, sf_dir):
    return dealt(spark, sf_dir, titulo=POST_TITLES, cuerpo=POST_BODIES).select("id", LB.blog_gate(F.col("titulo"), F.col("cuerpo")).alias("acepta"))


BODIES = ("<p>Bienvenidos</p>", "Checking Cloudflare", "", None, "Please enable JavaScript", "window.__data " + "x" * 600, "acceso normal", "WAF bloqueó")
ERRORS = ("timeout", "dns_error", "ssl_error", "redirect_loop", "otro") + (None,) * 12
_S = "CASE event_id % 7 WHEN 0 THEN 404 WHEN 1 THEN 403 WHEN 2 THEN 500 WHEN 3 THEN NULL WHEN 4 THEN 301 ELSE 200 END"
_C = "CASE event_id % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN NULL ELSE 'text/html' END"


@query(f"""SELECT id, CASE WHEN error IN ('timeout', 'dns_error', 'ssl_error', 'redirect_loop') THEN error WHEN s = 404 THEN 'http_404' WHEN s = 403 THEN CASE WHEN {sql_any('b', TB.BOT_MARKERS)} THEN 'blocked_by_bot_protection' ELSE 'http_403' END WHEN s >= 500 THEN 'http_500' WHEN b = '' AND NOT contains(coalesce(tipo, ''), 'pdf') THEN 'empty_response' WHEN {sql_any('b', TB.BOT_MARKERS)} THEN 'blocked_by_bot_protection' WHEN {sql_any('b', TB.JS_MARKERS)} AND length(b) < 500 THEN 'js_required' ELSE 'ok' END AS disponibilidad
 FROM (SELECT d.id, error, trim(regexp_replace({sql_fold('cuerpo')}, '\\s+', ' ', 'g')) AS b, {_S} AS s, {_C} AS tipo FROM {dealt_sql('event_id', 'events', cuerpo=BODIES, error=ERRORS)} d JOIN events e ON e.event_id = d.id)""", cte=False)
def v15_availability(spark, sf_dir):
    rows = A.read(spark, sf_dir, "events").selectExpr("event_id AS id", f"{picked('event_id', BODIES)} AS cuerpo", f"{picked('event_id', ERRORS)} AS error", f"{_S} AS s", f"{_C} AS tipo")
    return rows.select("id", LB.availability(F.col("error"), F.col("s"), F.col("cuerpo"), F.col("tipo")).alias("disponibilidad"))


MOTIVES = ("keyword_negativa", "sin_keywords", "vencida", "duplicada", "fecha_invalida", "contenido_vacio", "salary_outlier", "invalid_institution_reference", "catalog_mismatch", "news_page")


@query(f"SELECT id, CASE WHEN m IN ('keyword_negativa', 'sin_keywords', 'vencida', 'duplicada', 'fecha_invalida', 'contenido_vacio') THEN m WHEN contains(m, 'salary') OR contains(m, 'institution') OR contains(m, 'catalog') THEN 'fecha_invalida' ELSE 'keyword_negativa' END AS motivo FROM {dealt_sql('event_id', 'events', m=MOTIVES)}", cte=False)
def v29_legacy_motive(spark, sf_dir):
    return dealt(spark, sf_dir, "event_id", "events", m=MOTIVES).select("id", LB.old_motive(F.col("m")).alias("motivo"))


COUNTERS = {"vencidas": "c_custkey % 3", "rotas": "c_custkey % 120", "revision": "c_custkey % 2", "horas": "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(c_custkey % 60 AS DOUBLE) END", "errores": "c_custkey % 25"}
_AL = "list_filter([CASE WHEN vencidas > 0 THEN 'warning:bulk-desactivar' END, CASE WHEN rotas > 50 THEN 'warning:revalidar-urls' END, CASE WHEN revision > 0 THEN 'info:revision' END, CASE WHEN horas > 26 THEN 'error:scraper-runs' END, CASE WHEN errores > 10 THEN 'warning:evaluaciones' END], lambda x: x IS NOT NULL)"
_LEVEL = "CASE WHEN horas > 26 THEN 'error' WHEN vencidas > 0 OR rotas > 50 OR errores > 10 THEN 'warning' ELSE 'ok' END"


@query(f"SELECT id, {_LEVEL} AS nivel, array_to_string({_AL}, ',') AS alertas FROM (SELECT c_custkey AS id, {', '.join(f'{e} AS {n}' for n, e in COUNTERS.items())} FROM customer)", cte=False)
def v27_alert_level(spark, sf_dir):
    rows = A.read(spark, sf_dir, "customer").selectExpr("c_custkey AS id", *[f"{e} AS {n}" for n, e in COUNTERS.items()])
    a = AL.alerts(*[F.col(n) for n in COUNTERS])
    return rows.select("id", a["level"].alias("nivel"), F.array_join(a["alerts"], ",").alias("alertas"))


LAW_NAMES = (
    "Servicio Civil", "Corporación INDAP regional", "Ilustre Municipalidad de Talca", "Hospital clínico", "Banco Central de Chile", "Instituto Nacional de Estadísticas", "Servicio de Salud Maule", "Dirección de Presupuestos", "Registro Civil e Identificación", "Policía de Investigaciones de Chile",
)
LAW_SHORT = (None, "ine", "SAG", "XX", "fonasa", None)
LAW_SECTORS = ("Municipal", "Salud", None, "Ejecutivo Central", "Poder Judicial", "Autónomo", "Otro")
LAW_KINDS = ("Honorarios", None, "Contrata")


@query(f"""SELECT id, split_part(l, '|', 1) AS ley, split_part(l, '|', 2) AS titulo, split_part(l, '|', 3) AS norma, split_part(l, '|', 4) AS fuente FROM (SELECT id, CASE {" ".join(f"WHEN contains(lower(nombre), {lit(k.lower())}) OR lower(sigla) = {lit(k.lower())} THEN {lit('|'.join([*v, 'bcn_directo']))}" for k, *v in TB.LAWS)}
 WHEN contains(lower(coalesce(sector, '')), 'municipal') OR contains(lower(nombre), 'municipalidad') THEN 'Ley 18.883|Estatuto Administrativo para Funcionarios Municipales|30132|estatuto_sector' WHEN contains(lower(coalesce(tipo, '')), 'honorario') THEN 'DFL 1 (Trabajo, 2002)|Código del Trabajo|207436|estatuto_sector' ELSE 'Ley 18.834|Estatuto Administrativo|30099|estatuto_sector' END AS l
 FROM {dealt_sql('c_custkey', 'customer', nombre=LAW_NAMES, sigla=LAW_SHORT, sector=LAW_SECTORS, tipo=LAW_KINDS)})""", cte=False)
def j13_law_lookup(spark, sf_dir):
    rows = dealt(spark, sf_dir, "c_custkey", "customer", nombre=LAW_NAMES, sigla=LAW_SHORT, sector=LAW_SECTORS, tipo=LAW_KINDS)
    w = LB.law(F.col("nombre"), F.col("sigla"), F.col("sector"), F.col("tipo"))
    return rows.select("id", w["law"].alias("ley"), w["title"].alias("titulo"), w["norm"].alias("norma"), w["source"].alias("fuente"))

"""Titles and bodies for display, and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from plazamill.context import OFFERS
from plazamill.functions import titles as TT
from plazamill.operators import search as SR
from plazamill.sources import adapters as A

from .base import lit, picked, query
from .labels import TITLES, dealt, dealt_sql
from .scalars import sql_normal

SHOUTED = (
    "006AP-26 TECNICO EN ENFERMERIA NIVEL SUPERIOR", "2 CARGOS ADMINISTRATIVO DE RRHH", "Cargo: Abogado slep los libertadores", "ANALISTA DE GESTION , PROYECTOS;INVERSION", "12 médicos", "profesional e.u.s. grado 9", "COD-123/24 Director de Obras", "", None, "PSICOLOGO/A CLINICA (CESFAM)", "Jefe de Área",
)


@query()
def s22_tidy_title(spark, sf_dir):
    """Casing word by word has no SQL here; tests hold fixed titles."""
    return dealt(spark, sf_dir, titulo=SHOUTED).select("id", TT.tidy_title(F.col("titulo")).alias("titulo"))


TWICE = ("Ingeniero Senior Depto X Ingeniero Senior", "Analista Contable Analista Contable", "Uno dos tres", "Jefe de Obras", "", None, "a b c a b c", "Médico Cirujano Urgencia Turno", "x y x y z w")


@query(f"""SELECT id, CASE WHEN n >= 4 THEN coalesce(list_filter(list_transform(generate_series(2, n // 2), lambda k: CASE WHEN starts_with(array_to_string(w[k + 1 :], ' '), array_to_string(w[1:k], ' ')) OR suffix(array_to_string(w[k + 1 :], ' '), array_to_string(w[1:k], ' ')) THEN array_to_string(w[1:k], ' ') END), lambda x: x IS NOT NULL)[1], titulo) ELSE titulo END AS titulo
 FROM (SELECT *, len(w) AS n FROM (SELECT id, titulo, list_filter(regexp_split_to_array(titulo, '\\s+'), lambda x: x <> '') AS w FROM {dealt_sql(titulo=TWICE)}))""", cte=False)
def s23_title_once(spark, sf_dir):
    return dealt(spark, sf_dir, titulo=TWICE).select("id", TT.once(F.col("titulo")).alias("titulo"))


POSTS = (
    "Se busca profesional para el área de finanzas municipales, con dedicación completa y turnos rotativos. Requisitos: título y experiencia. 25 personas han compartido su experiencia postulando aquí", "Requisitos principales al inicio y nada más que decir", "Texto sin marcas", "", None,
    "El servicio llama a presentar antecedentes para integrar su equipo de trabajo en terreno, región del Maule. Para postular, debes enviar CV. Ver experiencias completas", "x" * 79 + " perfil requerido: y", "x" * 81 + " perfil requerido: y",
)
_CUT = f"CASE WHEN regexp_matches(texto, '(?i){TT.BOILERPLATE}') THEN trim(regexp_split_to_array(texto, '(?i){TT.BOILERPLATE}')[1]) ELSE texto END"
_AT = f"CASE WHEN regexp_matches(t, '(?i){TT.REQUIREMENTS}') THEN length(regexp_split_to_array(t, '(?i){TT.REQUIREMENTS}')[1]) END"


@query(f"SELECT id, CASE WHEN a >= 80 THEN nullif(trim(substring(t, 1, a)), '') ELSE nullif(t, '') END AS descripcion, CASE WHEN a >= 80 THEN nullif(trim(substring(t, a + 1)), '') END AS requisitos FROM (SELECT id, t, {_AT} AS a FROM (SELECT id, {_CUT} AS t FROM {dealt_sql(texto=POSTS)}))", cte=False)
def s25_description_requirements(spark, sf_dir):
    s = TT.split_requirements(TT.before_boilerplate(F.col("texto")))
    return dealt(spark, sf_dir, texto=POSTS).select("id", s["description"].alias("descripcion"), s["requirements"].alias("requisitos"))


_ESC = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;')"


@query(f"""SELECT doc_id, md5(coalesce(array_to_string(list_transform(r.p || CASE WHEN r.b <> '' THEN [trim(r.b)] ELSE [] END, lambda p: '<p>' || {_ESC.format('p')} || '</p>'), ''), '')) AS digest FROM (SELECT doc_id, list_reduce(list_transform([''] || s, lambda x: {{'p': []::VARCHAR[], 'b': x}}), lambda a, x: CASE WHEN a.b <> '' AND length(a.b) + length(x.b) > 400 THEN {{'p': a.p || [trim(a.b)], 'b': x.b}} ELSE {{'p': a.p, 'b': CASE WHEN a.b = '' THEN x.b ELSE trim(a.b || ' ' || x.b) END}} END) AS r
 FROM (SELECT doc_id, list_filter(string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM (SELECT doc_id, CASE WHEN length(t) > 2000 THEN regexp_replace(substring(t, 1, 1999), '[ ,.\\-]+$', '') || '…' ELSE t END AS t FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[\\s ]+', ' ', 'g')) AS t FROM documents))))""", cte=False)
def s26_paragraphs(spark, sf_dir):
    return A.read(spark, sf_dir, "documents").select("doc_id", F.md5(TT.paragraphs(F.col("text"))).alias("digest"))


@query()
def s33_short_title(spark, sf_dir):
    """Abbreviations and initials are judged by places in the text; tests hold fixed titles."""
    return A.read(spark, sf_dir, "documents").select("doc_id", TT.short_title(F.col("text")).alias("titulo"))


@query()
def d08_post_closing_date(spark, sf_dir):
    from .scalars import notices

    return notices(spark, sf_dir).select("id", TT.post_closing_date(F.col("texto"), OFFERS.day).cast("string").alias("fecha"))


# --- search

_ENDS = "|".join(SR.ENDINGS)
_STEM = f"CASE WHEN regexp_matches(w, '^(.{{3,}}?)(?:{_ENDS})$') THEN regexp_extract(w, '^(.{{3,}}?)(?:{_ENDS})$', 1) ELSE w END"


def _sql_stems(x: str) -> str:
    return f"list_distinct(list_transform(list_filter(string_split(regexp_replace({sql_normal(x)}, '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '' AND w NOT IN ({', '.join(map(lit, SR.STOP))})), lambda w: {_STEM}))"


SAID = "Administraciones de los servicios públicos"
NOTES = ("Administración del servicio público", "Servicio de administración", "administrador de Servicios Públicas", "Los públicos", "", None, "Publico administrativo: servicios")


@query(f"SELECT id, list_has_all({_sql_stems('texto')}, {_sql_stems(lit(SAID))}) AS coincide FROM {dealt_sql(texto=NOTES)}", cte=False)
def t20_full_text(spark, sf_dir):
    return dealt(spark, sf_dir, texto=NOTES).select("id", SR.full_text(F.col("texto"), SAID).alias("coincide"))


@query(f"SELECT doc_id, list_has_all({_sql_stems('text')}, {_sql_stems(lit('the workers'))}) AS coincide FROM documents", cte=False)
def t20_documents(spark, sf_dir):
    return A.read(spark, sf_dir, "documents").select("doc_id", SR.full_text(F.col("text"), "the workers").alias("coincide"))


_POST = {"cargo": TITLES, "institucion": ("Municipalidad de Ñuñoa", "Servicio de Salud", "Abogados asociados", "Dirección Legal"), "descripcion": ("Se busca abogado", "Atención de público", "Asesoría juridica", None, "Enfermero o TENS"), "region": ("Maule", "Ñuble", "Biobío")}


def _posts(spark, sf_dir):
    return A.read(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", *[f"{picked('o_orderkey', v)} AS {n}" for n, v in _POST.items()])


_W = lambda f: f"list_filter(string_split(regexp_replace({sql_normal(f)}, '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"
_TERMS = "(VALUES (0, 0, 'abogdo', 6, TRUE, 1)) q(way, pos, term, n, abierta, total)"
_SEARCH = f"""WITH r AS (SELECT * FROM (SELECT o_orderkey AS id, {', '.join(f"{picked('o_orderkey', v)} AS {n}" for n, v in _POST.items())} FROM orders) WHERE region = 'Maule'), p AS (SELECT DISTINCT id, unnest({_W('cargo')}) AS word, 0 AS field FROM r UNION SELECT DISTINCT id, unnest({_W('institucion')}), 1 FROM r UNION SELECT DISTINCT id, unnest({_W('descripcion')}), 2 FROM r),
 h AS (SELECT id, way, pos, total, min((CASE WHEN abierta AND starts_with(word, term) THEN 0 ELSE levenshtein(word, term) END, field)) AS b FROM p JOIN {_TERMS} ON (levenshtein(word, term) <= CASE WHEN n >= 8 THEN 2 WHEN n >= 4 THEN 1 ELSE 0 END OR (abierta AND starts_with(word, term))) GROUP BY ALL),
 g AS (SELECT id, way, sum(b[1]) AS errors, sum(b[2]) AS weight FROM h GROUP BY id, way, total HAVING count(*) = total), t AS (SELECT id, min((errors, weight)) AS b FROM g GROUP BY id)"""


@query(f"{_SEARCH} SELECT id, b[1]::INT AS errors, row_number() OVER (ORDER BY b[1], b[2], id)::INT AS rank FROM t QUALIFY rank <= 15", cte=False)
def t21_search_typo(spark, sf_dir):
    return SR.search(_posts(spark, sf_dir), "abogdo", ("cargo", "institucion", "descripcion"), limit=15, filters={"region": "Maule"}).select("id", F.col("errors").cast("int").alias("errors"), F.col("rank").cast("int").alias("rank"))


@query()
def t21_search_synonyms(spark, sf_dir):
    """Synonyms, marks and offset; tests hold the ranking against brute force."""
    return SR.search(_posts(spark, sf_dir), "Abogado", ("cargo", "institucion", "descripcion"), limit=20)


@query()
def t22_autocomplete(spark, sf_dir):
    """Each title once in any case, in the order of the search."""
    rows = _posts(spark, sf_dir).withColumn("cargo", F.when(F.col("id") % 2 == 0, F.upper("cargo")).otherwise(F.col("cargo")))
    return SR.autocomplete(rows, "adm", 8)

"""Site parsers over fetched payloads; the pages table stands for what was fetched."""

from __future__ import annotations

from pyspark.sql import functions as F

from plazamill.functions import labels as LB
from plazamill.functions import lookups as L
from plazamill.sources import adapters as A
from plazamill.sources import listings as LS
from plazamill.sources import sites as S

from .base import query
from .labels import dealt, dealt_sql

_P = lambda t, c, u: '{"title":{"rendered":"%s"},"content":{"rendered":"%s"},"date":"1998-05-01","link":"%s"}' % (t, c, u)  # noqa: E731, UP031
PAYLOADS = (
    "[" + _P("Concurso público", "texto", "https://m.cl/1") + "," + _P("Taller abierto", "x", "https://m.cl/2") + "]", "[" + _P("Chofer municipal", "cuerpo", "https://m.cl/3") + "," + _P("Chofer municipal", "otra vez", "https://m.cl/3") + "]", "[]",
    "[" + _P("Aviso", "el cargo es a contrata", "https://m.cl/4") + "]", "[" + _P("Resultado final", "cargo y planta", "https://m.cl/5") + "]",
)
_DAYS = "CASE s_suppkey % 3 WHEN 0 THEN 180 WHEN 1 THEN NULL ELSE 365 END"
_T = '[{"title":{"rendered":"VARCHAR"},"content":{"rendered":"VARCHAR"},"date":"VARCHAR","link":"VARCHAR"}]'


@query(f"""WITH r AS (SELECT fuente, turno, unnest(from_json(payload, '{_T}')) AS p FROM (SELECT s_suppkey // 4 AS fuente, CASE WHEN s_suppkey % 3 = 0 THEN 0 WHEN s_suppkey % 3 = 1 THEN 1 ELSE 2 END AS turno, s_suppkey // 4 % 1 + 1 AS page, d.payload FROM supplier JOIN {dealt_sql('s_suppkey', 'supplier', payload=PAYLOADS)} d ON d.id = s_suppkey)),
 g AS (SELECT fuente, turno, p.title.rendered AS titulo, p.content.rendered AS cuerpo, p.link AS url FROM r), f AS (SELECT * FROM g WHERE CASE WHEN titulo LIKE 'Concurso%' OR titulo LIKE 'Chofer%' THEN TRUE WHEN titulo LIKE 'Aviso%' THEN TRUE ELSE FALSE END), b AS (SELECT fuente, min(turno) AS turno FROM f GROUP BY 1)
 SELECT DISTINCT fuente, url, titulo FROM f JOIN b USING (fuente, turno)""", cte=False)
def x14_wordpress_posts(spark, sf_dir):
    """Windows, gate and first-seen address per source; the gate itself is checked by v26_blog_gate."""
    pages = A.read(spark, sf_dir, "supplier").join(dealt(spark, sf_dir, "s_suppkey", "supplier", payload=PAYLOADS), F.col("s_suppkey") == F.col("id")).selectExpr("s_suppkey div 4 AS source_id", f"{_DAYS} AS days", "1 AS page", "payload", "'https://m.cl' AS site")
    return S.wordpress_posts(pages).select(F.col("source_id").alias("fuente"), "url", F.col("title").alias("titulo"))


MARKUP = (
    '<div class="jobs__card"><h3 class="job__card-name">Ingeniero Senior Depto Ingeniero Senior</h3><a href="/jobs/1">ver</a><p class="jobs__card-info">Talca, Región del Maule</p></div><div class="jobs__card"><h3>Sin enlace</h3></div>',
    '<li class="job"><h2>Guardia nocturno</h2><a href="g/7">v</a></li><a href="/d/Bases_concurso-2026.pdf"></a><a href="/d/politica.pdf">Política</a>', "<p>Portada</p><p>LLAMA A CONCURSO para el cargo de juez titular</p><p>Corte de Apelaciones de Talca, región de Maule.</p><p>Plazo 30/06/2026</p>", "<p>nada</p>", None,
)


def _fetched(spark, sf_dir):
    """Fetched pages in which every shape occurs, one a supplier."""
    rows = dealt(spark, sf_dir, "s_suppkey", "supplier", html=MARKUP)
    return rows.select(F.col("id").alias("source_id"), F.concat(F.lit("https://s"), F.col("id"), F.lit(".cl/lista/")).alias("url"), "html")


_FETCH = f"(SELECT id AS source_id, 'https://s' || id::VARCHAR || '.cl/lista/' AS url, html FROM {dealt_sql('s_suppkey', 'supplier', html=MARKUP)})"


@query(f"SELECT source_id, 0 AS at, 'Ingeniero Senior' AS title, 'https://s' || source_id::VARCHAR || '.cl/jobs/1' AS url, 'Talca, Región del Maule' AS info FROM {_FETCH} WHERE contains(html, 'jobs__card') UNION ALL SELECT source_id, 0, trim(regexp_extract(html, '<h2>(.*?)</h2>', 1)), url || regexp_extract(html, '<a href=\"([^\"]*)\"', 1), NULL FROM {_FETCH} WHERE regexp_matches(html, '<li class=\"job\"')", cte=False)
def x18_job_cards(spark, sf_dir):
    return S.job_cards(_fetched(spark, sf_dir))


@query(f"SELECT source_id, 'https://s' || source_id::VARCHAR || '.cl' || regexp_extract(html, 'href=\"([^\"]*Bases[^\"]*)\"', 1) AS url, 'Bases concurso 2026' AS title FROM {_FETCH} WHERE contains(html, 'Bases_concurso')", cte=False)
def x19_pdf_postings(spark, sf_dir):
    return S.pdf_postings(_fetched(spark, sf_dir))


NAMES = ("https://m.cl/docs/Bases_concurso-2024.PDF", "https://m.cl/perfil--cargo.pdf", "https://m.cl/a/otro.pdf", "x.pdf", "https://m.cl/tdr", "")


@query(f"SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(list_last(string_split(url, '/')), '\\.pdf$', '', 'i'), '[-_]+', ' ', 'g'), '[\\s ]+', ' ', 'g')) AS titulo, coalesce(regexp_matches(lower(list_last(string_split(url, '/'))), '\\.pdf$') AND regexp_matches(lower(list_last(string_split(url, '/'))), '{LB.ATTACHMENTS}'), FALSE) AS pertinente FROM {dealt_sql(url=NAMES)}", cte=False)
def x19_file_titles(spark, sf_dir):
    return dealt(spark, sf_dir, url=NAMES).select("id", S.file_title(F.col("url")).alias("titulo"), LB.attachment_matters(F.col("url")).alias("pertinente"))


@query(f"SELECT source_id, list_filter(l, lambda x: regexp_matches(x, '(?i)concurso') AND length(x) >= 20)[1] AS title, array_to_string(l, ' ') AS body, '2026-06-30' AS closes FROM (SELECT source_id, list_filter(string_split(regexp_replace(html, '<[^>]*>', chr(10), 'g'), chr(10)), lambda x: trim(x) <> '') AS l FROM {_FETCH} WHERE contains(html, 'LLAMA A CONCURSO'))", cte=False)
def x22_court_calls(spark, sf_dir):
    out = S.court_calls(_fetched(spark, sf_dir), lambda c: L.longest_key(c, L.REGIONS)).where("title LIKE 'LLAMA%'")
    return out.select("source_id", "title", "body", F.col("closes").cast("string").alias("closes"))


# --- pages of the table with postings put into them, as markup of every shape; tests hold these against plain Python

PUT_IN = (
    '<article class="card"><h2><a href="/concursos/1">Concurso p&uacute;blico: abogado a contrata</a></h2><time datetime="1998-05-02">2 de mayo</time><p>Requisitos y funciones del cargo. Postulaciones hasta 30/06/1998. Renta bruta mensual $ 1.250.000, grado 12</p><a href=bases/1.pdf>Bases</a></article>',
    "<table><tr><th>Cargo<th>Cierre<tr><td><a href='/t/2'>Vacante planta administrativo</a><td>Recepci&oacute;n de antecedentes: bases y requisitos<tr><td>Sin nada<td>-</table>",
    '<ul><li>Llamado a concurso, cargo de chofer, reemplazo: <a href="https://fuera.example.com/x">ver convocatoria</a><li><a href="/perfil-medico.pdf">Perfil de cargo m&eacute;dico</a> postulaci&oacute;n a honorarios</ul>',
    '<script type="application/ld+json">{"@graph":[{"@type":"WebPage","mainEntity":[[{"@type":"JobPosting","title":"Analista de gestión","description":"<p>Vacante a contrata, requisitos y bases</p>","url":"https://m.example.net/jp/4","datePosted":"1998-05-01","validThrough":"1998-07-15"}]]}]}</script>',
    '<div class="entry-content"><h3>Concursos vigentes</h3><p>Cargo: Enfermera de CESFAM. Concurso p&uacute;blico a contrata, postulaciones hasta 05/07/1998, renta $900.000 <a href="/wp-content/e.pdf">Aqu&iacute;</a></p><h3>Cerrados</h3><p>Cargo: Auditor. Concurso p&uacute;blico de planta</p></div>',
    '<p>Noticias: ceremonia y taller</p><a href="/noticias/9">Noticias del concurso</a>', "",
)


def with_postings(spark, sf_dir):
    """The pages of the table, each with one of PUT_IN before the end of its body."""
    rows = A.spread(A.read(spark, sf_dir, "pages").select("page_id", "url", "html"), "page_id").withColumn("put", F.get(F.array(*[F.lit(x) for x in PUT_IN]), F.pmod("page_id", F.lit(len(PUT_IN))).cast("int")))
    host = F.regexp_extract("url", "^[a-z]+://(?:www\\.)?([^/?#]+)", 1)
    html = F.when(F.contains("html", F.lit("</body>")), F.replace("html", F.lit("</body>"), F.concat("put", F.lit("</body>")))).otherwise(F.concat("html", "put"))
    return rows.select(F.col("page_id").alias("source_id"), "url", html.alias("html"), F.array(host).alias("hosts"), F.concat(F.lit("Municipalidad de "), host).alias("name"))


@query()
def x23_site_candidates(spark, sf_dir):
    """Candidates of every page of the table, by all four ways."""
    return LS.site_candidates(with_postings(spark, sf_dir))


@query()
def x23_site_offers(spark, sf_dir):
    """Candidates, their details from the same pages, and what is still a posting."""
    pages = with_postings(spark, sf_dir)
    details = pages.select(F.regexp_replace("url", "[?#].*$", "").alias("url"), "html").unionByName(pages.select(F.lit("https://m.example.net/jp/4").alias("url"), F.lit("<h1>Analista de gestión y datos</h1><p>Vacante, bases y requisitos. Publicado 03/05/1998</p><a href='/b.pdf'>x</a>").alias("html")).distinct())
    found = LS.enriched(LS.site_candidates(pages), details, pages.select("source_id", F.array("url").alias("urls")))
    sources = pages.select("source_id", "name", F.lit("Municipal").alias("sector"), F.lit("Maule").alias("region"))
    return LS.offers(found, sources).withColumns({c: F.col(c).cast("string") for c in ("fecha_publicacion", "fecha_cierre")})


@query()
def x15_blog_listing(spark, sf_dir):
    return LS.blog_listing(with_postings(spark, sf_dir))


@query()
def x19_pdf_candidates(spark, sf_dir):
    return LS.pdf_candidates(with_postings(spark, sf_dir))


@query()
def x25_municipal_calls(spark, sf_dir):
    return LS.municipal_calls(with_postings(spark, sf_dir)).withColumn("fecha_cierre", F.col("fecha_cierre").cast("string"))


@query()
def x26_simple_sites(spark, sf_dir):
    pages = with_postings(spark, sf_dir)
    both = [LS.simple_site(pages, shape).withColumn("shape", F.lit(shape)) for shape in LS.SHAPES]
    return both[0].unionByName(both[1])

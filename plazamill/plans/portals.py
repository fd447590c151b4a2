"""Portals over pages that the tables give: state and objects put into fetched pages, listings of customers page by page."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plazamill.context import OFFERS
from plazamill.functions import json_walk as J
from plazamill.operators import evaluation as E
from plazamill.sources import adapters as A
from plazamill.sources import markup as M
from plazamill.sources import portals as P

from .base import query
from .sites import with_postings

#: Scripts put into the pages of the table, dealt by page.
SCRIPTS = (
    '<script>window.__S = {"vacancies": [{"title": "Analista de gestión", "slug": "analista-1", "location": "Talca", "modality": "Remoto", "description": "Vacante a contrata, bases y requisitos"}, {"title": "Hola", "id": 3}]};</script>',
    '<script>window.__NUXT=(ShallowReactive,cantidadPaginas: 3,1234567,"Analista contable","x","y","Talca, Maule",7654321,"ver detalle",7654322,"Chofer a contrata" "1998-05-03 09:30")</script>',
    '<script type="application/ld+json">[[{"jobTitle": "Médico, vacante de planta", "applyUrl": "/m", "jobLocation": {"address": {"addressLocality": "Talca"}}, "description": "Cargo presencial, concurso"}]]</script>', "<script>var job = {broken: [1, 2</script>", "",
)


def with_scripts(spark, sf_dir):
    put = F.get(F.array(*[F.lit(x) for x in SCRIPTS]), F.pmod("source_id", F.lit(len(SCRIPTS))).cast("int"))
    return with_postings(spark, sf_dir).withColumn("html", F.concat("html", put)).select("source_id", "url", "html", "name", F.lit("Municipal").alias("sector"), F.lit("Maule").alias("region"))


@query()
def x17_embedded_jobs(spark, sf_dir):
    """Objects in linked data and in scripts of every page of the table."""
    return P.embedded_jobs(with_scripts(spark, sf_dir).select("source_id", "url", "html"))


@query()
def x16_state_offers(spark, sf_dir):
    """Postings in the state that pages of the table carry, with their detail pages."""
    pages = with_scripts(spark, sf_dir)
    found = P.state_offers(pages)
    page = F.concat(F.lit("<main><h1>"), F.col("cargo"), F.lit(" I</h1><dl><dt>Ubicación</dt><dd>Linares, Maule</dd></dl><div class='detalle'>Llevar la contabilidad del servicio y preparar los informes de cada mes.</div></main>"))
    details = found.where("at = 0").groupBy("url").agg(F.min("cargo").alias("cargo")).select("url", page.alias("html"))
    return P.with_details(found, details).withColumns({c: F.col(c).cast("string") for c in ("fecha_publicacion", "fecha_cierre")})


SIZE = 10


@query(f"""SELECT portal, url, turn, cargo, institucion, descripcion, '1998-05-01' AS fecha_publicacion, '1998-06-15' AS fecha_cierre, externo FROM (SELECT c_nationkey AS portal, 'https://p' || c_nationkey::VARCHAR || '.cl/pub/convFicha?i=' || (1000 + c_custkey)::VARCHAR AS url, CASE WHEN c_custkey % 7 = 0 THEN 'Auditor ' || c_custkey::VARCHAR ELSE 'Profesional de ' || lower(c_mktsegment) END AS cargo,
 c_name AS institucion, 'Resumen & más' AS descripcion, (1000 + c_custkey)::VARCHAR AS externo, ((row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) // {SIZE} + 1)::INT AS turn FROM customer)""", cte=False)
def x24_portal_cards(spark, sf_dir):
    """Listings of ten customers a page, one portal a nation, chained by links and by post-backs in turn."""
    c = F.col
    n = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1
    title = F.when(c("c_custkey") % 7 == 0, F.concat(F.lit("Solo Difusión</div><h3>Auditor "), c("c_custkey").cast("string"), F.lit("</h3><div>"))).otherwise(F.concat(F.lit("Profesional de "), F.lower("c_mktsegment")))
    card = F.concat(
        F.lit('<div class="caja row"><div id=bx_titulos>'), title, F.lit("</div><div id='bx_resumen'><strong>Ministerio / "), c("c_name"), F.lit(" /</strong>Resumen &amp; m&aacute;s <em>01/05/1998 - 15/06/1998</em></div><a href='/pub/convFicha?i="),
        (c("c_custkey") + 1000).cast("string"), F.lit("'>ver</a></div>"),
    )
    rows = A.read(spark, sf_dir, "customer").select(c("c_nationkey").alias("portal"), F.floor(n / SIZE).cast("int").alias("k"), "c_custkey", card.alias("card"))
    boxes = rows.groupBy("portal", "k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "card"))), lambda x: x["card"]), "").alias("boxes"))
    base, k = F.concat(F.lit("https://p"), c("portal").cast("string"), F.lit(".cl/pub/lista")), c("k").cast("string")
    link = F.concat(F.lit('<a href="?pag='), (c("k") + 1).cast("string"), F.lit('">Siguiente</a>'))
    back = F.concat(F.lit('<form><input type="hidden" name="__VIEWSTATE" value="'), k, F.lit("\"></form><a href=\"javascript:__doPostBack('grid','Page')\">"), (c("k") + 2).cast("string"), F.lit("</a>"))
    posted = (c("k") > 0) & (c("k") % 2 == 0)
    # a page is reached by the kind of request that the page before it asks for: even pages link, odd ones post back
    before = F.concat(base, F.when(c("k") > 1, F.concat(F.lit("?pag="), (c("k") - 1).cast("string"))).otherwise(""))
    url = F.when(posted, before).when(c("k") == 0, base).otherwise(F.concat(base, F.lit("?pag="), k))
    data = F.when(posted, F.create_map(F.lit("__VIEWSTATE"), (c("k") - 1).cast("string"), F.lit("__EVENTTARGET"), F.lit("grid"), F.lit("__EVENTARGUMENT"), F.lit("Page"))).otherwise(F.create_map().cast("map<string,string>"))
    pages = boxes.select("portal", F.when(posted, "POST").otherwise("GET").alias("method"), url.alias("url"), data.alias("data"), F.concat("boxes", F.when(c("k") % 2 == 0, link).otherwise(back)).alias("html"), (c("k") == 0).alias("started"))
    out = P.listed_cards(pages).drop("at")
    return out.withColumns({x: c(x).cast("string") for x in ("fecha_publicacion", "fecha_cierre")})


_NESTED = """'{"@graph": [{"id": ' || o_orderkey::VARCHAR || ', "deep": [[{"y": "' || o_orderpriority || '", "z": {}}]], "said": "}[{"}], "t": [' || CASE WHEN o_orderkey % 3 = 0 THEN '{"y": "uno"}' ELSE '1, [2]' END || ']}'"""


@query(f"""SELECT id, count(*) AS objetos, coalesce(string_agg(y, '|' ORDER BY y), '') AS ys FROM (SELECT o_orderkey AS id, json_extract_string(t.value, '$.y') AS y FROM (SELECT o_orderkey, {_NESTED} AS j FROM orders), json_tree(j) t WHERE t.type = 'OBJECT') GROUP BY id""", cte=False)
def m02_json_walk(spark, sf_dir):
    """Every object of nested JSON at any depth, and what one field says in them."""
    c = F.col
    deep = F.concat(
        F.lit('{"@graph": [{"id": '), c("o_orderkey").cast("string"), F.lit(', "deep": [[{"y": "'), c("o_orderpriority"), F.lit('", "z": {}}]], "said": "}[{"}], "t": ['),
        F.when(c("o_orderkey") % 3 == 0, '{"y": "uno"}').otherwise("1, [2]"), F.lit("]}"),
    )
    rows = A.read(spark, sf_dir, "orders").select(c("o_orderkey").alias("id"), J.objects(deep).alias("o"))
    said = F.array_sort(F.array_compact(F.transform("o", lambda v: J.value(v, "y"))))
    return rows.select("id", F.size("o").cast("long").alias("objetos"), F.array_join(said, "|").alias("ys"))


@query()
def d06_page_dates(spark, sf_dir):
    """Dates of every page of the table: meta tags, linked data, time tags and labelled text, by their confidence."""
    pages = with_scripts(spark, sf_dir).withColumn("page", M.tree(F.col("html")))
    d = E.dates_of(F.col("page"), M.said(F.col("page")), OFFERS.day)
    return pages.select("source_id", d.alias("d")).select("source_id", *[F.col(f"d.{x}").cast("string").alias(x) for x in ("publication", "closing", "deadline")])

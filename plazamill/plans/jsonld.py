"""Linked data: the nested posting and the list of a landing page."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plazamill.context import OFFERS
from plazamill.operators import jsonld as J
from plazamill.operators import offers as O
from plazamill.sources import adapters as A

from .base import lit, query
from .endpoints import _SLUG
from .listing import ACTIVE, BASE, P01, joined

_js = lambda x: f"to_json({x})::VARCHAR"
_opt = lambda k, x: f"CASE WHEN {x} IS NOT NULL THEN ',\"{k}\":' || {_js(x)} ELSE '' END"
_t = lambda c: f"nullif(trim({c}), '')"
_DESC = "substring(trim(coalesce(nullif(descripcion, ''), cargo)), 1, 4000)"
_KIND = "CASE upper(trim(tipo_contrato)) " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in J.EMPLOYMENT.items()) + " END"
_PAY = """CASE WHEN renta_bruta_min > 0 THEN ',"baseSalary":{"@type":"MonetaryAmount","currency":"CLP","value":{"@type":"QuantitativeValue","unitText":"MONTH",' || CASE WHEN renta_bruta_max > renta_bruta_min THEN '"minValue":' || renta_bruta_min::VARCHAR || ',"maxValue":' || renta_bruta_max::VARCHAR ELSE '"value":' || renta_bruta_min::VARCHAR END || '}}' ELSE '' END"""
_ESC = "replace(replace(replace({}, '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026')"
_DOC = f"""'{{"@context":"https://schema.org","@type":"JobPosting","title":' || {_js('trim(cargo)')} || ',"description":' || {_js(_DESC)} || ',"datePosted":"' || coalesce(fecha_publicacion, fecha_cierre)::VARCHAR || '","validThrough":"' || fecha_cierre::VARCHAR || '","url":' || {_js('trim(url_oferta)')} || ',"identifier":{{"@type":"PropertyValue","name":"plazamill","value":"' || id::VARCHAR || '"}},"mainEntityOfPage":"https://sitio.cl/oferta/' || id::VARCHAR || '","hiringOrganization":{{"@type":"Organization","name":' || {_js('trim(institucion)')} || '}},"jobLocation":{{"@type":"Place","address":{{"@type":"PostalAddress","addressCountry":"CL"'
 || {_opt('addressRegion', _t('region'))} || {_opt('addressLocality', _t('ciudad'))} || '}}}},"directApply":false' || {_opt('employmentType', _KIND)} || {_opt('workHours', _t('jornada'))} || {_PAY} || '}}'"""


@query(f"SELECT id, CASE WHEN {_t('cargo')} IS NOT NULL AND {_t('institucion')} IS NOT NULL AND regexp_matches(trim(url_oferta), '^https?://') AND fecha_cierre IS NOT NULL AND coalesce({_t('region')}, {_t('ciudad')}) IS NOT NULL THEN {_ESC.format(_DOC)} END AS doc FROM ({P01} {BASE})")
def p12_json_documents(spark, sf_dir):
    rows = O.projection(joined(spark, sf_dir), OFFERS)
    return rows.select("id", J.posting({c: F.col(c) for c in rows.columns}, F.concat(F.lit("https://sitio.cl/oferta/"), F.col("id"))).alias("doc"))


@query(f"""SELECT '{{"@context":"https://schema.org","@type":"ItemList","url":"https://sitio.cl/empleos","numberOfItems":' || count(*)::VARCHAR || ',"itemListElement":[' || string_agg('{{"@type":"ListItem","position":' || pos::VARCHAR || ',"url":"https://sitio.cl/oferta/' || id::VARCHAR || CASE WHEN s <> '' THEN '-' || s ELSE '' END || '","name":' || {_js("coalesce(nullif(trim(coalesce(cargo, '')), ''), 'Oferta pública')")} || '}}', ',' ORDER BY pos) || ']}}' AS doc
 FROM (SELECT *, {_SLUG.replace('i.nombre', "coalesce(cargo, '')")} AS s FROM (SELECT o.id, o.cargo, row_number() OVER (ORDER BY o.fecha_cierre NULLS LAST, o.id DESC) AS pos FROM ofertas o WHERE {ACTIVE} QUALIFY pos <= 30))""")
def p12_landing_list(spark, sf_dir):
    top = A.offers(spark, sf_dir).where(O.is_active(OFFERS)).orderBy(F.asc_nulls_last("fecha_cierre"), F.desc("id")).limit(30)
    rows = top.select("id", "cargo", F.row_number().over(Window.orderBy(F.asc_nulls_last("fecha_cierre"), F.desc("id"))).alias("pos"))  # at most 30 rows
    return J.item_list(rows, "https://sitio.cl/empleos", "https://sitio.cl")

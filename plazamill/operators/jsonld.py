"""Linked data of postings and landing pages, as JSON that can stand inside a script tag."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plazamill.functions.text import slug

#: Contract kinds and their names in the vocabulary; others are left out.
EMPLOYMENT = {"PLANTA": "FULL_TIME", "CONTRATA": "FULL_TIME", "CODIGO_TRABAJO": "FULL_TIME", "CÓDIGO_TRABAJO": "FULL_TIME", "HONORARIOS": "CONTRACTOR", "REEMPLAZO": "TEMPORARY"}


def _text(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def embedded(json: Column) -> Column:
    """Characters that could end a script tag or a line of it as escapes."""
    for a, b in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029")):
        json = F.replace(json, F.lit(a), F.lit(b))
    return json


def posting(o: dict[str, Column], canonical: Column) -> Column:
    """The JobPosting of a row (columns id, cargo, institucion, url_oferta, fecha_cierre, fecha_publicacion, ciudad, region,
    descripcion, tipo_contrato, jornada, renta_bruta_min, renta_bruta_max); null without title, institution, full
    address, closing date and a place. Null parts are left out."""
    title, place, town = _text(o["cargo"]), _text(o["region"]), _text(o["ciudad"])
    body = F.substring(F.trim(F.coalesce(F.nullif(o["descripcion"], F.lit("")), title)), 1, 4000)
    low, high = o["renta_bruta_min"], o["renta_bruta_max"]
    span = high > low
    pay = F.struct(F.lit("QuantitativeValue").alias("@type"), F.lit("MONTH").alias("unitText"), F.when(span, low).alias("minValue"), F.when(span, high).alias("maxValue"), F.when(~F.coalesce(span, F.lit(False)), low).alias("value"))
    kind = F.try_element_at(F.create_map(*[F.lit(x) for kv in EMPLOYMENT.items() for x in kv]), F.upper(F.trim(o["tipo_contrato"])))
    data = F.struct(
        F.lit("https://schema.org").alias("@context"), F.lit("JobPosting").alias("@type"), title.alias("title"), body.alias("description"), F.coalesce(o["fecha_publicacion"], o["fecha_cierre"]).cast("string").alias("datePosted"), o["fecha_cierre"].cast("string").alias("validThrough"),
        F.trim(o["url_oferta"]).alias("url"), F.struct(F.lit("PropertyValue").alias("@type"), F.lit("plazamill").alias("name"), o["id"].cast("string").alias("value")).alias("identifier"), canonical.alias("mainEntityOfPage"), F.struct(F.lit("Organization").alias("@type"), _text(o["institucion"]).alias("name")).alias("hiringOrganization"),
        F.struct(F.lit("Place").alias("@type"), F.struct(F.lit("PostalAddress").alias("@type"), F.lit("CL").alias("addressCountry"), place.alias("addressRegion"), town.alias("addressLocality")).alias("address")).alias("jobLocation"), F.lit(False).alias("directApply"),
        kind.alias("employmentType"), _text(o["jornada"]).alias("workHours"), F.when(low > 0, F.struct(F.lit("MonetaryAmount").alias("@type"), F.lit("CLP").alias("currency"), pay.alias("value"))).alias("baseSalary"),
    )
    full = title.isNotNull() & _text(o["institucion"]).isNotNull() & F.trim(o["url_oferta"]).rlike("^https?://") & o["fecha_cierre"].isNotNull() & F.coalesce(place, town).isNotNull()
    return F.when(full, embedded(F.to_json(data)))


def item_list(rows, canonical: str, site: str):
    """One row: the ItemList of rows (id, cargo, pos), at most a page of them."""
    name = F.trim(F.coalesce("cargo", F.lit("")))
    tail = slug(F.coalesce("cargo", F.lit("")))
    url = F.concat(F.lit(f"{site}/oferta/"), F.col("id"), F.when(tail != "", F.concat(F.lit("-"), tail)).otherwise(""))
    item = F.struct(F.lit("ListItem").alias("@type"), F.col("pos").alias("position"), url.alias("url"), F.coalesce(F.nullif(name, F.lit("")), F.lit("Oferta pública")).alias("name"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("pos", item.alias("i")))), lambda x: x["i"])
    data = rows.agg(items.alias("items")).where(F.size("items") > 0)
    return data.select(embedded(F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("ItemList").alias("@type"), F.lit(canonical).alias("url"), F.size("items").alias("numberOfItems"), F.col("items").alias("itemListElement")))).alias("doc"))

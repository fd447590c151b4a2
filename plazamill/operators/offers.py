"""Postings: status, projection, filters, orders. Columns in, columns or frames out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plazamill.context import Clock

#: States that count as closed, compared in lower case.
CLOSED = ("cerrada", "cerrado", "cerrada_manual", "vencido", "finalizada", "closed", "expired")
#: Canonical status to the labels of older clients.
LEGACY = {"active": "activo", "closing_today": "activo", "upcoming": "proximo", "closed": "cerrado", "unknown": "desconocido"}


def filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def status(clock: Clock, col=F.col) -> Column:
    """First rule wins: switched off, closed by state, not begun, past closing, closing today, else active."""
    begins, closes = F.coalesce(col("fecha_inicio"), col("fecha_publicacion")), col("fecha_cierre")
    return (
        F.when(~F.coalesce(col("activa"), F.lit(True)), "closed")
        .when(F.lower(F.coalesce(col("estado"), F.lit(""))).isin(*CLOSED), "closed")
        .when(begins > clock.day, "upcoming")
        .when(closes < clock.day, "closed")
        .when(closes == clock.day, "closing_today")
        .otherwise("active")
    )


def is_active(clock: Clock, col=F.col) -> Column:
    return status(clock, col).isin("active", "closing_today")


def legacy(status_: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in LEGACY.items() for x in kv]), status_)


def seen_at(col=F.col) -> Column:
    return F.coalesce(col("fecha_scraped"), col("detectada_en"), col("actualizada_en"), col("creada_en"))


def with_institution(offers: DataFrame, institutions: DataFrame) -> DataFrame:
    """offers left join institutions; the latter's columns get the prefix i_."""
    side = institutions.select(*[F.col(c).alias(f"i_{c}") for c in institutions.columns])
    return offers.join(side, F.col("institucion_id") == F.col("i_id"), "left")


def projection(joined: DataFrame, clock: Clock) -> DataFrame:
    """The canonical row of a posting."""
    c = F.col
    return joined.select(
        "id",
        "institucion_id",
        F.coalesce(filled(F.trim("institucion_nombre")), "i_nombre", F.lit("Sin institución")).alias("institucion"),
        F.coalesce("i_sigla", "i_nombre_corto").alias("sigla"),
        F.coalesce("cargo", F.lit("Sin cargo")).alias("cargo"),
        F.coalesce("descripcion", F.lit("")).alias("descripcion"),
        F.coalesce("requisitos", "requisitos_texto", F.lit("")).alias("requisitos"),
        contract(c).alias("tipo_contrato"),
        F.coalesce("region", "i_region").alias("region"),
        "ciudad",
        F.coalesce("i_sector", "sector", "i_tipo").alias("sector"),
        "renta_bruta_min",
        "renta_bruta_max",
        "grado_eus",
        F.coalesce("jornada", F.when(c("horas_semanales").isNotNull(), F.concat(c("horas_semanales").cast("string"), F.lit(" hrs / semana")))).alias("jornada"),
        "area_profesional",
        "fecha_publicacion",
        "fecha_inicio",
        "fecha_cierre",
        F.coalesce("url_oferta", "url_original").alias("url_oferta"),
        F.coalesce("url_bases", "url_original", "url_oferta").alias("url_bases"),
        "url_oferta_valida",
        status(clock).alias("estado"),
        seen_at().alias("fecha_scraped"),
        F.coalesce("actualizada_en", "creada_en").alias("fecha_actualizado"),
        F.col("i_plataforma_empleo").alias("plataforma"),
        F.col("i_url_empleo").alias("institucion_url_empleo"),
    )


def contract(col=F.col) -> Column:
    return F.coalesce(filled(col("tipo_contrato")), filled(col("tipo_cargo")))


def has(c: Column, text: str) -> Column:
    """Case-insensitive "contains"; % and _ in the text stay wildcards."""
    return c.ilike(f"%{text}%")


def any_of(c: Column, comma_list: str) -> Column | None:
    parts = [p.strip() for p in comma_list.split(",") if p.strip()]
    return reduce(lambda a, b: a | b, [has(c, p) for p in parts]) if parts else None


def filters(
    clock: Clock, q: str | None = None, region: str | None = None, sector: str | None = None, kind: str | None = None, institution: int | None = None, area: str | None = None,
    pay_from: int | None = None, city: str | None = None, towns: str | None = None, closing_soon: bool = False, fresh: bool = False, only_active: bool = True, only_closed: bool = False,
) -> Column:
    """The conjunction of the filters asked for, over offers joined with institutions. Free text matches when all its
    words are tokens of the folded text, or as a substring of title, institution or description."""
    c = F.col
    said: list[Column] = [F.lit(True)]
    if only_active:
        said.append(is_active(clock))
    if only_closed:
        said.append(status(clock) == "closed")
    if q:
        said.append(has(c("cargo"), q) | has(F.coalesce("i_nombre", "institucion_nombre", F.lit("")), q) | has(F.coalesce("descripcion", F.lit("")), q))
    if region:
        said.append(has(F.coalesce("region", "i_region", F.lit("")), region))
    if sector:
        said.append(has(F.coalesce("i_sector", "sector", "i_tipo", F.lit("")), sector))
    if kind and (part := any_of(contract(), kind)) is not None:
        said.append(part)
    if institution is not None:
        said.append(c("institucion_id") == institution)
    if area:
        said.append(has(c("area_profesional"), area))
    if pay_from is not None:
        said.append((c("renta_bruta_min") >= pay_from) | (c("renta_bruta_max") >= pay_from))
    if towns and (part := any_of(c("ciudad"), towns)) is not None:
        said.append(part)
    elif city:
        said.append(has(c("ciudad"), city))
    if closing_soon:
        said.append(c("fecha_cierre").between(clock.day, F.date_add(clock.day, 5)))
    if fresh:
        said.append(seen_at() >= clock.instant - F.expr("INTERVAL 48 HOURS"))
    return reduce(lambda a, b: a & b, said)


def state_view(offers: DataFrame, clock: Clock) -> DataFrame:
    """State, days left (floored at 0, no date: 0) and traffic light."""
    left = F.datediff("fecha_cierre", clock.day)
    return offers.select(
        "id",
        F.when(~F.col("activa"), "cerrado").when(F.col("fecha_cierre") < clock.day, "vencido").otherwise("activo").alias("estado"),
        F.greatest(F.lit(0), F.coalesce(left, F.lit(0))).alias("dias_restantes"),
        F.when(F.col("fecha_cierre").isNull(), "sin_plazo").when(left <= 2, "urgente").when(left <= 5, "pronto").otherwise("vigente").alias("semaforo"),
    )


def listing_order(name: str, clock: Clock) -> list[Column]:
    """Six orders; every one but "recent" puts postings without a closing date last; ties go to the smaller id."""
    undated = F.when(F.col("fecha_cierre").isNull(), 1).otherwise(0)
    low = F.least(F.coalesce("renta_bruta_min", "renta_bruta_max"), F.coalesce("renta_bruta_max", "renta_bruta_min"))
    high = F.greatest(F.coalesce("renta_bruta_max", "renta_bruta_min"), F.coalesce("renta_bruta_min", "renta_bruta_max"))
    keys = {
        "cierre": [F.asc("fecha_cierre")],
        "recientes": [F.desc_nulls_last("fecha_publicacion")],
        "renta_desc": [high.desc_nulls_last()],
        "renta_asc": [low.asc_nulls_last()],
        "cargo": [F.asc_nulls_last("cargo")],
        "institucion": [F.asc_nulls_last("institucion_nombre")],
    }
    return [undated.asc(), *keys[name], F.asc("id")]


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def present(frame: DataFrame, *names: str, default=None) -> Column:
    """COALESCE over the columns that the frame has (schemas drift)."""
    found = [F.col(n) for n in names if n in frame.columns]
    return F.coalesce(*found, F.lit(default)) if found else F.lit(default)

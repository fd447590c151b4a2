"""Sections, addresses and amounts of notices, driven by texts in which every branch occurs."""

from __future__ import annotations

from pyspark.sql import functions as F

from plazamill.functions import sections as S
from plazamill.functions import tables as TB

from .base import query, sql_any, sql_count
from .labels import dealt, dealt_sql

BODIES = (
    "Objetivo del cargo:\n - Coordinar el equipo\n* Llevar agenda\nuno\nRequisitos:\nTítulo profesional de contador\nDos años de experiencia\nDeseable:\nInglés medio\nDocumentos:\nCV y certificado",
    "FUNCIONES\r\natender público\r\nAtender Público\r\nordenar la bodega\r\nRequisitos exigibles\r\n-  Licencia media \r\nContacto:\r\nno va aquí",
    "Sin secciones", "", None, "Responsabilidades\na b\nc d\ne f\ng h\ni j\nk l\nm n\no p",
    "Requisitos del cargo\nno\nOtra Cosa:\nfuera de lugar", "requisitos deseables\nManejo de planillas\nPrincipales funciones\nsupervisar obras menores\nplus de zona\ncédula de identidad vigente",
)


def _sql_trim(x: str, chars: str) -> str:
    return f"regexp_replace({x}, '^{chars}+|{chars}+$', '', 'g')"


_L = "list_filter(list_transform(string_split(replace(coalesce(texto, ''), chr(13), chr(10)), chr(10)), lambda x: " + _sql_trim("x", "\\s") + "), lambda x: x <> '')"
_WIDE = "len(list_filter(regexp_split_to_array(x, '\\s+'), lambda w: w <> '')) >= 2"
_DASH = "[ \\-*\\t]"


def _sql_distinct(x: str) -> str:
    return f"list_transform(list_filter(list_transform(generate_series(1, len({x})), lambda i: {{'i': i, 'v': {x}[i]}}), lambda s: list_position(list_transform({x}, lambda q: lower(q)), lower(s.v)) = s.i), lambda s: s.v)"


@query(f"""SELECT id, array_to_string({_sql_distinct('c')}[1:12], '|') AS funciones FROM (SELECT id, list_filter(flatten(list_transform(generate_series(1, len(l)), lambda i: CASE WHEN regexp_matches(l[i], '(?i){S.FUNCTIONS}') THEN l[i + 1 : i + 7] ELSE [] END)), lambda x: {_WIDE}) AS c
 FROM (SELECT id, list_transform({_L}, lambda x: {_sql_trim('x', _DASH)}) AS l FROM {dealt_sql(texto=BODIES)}))""", cte=False)
def l10_functions(spark, sf_dir):
    return dealt(spark, sf_dir, texto=BODIES).select("id", F.array_join(S.functions(F.col("texto")), "|").alias("funciones"))


def _sql_section(pattern: str) -> str:
    window = "l[i + 1 : i + 10]"
    at = f"list_position(list_transform({window}, lambda y: regexp_matches(y, '{S.HEADER}')), TRUE)"
    return f"list_transform(list_filter(flatten(list_transform(generate_series(1, len(l)), lambda i: CASE WHEN regexp_matches(l[i], '(?i){pattern}') THEN CASE WHEN coalesce({at}, 0) > 0 THEN {window}[1 : {at} - 1] ELSE {window} END ELSE [] END)), lambda x: {_WIDE}), lambda x: {_sql_trim('x', _DASH)})"


@query(f"""SELECT id, array_to_string({_sql_distinct('r')}[1:12], '|') AS requisitos, array_to_string({_sql_distinct('d')}[1:10], '|') AS deseables, array_to_string(list_filter(l, lambda x: regexp_matches(x, '(?i){S.DOCUMENTS}'))[1:10], '|') AS documentos FROM (SELECT id, l, {_sql_section(S.REQUIRED)} AS r, {_sql_section(S.DESIRABLE)} AS d FROM (SELECT id, {_L} AS l FROM {dealt_sql(texto=BODIES)}))""", cte=False)
def l10_requirements(spark, sf_dir):
    r = S.requirements(F.col("texto"))
    return dealt(spark, sf_dir, texto=BODIES).select("id", *[F.array_join(r[a], "|").alias(b) for a, b in (("required", "requisitos"), ("desirable", "deseables"), ("documents", "documentos"))])


def sql_matches(x: str, pattern: str) -> str:
    """list of {v, s}: matches of a pattern in x and their places from 0."""
    found, between = f"regexp_extract_all({x}, '{pattern}')", f"regexp_split_to_array({x}, '{pattern}')"
    total = lambda xs: f"coalesce(list_sum(list_transform({xs}, lambda q: length(q))), 0)"
    return f"list_transform(generate_series(1, len({found})), lambda i: {{'v': {found}[i], 's': ({total(f'{between}[1:i]')} + {total(f'{found}[1 : i - 1]')})::BIGINT}})"


def sql_around(x: str, m: str, radius: int) -> str:
    return f"substring({x}, greatest({m}.s - {radius}, 0)::BIGINT + 1, ({m}.s + length({m}.v) + {radius} - greatest({m}.s - {radius}, 0))::BIGINT)"


MAIL_TEXTS = (
    "Enviar antecedentes a Uno@Correo.cl. " + "x" * 150 + " Para consultas dos@correo.cl", "contacto: tres@correo.cl o postular al correo tres@correo.cl", "Información en cuatro@correo.cl", "postulaciones cinco@correo.cl, y seis@correo.gob.cl",
    "sin correo; use el formulario", "Entrega en oficina de partes", "nada", None, "siete@correo.cl", "dudas al correo ocho@correo.cl " + "y" * 120 + " hacer llegar CV a ocho@correo.cl",
)
_KIND = f"CASE WHEN {sql_any('c', TB.APPLY_HINTS)} AND {sql_any('c', TB.ASK_HINTS)} THEN 'PC' WHEN {sql_any('c', TB.APPLY_HINTS)} THEN 'P' WHEN {sql_any('c', TB.ASK_HINTS)} THEN 'C' WHEN contains(c, 'postul') THEN 'P' WHEN {sql_any('c', ('consulta', 'informaci', 'contact'))} THEN 'C' ELSE 'I' END"


@query(f"""WITH t AS (SELECT id, coalesce(texto, '') AS t FROM {dealt_sql(texto=MAIL_TEXTS)}), m AS (SELECT id, unnest({sql_matches('t', S.ADDRESS)}) AS m, t FROM t), k AS (SELECT id, lower(m.v) AS a, m.s AS s, {_KIND} AS k FROM (SELECT id, m, lower({sql_around('t', 'm', 100)}) AS c FROM m)),
 a AS (SELECT id, a, min(s) AS s, CASE WHEN bool_or(contains(k, 'P')) THEN 'P' ELSE '' END || CASE WHEN bool_or(contains(k, 'C')) THEN 'C' ELSE '' END || CASE WHEN bool_or(contains(k, 'I')) THEN 'I' ELSE '' END AS k FROM k GROUP BY id, a),
 g AS (SELECT id, string_agg(a || ':' || k, ',' ORDER BY s) AS correos, bool_or(contains(k, 'P')) AS p, bool_or(contains(k, 'C')) AS c FROM a GROUP BY id)
 SELECT id, coalesce(correos, '') AS correos, CASE WHEN p AND c THEN 'postulacion_mixta' WHEN p THEN 'postulacion_por_email' WHEN regexp_matches(lower(t), 'postular|formulario|portal de empleo|trabajando\\.cl|bne\\.cl') THEN 'postulacion_por_portal_externo' WHEN regexp_matches(lower(t), 'presencial|oficina de partes|entrega presencial') THEN 'postulacion_presencial' ELSE 'canal_no_determinado' END AS canal, coalesce(c, FALSE) AS consultas FROM t LEFT JOIN g USING (id)""", cte=False)
def l11_mails(spark, sf_dir):
    rows = dealt(spark, sf_dir, wide=True, texto=MAIL_TEXTS).select("id", S.mails(F.col("texto")).alias("m"))
    shown = F.array_join(F.transform("m.addresses", lambda x: F.concat(x["address"], F.lit(":"), x["kinds"])), ",")
    return rows.select("id", shown.alias("correos"), F.col("m.channel").alias("canal"), F.col("m.asks").alias("consultas"))


PAY_TEXTS = (
    "Renta bruta mensual $ 1.250.000 y presupuesto total del proyecto de $ 90.000.000", "Monto total $2.000.000", "Sueldo base de $ 12.500.000", "Presupuesto anual: CLP 11.000.000", "pesos 350000 de renta; otra de $ 350.001", "renta $ 200.000", "sin montos", "", None,
    "Honorarios mensuales $ 16.000.000", "Convenio por $900.000, programa y licitación", "remuneración $ 1.100.000 " + "z" * 100 + " decreto $ 1.100.000", "$ 800.000 y $ 700.000",
)
_JUDGED = f"list_transform({sql_matches('t', S.AMOUNT)}, lambda m: {{'v': m.v, 'n': TRY_CAST(regexp_replace(m.v, '[^0-9]', '', 'g') AS BIGINT), 'g': {sql_count('lower(' + sql_around('t', 'm', 80) + ')', TB.PAY_GOOD)}, 'b': {sql_count('lower(' + sql_around('t', 'm', 80) + ')', TB.PAY_BAD)}}})"


@query(f"""SELECT id, CASE WHEN estado IS NULL OR estado = 'remuneracion_sospechosa' THEN n END AS monto, v AS texto, CASE WHEN n IS NULL THEN NULL WHEN estado IS NULL THEN 'high' WHEN estado = 'remuneracion_sospechosa' THEN 'medium' ELSE 'low' END AS confianza, estado
 FROM (SELECT id, n, v, CASE WHEN n >= 15000000 THEN 'remuneracion_descartada' WHEN n >= 10000000 AND (g = 0 OR b > g) THEN 'remuneracion_no_confiable' WHEN n >= 10000000 THEN 'remuneracion_sospechosa' WHEN b > g THEN 'remuneracion_no_confiable' END AS estado
 FROM (SELECT id, r.n AS n, r.v AS v, r.g AS g, r.b AS b FROM (SELECT id, list_sort(list_transform(list_filter({_JUDGED}, lambda c: c.n >= 250000), lambda c: {{'s': 3 * c.g - 2 * c.b, 'd': c.g - c.b, 'm': -c.n, 'v': c.v, 'n': c.n, 'g': c.g, 'b': c.b}}), 'DESC')[1] AS r FROM (SELECT id, coalesce(texto, '') AS t FROM {dealt_sql(texto=PAY_TEXTS)}))))""", cte=False)
def n03_context_pay(spark, sf_dir):
    p = S.pay_in_context(F.col("texto"))
    rows = dealt(spark, sf_dir, texto=PAY_TEXTS).select("id", p.alias("p"))
    return rows.select("id", F.col("p.amount").alias("monto"), F.col("p.raw").alias("texto"), F.col("p.confidence").alias("confianza"), F.col("p.status").alias("estado"))


@query(f"""SELECT id, list_min(k) AS minimo, list_max(k) AS maximo FROM (SELECT id, list_filter(list_transform(list_filter({sql_matches('t', S.PLAIN_AMOUNT)}, lambda m: NOT {sql_any('lower(' + sql_around('t', 'm', 60) + ')', S.NO_PAY)}), lambda m: TRY_CAST(regexp_replace(m.v, '[^0-9]', '', 'g') AS BIGINT)), lambda n: n >= 300000 AND n < 15000000) AS k FROM (SELECT id, coalesce(texto, '') AS t FROM {dealt_sql(texto=PAY_TEXTS)}))""", cte=False)
def n05_pay_span(spark, sf_dir):
    p = S.pay_span(F.col("texto"))
    return dealt(spark, sf_dir, texto=PAY_TEXTS).select("id", p["low"].alias("minimo"), p["high"].alias("maximo"))

"""Portals over fixed payloads and against plain Python."""

import json
import random

from pyspark.sql import functions as F

from plazamill.sources import markup as M
from plazamill.sources import portals as P


def test_json_values_are_those_of_every_bracket():
    """Against trying each bracket: what is found inside a value that was read is in that value."""
    r = random.Random(2)

    def every(text):
        out = []
        for i, ch in enumerate(text):
            if ch in "[{":
                try:
                    out.append(json.JSONDecoder().raw_decode(text[i:])[0])
                except ValueError:
                    pass
        return out

    def walk(x):
        if isinstance(x, dict):
            yield json.dumps(x, sort_keys=True)
        for y in x.values() if isinstance(x, dict) else x if isinstance(x, list) else ():
            yield from walk(y)

    parts = ['{"title": "a", "n": [1, {"b": "}"}]}', "var x = [", "];", "{a: 1}", '[{"job": {"t": "\\"["}}]', "function(){ return {", "}}", '{"x": {"y": [[{"z": 1}]]}', '"', "'", "[1, 2"]
    for _ in range(200):
        text = " ".join(r.choice(parts) for _ in range(r.randint(1, 6)))
        got = {o for v in P.json_values(text) for o in walk(json.loads(v))}
        assert got == {o for v in every(text) for o in walk(v)}, text


def test_json_values_stop_at_the_stated_bounds():
    assert len(P.json_values("{" * 10 + '{"a": 1}' * 5000)) == P.MOST_STARTS - 10
    assert P.json_values(" " * P.MOST_CHARS + '{"a": 1}') == []


def test_embedded_jobs(spark):
    state = 'window.__S = {"page": 1, "vacancies": [{"title": "Analista de gestión", "slug": "analista-1", "location": "Talca", "modality": "Remoto", "description": "Vacante a contrata, bases y requisitos", "createdAt": "2026-05-01"}, {"name": "Chofer a contrata, vacante", "id": 77, "jobType": 1}, {"position": "Concurso: abogado, vacante", "url": "/ofertas/9"}, {"title": "Hola"}]};'
    linked = {"@graph": [[{"jobTitle": "Médico, vacante de planta", "applyUrl": "https://h.cl/m", "jobLocation": [{"address": {"addressLocality": "Talca", "addressRegion": "Maule"}}, {"address": {"addressCountry": "CL"}}], "description": "Cargo presencial, concurso", "datePosted": "2026-05-03"}]]}
    html = f"<script>{state}</script><script>var other = [1]</script><script type='application/ld+json'>{json.dumps(linked)}</script>"
    out = P.embedded_jobs(spark.createDataFrame([(1, "https://h.cl/x/lista", html), (2, "https://n.cl", "<p>nada</p>"), (3, "https://n.cl", None)], "source_id int, url string, html string")).collect()
    got = sorted((r["kind"], r["title"], r["url"], r["place"], r["mode"], r["date_value"]) for r in out)
    assert got == [
        (0, "Médico, vacante de planta", "https://h.cl/m", "Talca, Maule, CL", "presencial", "2026-05-03"), (1, "Analista de gestión", "https://h.cl/jobs/analista-1", "Talca", "Remoto", "2026-05-01"),
        (1, "Chofer a contrata, vacante", "https://h.cl/jobs/77", "", "", None), (1, "Concurso: abogado, vacante", "https://h.cl/ofertas/9", "", "", None),
    ]
    assert next(r["content"] for r in out if r["title"].startswith("Anal")) == "Analista de gestión Talca Remoto Analista de gestión Talca Remoto Vacante a contrata, bases y requisitos"


STATE = '<script>a</script><script>window.__NUXT=(ShallowReactive,cantidadPaginas: 3,1234567,"Analista contable","x","y","Talca, Maule",1234567,"Analista contable","x","y","Curicó, Maule", "2026-05-02 10:00", "2026-05-09 11:00"\n7654321,"ver detalle"\n7654322,"Chofer a contrata" "2026-05-03 09:30"</script>'


def source(spark, *rows):
    return spark.createDataFrame([(*r, "Muni", "Municipal", "Maule") for r in rows], "source_id int, url string, html string, name string, sector string, region string")


def test_state_offers(spark):
    cards = '<article><h2>Vacante a contrata, concurso</h2><a href="/o/1">v</a></article><div class="card"><h3>Hola</h3></div>'
    got = sorted((r["source_id"], r["at"], r["pages"], r["url"], r["cargo"], r["ciudad"], str(r["fecha_publicacion"])) for r in P.state_offers(source(spark, (1, "https://e.trabajando.cl/trabajo-empleo", STATE), (2, "https://f.cl/x", cards))).collect())
    assert got == [
        (1, 0, 3, "https://e.trabajando.cl/oferta/1234567", "Analista contable", "Curicó", "2026-05-02"), (1, 1, 3, "https://e.trabajando.cl/oferta/1234567", "Analista contable", "Curicó", "2026-05-02"),
        (1, 3, 3, "https://e.trabajando.cl/oferta/7654322", "Chofer a contrata", None, "2026-05-03"), (2, 0, 1, "https://f.cl/o/1", "Vacante a contrata, concurso", None, "None"),
    ]


def test_details_of_state_offers(spark):
    offers = P.state_offers(source(spark, (1, "https://e.trabajando.cl/t", STATE)))
    page = """<main><h1>Analista contable senior</h1><p class="box-empresa">Servicio de Salud</p><dl><dt>Ubicación:</dt><dd>Linares, Maule</dd></dl><p><b>Postulaciones hasta</b><span>30/06/2026</span></p><div>Sueldo: <i>$ 900.000</i></div>
    <ul><li>Tipo contrato</li><li>Planta</li></ul><div class="job-description-x">Funciones del cargo de analista
    Funciones del cargo de analista
    --- 
    Llevar la contabilidad del servicio y preparar informes.</div></main>"""
    details = spark.createDataFrame([("https://e.trabajando.cl/oferta/1234567", page), ("https://e.trabajando.cl/oferta/7654322", "<h1>Postular</h1>")], "url string, html string")
    out = P.with_details(offers, details).collect()
    assert {r["url"][-7:] for r in out} == {"1234567"}
    r = out[0]
    assert (r["cargo"], r["institucion"], r["ciudad"], r["tipo_cargo"], str(r["fecha_cierre"]), str(r["fecha_publicacion"])) == ("Analista contable senior", "Servicio de Salud", "Linares", "planta", "2026-06-30", "2026-05-02")
    assert r["descripcion"] == "Funciones del cargo de analista\nLlevar la contabilidad del servicio y preparar informes."


def card(n, title="Cargo", extra=""):
    return f'<div class="caja row"><div id="bx_titulos">{title} {n}</div>{extra}<div id="bx_resumen"><strong>Ministerio / Servicio {n} /</strong> Resumen {n} <em>01/05/2026 - 1{n}/06/2026</em></div><a href="#">x</a><a href="/pub/convpostularavisoTrabajo.aspx?i=10{n}">ir</a></div>'


def form(n):
    return f'<form action="lista.aspx"><input type="hidden" name="__VIEWSTATE" value="v{n}"><input name="plain" value="p"><input type="text" name="no" value="x"></form>'


LIST = "https://p.cl/pub/lista.aspx"


def listing(spark):
    post = {"__VIEWSTATE": "v2", "plain": "p", "__EVENTTARGET": "grid", "__EVENTARGUMENT": "Page$3"}
    rows = [
        ("p", "GET", LIST, {}, card(1) + card(2) + '<a href="?pag=2">Siguiente</a>', True), ("p", "GET", LIST + "?pag=2", {}, form(2) + card(2) + card(3, "Solo Difusión", "<h3>Auditor</h3>") + "<a href=\"javascript:__doPostBack('grid','Page$3')\">3</a>", False),
        ("p", "POST", LIST, post, card(4) + f'<a rel="next" href="{LIST}?pag=4">mas</a>', False), ("p", "GET", LIST + "?pag=4", {}, card(4) + '<a href="?pag=5">next</a>', False), ("p", "GET", LIST + "?pag=5", {}, card(5), False),
        ("q", "GET", "https://q.cl/", {}, card(7) + '<a href="/">></a>', True), ("r", "GET", "https://r.cl/", {}, "<p>nada</p>", True),
    ]
    return spark.createDataFrame(rows, "portal string, method string, url string, data map<string,string>, html string, started boolean")


def test_chain_carries_post_backs_and_stops(spark):
    """Page 4 lists what page 3 did, so the chain ends before it; q leads to itself, r lists nothing."""
    items = F.transform(F.filter(F.col("page")["nodes"], lambda n: M.attr(n, "id") == "bx_titulos"), lambda n: M.said(F.col("page"), n))
    got = sorted((r["portal"], r["turn"], r["url"]) for r in P.chained(listing(spark), items).collect())
    assert got == [("p", 1, LIST), ("p", 2, LIST + "?pag=2"), ("p", 3, LIST), ("q", 1, "https://q.cl/")]


def test_cards_and_details_of_a_portal(spark):
    cards = P.listed_cards(listing(spark))
    got = sorted((r["portal"], r["turn"], r["cargo"], r["institucion"], r["descripcion"], str(r["fecha_publicacion"]), str(r["fecha_cierre"]), r["externo"]) for r in cards.collect())
    assert got == [
        ("p", 1, "Cargo 1", "Servicio 1", "Resumen 1", "2026-05-01", "2026-06-11", "101"), ("p", 1, "Cargo 2", "Servicio 2", "Resumen 2", "2026-05-01", "2026-06-12", "102"), ("p", 2, "Auditor", "Servicio 3", "Resumen 3", "2026-05-01", "2026-06-13", "103"),
        ("p", 3, "Cargo 4", "Servicio 4", "Resumen 4", "2026-05-01", "2026-06-14", "104"), ("q", 1, "Cargo 7", "Servicio 7", "Resumen 7", "2026-05-01", "2026-06-17", "107"),
    ]
    at = lambda n: f"https://p.cl/pub/convpostularavisoTrabajo.aspx?i=10{n}"
    inner = """<div id="lblAvisoTrabajoDatos"><h3>Convocatoria</h3>Profesional de planta<h3>Institución</h3>Ministerio / Hospital<h3>Región</h3>Maule<h3>Ciudad</h3>Talca<h3>Tipo de Vacante</h3>Contrata</div>
    <div id="lblFunciones"><h4>Objetivo del cargo</h4><p>Dirigir</p><h4>Funciones del cargo</h4><ul><li>Uno</li><li>Dos</li></ul></div><div id="lblFormacion"><h4>Formación</h4>Título</div><div id="lblRenta"><h4>Renta</h4>$ 1.200.000, grado 9</div>
    <table><tr><th>Etapa</th><th>Fechas</th></tr><tr><td>Difusión y Postulación</td><td>02/05/2026 - 20/06/2026</td></tr></table><a href="/privacidad/bases.pdf">Privacidad</a><a href="/otro.pdf">Documento</a><a href="/perfil.pdf">Perfil</a><a href="/b.aspx">Bases</a>"""
    details = spark.createDataFrame([(at(1), '<iframe id="ifFicha" src="avisopizarronficha.aspx?i=1"></iframe>'), ("https://p.cl/pub/avisopizarronficha.aspx?i=1", inner), (at(2), "<p>sin datos</p><a href='/x.pdf'>Anexo</a>")], "url string, html string")
    rows = {r["externo"]: r for r in P.with_portal_details(cards.where("portal = 'p'"), details).collect()}
    r = rows["101"]
    assert (r["cargo"], r["institucion"], r["ciudad"], r["tipo_contrato"], r["descripcion"], r["requisitos"], r["renta_min"], r["grado"], str(r["fecha_publicacion"]), str(r["fecha_cierre"]), r["url_bases"]) == (
        "Profesional de planta", "Hospital", "Talca", "contrata", "Objetivo del cargo: Dirigir\n\nFunciones del cargo: Uno Dos", "Formacion educacional: Título", 1200000, "EUS-9", "2026-05-02", "2026-06-20", "https://p.cl/b.aspx",
    )
    assert (rows["102"]["cargo"], rows["102"]["url_bases"], rows["103"]["url_bases"]) == ("Cargo 2", "https://p.cl/x.pdf", None)


def test_registered_portals_meet_their_branches(spark):
    from plazamill import registry

    sf = "/root/testdata/sf0.001"
    jobs = registry.QUERIES["x17_embedded_jobs"](spark, sf).collect()
    assert {r["title"] for r in jobs} >= {"Analista de gestión", "Médico, vacante de planta"} and "Hola" not in {r["title"] for r in jobs}
    state = registry.QUERIES["x16_state_offers"](spark, sf).collect()
    assert {r["cargo"] for r in state} >= {"Analista contable I", "Chofer a contrata"} and {r["pages"] for r in state} >= {3}


def test_registered_page_dates(spark):
    from plazamill import registry

    rows = registry.QUERIES["d06_page_dates"](spark, "/root/testdata/sf0.001").collect()
    assert "1998-05-02" in {r["publication"] for r in rows} and any(r["deadline"] or r["closing"] for r in rows)

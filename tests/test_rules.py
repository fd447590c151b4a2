"""Rules without SQL against brute force and fixed cases."""

import random
from datetime import date
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from plazamill.functions import titles as TT
from plazamill.operators import alerts as AL
from plazamill.operators import catalog as C
from plazamill.operators import evaluation as E
from plazamill.operators import page_rules as PR
from plazamill.operators import search as SR

TODAY = date(2026, 6, 1)


def test_contained_is_every_pair(spark):
    r = random.Random(3)
    texts = list({"".join(r.choice("abc ") for _ in range(r.randint(0, 14))) for _ in range(120)})
    keys = list({"".join(r.choice("abc ") for _ in range(r.randint(3, 5))) for _ in range(60)})
    got = {(x["t"], x["k"]) for x in C.contained(spark.createDataFrame([(t,) for t in texts], "t string"), spark.createDataFrame([(k,) for k in keys], "k string")).collect()}
    assert got == {(t, k) for t in texts for k in keys if k in t}


def test_name_cascade(spark):
    catalog = [(1, "Servicio de Salud Maule"), (2, "Servicio de Salud"), (3, "Municipalidad de Talca"), (4, "Hospital Regional"), (5, "Hospital  regional")]
    names = ["HOSPITAL REGIONAL", "Salud Maule", "Dirección del Servicio de Salud Ñuble", "Munisipalidad de Talka", "otra cosa", "", None, "xy"]
    norm = lambda s: " ".join(s.lower().replace("ó", "o").replace("ñ", "n").split())
    want = {}
    for n in names:
        a, hit = norm(n or ""), None
        if a:
            hit = next(((i, "exact") for i, c in catalog if norm(c) == a), None)
            if not hit and len(a) >= 3:
                hit = next(((i, "contained") for i, c in catalog if norm(c) in a or a in norm(c)), None)
            if not hit:
                best = max(catalog, key=lambda c: SequenceMatcher(None, a, norm(c[1])).ratio())
                hit = (best[0], "close") if SequenceMatcher(None, a, norm(best[1])).ratio() >= 0.8 else None
        want[n] = hit or (None, None)
    out = C.name_cascade(spark.createDataFrame([(n,) for n in names], "nombre string"), spark.createDataFrame(catalog, "id long, n string"), "nombre", "id", "n").collect()
    assert {x["nombre"]: (x["match_id"], x["stage"]) for x in out} == want and want["Munisipalidad de Talka"] == (3, "close")


def test_alert_matches_are_every_pair(spark):
    r = random.Random(5)
    word = lambda: r.choice(["salud", "planta", "maule", "a", "ta", "auditor", ""])
    subs = [(i, r.choice([None, "", word(), word().upper()]), r.choice([None, word()])) for i in range(60)]
    offers = [(i, " ".join([word(), word()]), r.choice([None, word() + " " + word()]), r.choice([None, "Maule", "Talca"]), i % 7) for i in range(80)]
    has = lambda want, *texts: not (want or "").strip() or any(want.strip().lower() in (t or "").lower() for t in texts)
    want = set()
    for s, region, term in subs:
        hits = sorted((-n, o) for o, a, b, c, n in offers if has(region, c) and has(term, a, b))[:5]
        want |= {(s, o, i + 1) for i, (_, o) in enumerate(hits)}
    sf = spark.createDataFrame(subs, "sub_id long, region string, termino string")
    of = spark.createDataFrame(offers, "offer_id long, a string, b string, c string, n int")
    got = AL.matches(sf, of, {"region": ["c"], "termino": ["a", "b"]}, [F.desc("n"), F.asc("offer_id")], most=5).collect()
    assert {(x["sub_id"], x["offer_id"], x["pos"]) for x in got} == want


def brute_search(rows, query, limit):
    def near(word, term, last):
        if last and word.startswith(term):
            return 0
        d = [[i + j for j in range(len(term) + 1)] for i in range(len(word) + 1)]
        for i in range(1, len(word) + 1):
            for j in range(1, len(term) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (word[i - 1] != term[j - 1]))
        return d[-1][-1] if d[-1][-1] <= (2 if len(term) >= 8 else 1 if len(term) >= 4 else 0) else None

    terms, out = query.split(), []
    for i, *fields in rows:
        held = []
        for k, t in enumerate(terms):
            found = [(e, f) for f, text in enumerate(fields) for w in (text or "").split() if (e := near(w, t, k == len(terms) - 1)) is not None]
            held.append(min(found, default=None))
        if all(h is not None for h in held):
            out.append((sum(h[0] for h in held), sum(h[1] for h in held), i))
    return [(i, e, n + 1) for n, (e, _, i) in enumerate(sorted(out)[:limit])]


def test_search_against_brute_force(spark):
    r = random.Random(9)
    words = ["contador", "contadora", "auditor", "auditoria", "analista", "salud", "sal", "publico", "rural"]
    rows = [(i, " ".join(r.choice(words) for _ in range(2)), " ".join(r.choice(words) for _ in range(3))) for i in range(80)]
    frame = spark.createDataFrame(rows, "id long, cargo string, texto string")
    for query in ("auditro", "analista salu", "contdor publico", "rural sal", "nada"):
        got = [(x["id"], x["errors"], x["rank"]) for x in SR.search(frame, query, ("cargo", "texto"), 12).orderBy("rank").collect()]
        assert got == brute_search(rows, query, 12), query
    paged = [x["id"] for x in SR.search(frame, "salud", ("cargo", "texto"), 4, offset=3).orderBy("rank").collect()]
    assert paged == [i for i, _, _ in brute_search(rows, "salud", 7)][3:]
    assert SR.search(frame, "  ", ("cargo",)).count() == 0
    legal = spark.createDataFrame([(1, "Abogado", ""), (2, "Asesor jurídico", ""), (3, "Otro", "derecho")], "id long, cargo string, texto string")
    assert [x["id"] for x in SR.search(legal, "Abogado", ("cargo", "texto")).orderBy("rank").collect()] == [1, 2, 3]
    assert SR.search(legal, "abogado", ("cargo", "texto")).where("id = 1").first()["marked"] == "<mark>Abogado</mark>"


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw,want", [
    ("006AP-26 TECNICO EN ENFERMERIA", "Técnico en Enfermería"), ("2 CARGOS ADMINISTRATIVO DE RRHH", "Administrativo de RRHH"), ("Cargo: Abogado slep norte", "Abogado SLEP norte"), ("analista ,ventas;zona", "Analista, ventas; zona"), ("", ""), (None, ""),
    ("profesional e.u.s. grado 9", "Profesional E.U.S. grado 9"), ("JEFE DE GESTION", "Jefe de Gestión"),
])
def test_tidy_title(spark, raw, want):
    assert one(spark, TT.tidy_title(F.col("t")), t=raw) == want


@pytest.mark.parametrize("raw,want", [
    ("Corto", "Corto"), ("Profesional de apoyo a la gestión - Departamento de Administración y Finanzas de la Municipalidad", "Profesional de apoyo a la gestión"),
    ("Se requiere contratar al Dr. Juan Pérez como asesor del gabinete municipal. Enviar antecedentes a la oficina central", "Se requiere contratar al Dr. Juan Pérez como asesor del gabinete municipal"),
    ("Llamado a concurso para proveer cargo en grado E.U.S. nueve del escalafon profesional municipal de la comuna norte", "Llamado a concurso para proveer cargo en grado E.U.S. nueve del escalafon profesional…"),
    ("x" * 100, "x" * 90 + "…"),
])
def test_short_title(spark, raw, want):
    assert one(spark, TT.short_title(F.col("t")), t=raw) == want


@pytest.mark.parametrize("raw,want", [
    ("Publicado el 1 de mayo de 2026. Recepción de antecedentes hasta 20/06/2026", "2026-06-20"), ("Plazo hasta: 5-7-26, luego nada", "2026-07-05"), ("Cierre de postulación viernes 19 de junio de 2026", "2026-06-19"), ("Desde el 3 de julio se atiende", "2026-07-03"),
    ("hasta el 31/02/2026, vence 30/06/2026", "2026-06-30"), ("sin fecha", None), (None, None),
])
def test_post_closing_date(spark, raw, want):
    assert one(spark, TT.post_closing_date(F.col("t"), F.lit(TODAY)).cast("string"), t=raw) == want


def test_dates_of_a_page(spark):
    """JSON-LD beats meta, meta beats time tags, those beat labelled text; of equals the earliest counts. A numeric
    date within the 120 characters of a label goes before one in words."""
    cases = {
        '<meta property="article:published_time" content="2026-05-02T10:00"><time datetime="2026-05-09">x</time> Publicado el 03/05/2026': ("2026-05-02", None, None),
        '<script type="application/ld+json">{"@graph": [{"datePosted": "2026-05-04", "validThrough": "2026-07-01", "other": {"datePosted": "2020-01-01"}}]}</script><meta name="applicationDeadline" content="2026-08-01">': ("2026-05-04", None, "2026-07-01"),
        '<script type="application/ld+json">[{"closingDate": "30/06/2026"}, {"closingDate": "20/06/2026"}]</script>': (None, "2026-06-20", None),
        "<time>10 de mayo</time> Fecha de cierre: 15 de julio. Postulaciones hasta 12/07/2026 o hasta el 10/07/2026": ("2026-05-10", "2026-07-12", "2026-07-10"),
        '<script type="application/ld+json">{rota</script>': (None, None, None), "": (None, None, None),
    }
    rows = spark.createDataFrame([(i, h) for i, h in enumerate(cases)], "id int, html string")
    d = E.dates(F.col("html"), E.visible(F.col("html")), F.lit(TODAY))
    got = {x["id"]: (x["p"], x["c"], x["d"]) for x in rows.select("id", d.alias("d")).selectExpr("id", "string(d.publication) p", "string(d.closing) c", "string(d.deadline) d").collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_evaluation_cascade(spark):
    page = "<html><head><title>{t}</title></head><body>{b}</body></html>"
    rows = [
        (1, None, "https://muni.cl/concursos", 200, None, page.format(t="Concurso", b="<h1>Cargo</h1><p>Concurso público: bases, requisitos y funciones, vacante a contrata. Postulaciones hasta el 20/06/2026</p><a href=\"/bases.pdf\">bases</a>")),
        (2, None, "https://muni.cl/noticias/1", 200, None, page.format(t="Noticia", b="<p>Taller y feria, beneficio y actividad</p>")),
        (3, "WordPress", "https://muni.cl/a", 200, None, page.format(t="Aviso", b="<article>wp-content proceso cerrado, nómina de seleccionados</article>")),
        (4, None, "https://x.trabajando.cl/o", 200, None, page.format(t="x", b="<p>vacante</p>")), (5, None, "https://muni.cl/x", 403, None, "Access denied"), (6, None, "https://muni.cl/y", None, "timeout", None),
        (7, None, "https://www.empleospublicos.cl/z", 200, None, page.format(t="Portal", b="<p>hola</p>")),
    ]
    frame = spark.createDataFrame([(i, p, u, u, s, e, "text/html", None, h) for i, p, u, s, e, h in rows], "id long, platform string, url string, final_url string, status int, error string, content_type string, headers string, html string")
    got = {x["id"]: x for x in E.evaluate(frame, TODAY).collect()}
    assert (got[1]["decision"], got[1]["page_type"], got[1]["relevance"], str(got[1]["deadline"])) == ("extract", "detail_page", "mixed", "2026-06-20")  # "concurso" holds "curso"
    assert (got[2]["page_type"], got[2]["relevance"], got[2]["decision"], got[2]["open_calls"]) == ("news_page", "non_job", "skip", "no_calls_found")
    assert (got[3]["profile"], got[3]["page_type"], got[3]["validity"]) == ("wordpress", "wordpress_post", "expired_confirmed")
    assert (got[4]["page_type"], got[4]["extractor"]) == ("ats_external", "scraper_external_ats")
    assert (got[5]["availability"], got[5]["decision"], got[5]["confidence"]) == ("blocked_by_bot_protection", "source_status_only", 0.0)
    assert (got[6]["availability"], got[6]["reason"]) == ("timeout", "timeout")
    assert (got[7]["profile"], got[7]["extractor"], got[7]["decision"]) == ("empleos_publicos", "scraper_empleos_publicos", "extract") and got[7]["confidence"] >= 0.8
    noisy = {x["id"]: x for x in E.evaluate(frame, TODAY, noise=F.lit(0.6)).collect()}
    assert noisy[1]["confidence"] == pytest.approx(got[1]["confidence"] - 0.15) and "historical_noise_penalty" in noisy[1]["signals"]


def test_page_pipeline_and_another_judge(spark):
    body = "Concurso público. Se requiere contratar. Requisitos:\nTítulo de contador público\nFunciones:\nLlevar la contabilidad\nRenta bruta mensual $ 1.200.000, contrata, jornada completa. Postulaciones hasta el 20/07/2026 vigente. Enviar antecedentes a rrhh@muni.cl"
    rows = [(1, "Cargo: Contador", body, "https://muni.cl/concursos/1", 200), (2, "Noticias", "Comunicado de prensa", "https://muni.cl/noticias/2", 200), (3, "x", body, "https://muni.cl/a", 404), (4, "Cargo: Contador", body.replace("20/07/2026", "20/01/2026"), "https://muni.cl/concursos/4", 200), (5, None, None, None, None)]
    frame = spark.createDataFrame([(i, t, None, None, b, None, None, u, s) for i, t, b, u, s in rows], "id int, title string, crumbs string, hint string, body string, tables string, attachments string, url string, http_status int").withColumns({"files": F.array(F.lit("https://muni.cl/bases.pdf")), "headings": F.array(F.lit("Llamado abierto"))})
    got = {x["id"]: x for x in PR.pipeline(frame, TODAY).collect()}
    assert got[1]["rejected"] is None and (got[1]["job_title"], got[1]["amount"], got[1]["contract"], got[1]["workday"], str(got[1]["ends"])) == ("Contador", 1_200_000, "contrata", "completa", "2026-07-20")
    assert got[1]["functions"] == ["Llevar la contabilidad"] or "Llevar la contabilidad" in got[1]["functions"]
    assert got[2]["rejected"] and got[3]["rejected"] == "http_status=404" and got[4]["rejected"] == "application_end_at_in_past" and got[5]["rejected"]
    never = lambda title, preview: F.struct(F.lit(False).alias("is_job"), F.lit("event").alias("kind"), F.lit(0.9).alias("confidence"), F.array().cast("array<string>").alias("for_job"), F.array(F.lit("no")).alias("against"))
    asked = PR.resolved(frame, TODAY, judge=never, accept=2.0, unclear=0.0).where("asked").collect()
    assert asked and all(x["kind"] == "event" and "no" in x["misses"] for x in asked)

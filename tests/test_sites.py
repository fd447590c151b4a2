"""Parsers of fetched payloads, spreadsheets and streams, on fixed inputs."""

import json
import zipfile

from pyspark.sql import functions as F

from plazamill.functions import lookups as L
from plazamill.sources import records, sites
from plazamill.streaming import state


def post(title, body="texto largo del aviso", link="https://m.cl/p"):
    return {"title": {"rendered": title}, "content": {"rendered": body}, "date": "2026-05-01T00:00:00", "link": link}


def test_wordpress_windows_pages_and_gate(spark):
    full = [post(f"Taller {i}", link=f"https://m.cl/t{i}") for i in range(20)]
    rows = [
        (1, 180, 1, json.dumps(full), "https://m.cl"), (1, 180, 2, json.dumps([post("Acta")]), "https://m.cl"), (1, 180, 3, json.dumps([post("Concurso público nunca leído", link="https://m.cl/tarde")]), "https://m.cl"),
        (1, None, 1, json.dumps([post("<b>Enfermera</b> CESFAM", '<p>x <a href="/docs/bases.pdf">b</a></p>', "https://m.cl/e"), post("Enfermera otra vez", link="https://m.cl/e")]), "https://m.cl"), (1, 365, 1, json.dumps([post("Abogado", link="https://m.cl/a")]), "https://m.cl"),
        (2, 180, 1, json.dumps([post("Chofer", link=""), post("Chofer", link="")]), "https://n.cl"), (3, 180, 1, "no es json", "https://o.cl"),
    ]
    out = sites.wordpress_posts(spark.createDataFrame(rows, "source_id int, days int, page int, payload string, site string")).collect()
    assert sorted((x["source_id"], x["title"], x["url"]) for x in out) == [(1, "Enfermera CESFAM", "https://m.cl/e"), (2, "Chofer", "")]
    assert next(x["pdfs"] for x in out if x["source_id"] == 1) == ["https://m.cl/docs/bases.pdf"]


def test_feed_takes_the_first_slug_with_items(spark):
    item = lambda t, u: {"title": t, "content_html": "<p>a</p>", "url": u, "date_published": "2026-01-01"}
    rows = [(1, 0, json.dumps({"items": []})), (1, 1, json.dumps({"items": [item("Uno", "https://m/1"), item("Uno bis", "https://m/1"), item("Dos", "")]})), (1, 2, json.dumps({"items": [item("Tres", "https://m/3")]})), (2, 0, "{")]
    out = sites.feed_items(spark.createDataFrame(rows, "source_id int, slug_order int, payload string")).collect()
    assert sorted((x["title"], x["url"]) for x in out) == [("Dos", None), ("Uno", "https://m/1")]


def test_cards(spark):
    html = '<div class="jobs__card"><h3 class="job__card-name">Ingeniero Senior Depto Ingeniero Senior</h3><a href="/jobs/1">ver</a><p class="jobs__card-info">Talca, Región del Maule</p></div><div class="jobs__card x"><h3>Sin enlace</h3></div><div class="jobs__card"><h2>Analista</h2><a href="https://b.cl/2">v</a></div>'
    other = '<li class="job item"><h2>Guardia</h2><a href="g">v</a></li>'
    out = sites.job_cards(spark.createDataFrame([(1, "https://e.buk.cl/trabajos", html), (2, "https://o.cl/lista/", other), (3, "https://p.cl", "<p>nada</p>")], "source_id int, url string, html string")).collect()
    assert sorted((x["source_id"], x["title"], x["url"], x["info"]) for x in out) == [(1, "Analista", "https://b.cl/2", None), (1, "Ingeniero Senior", "https://e.buk.cl/jobs/1", "Talca, Región del Maule"), (2, "Guardia", "https://o.cl/lista/g", None)]


def test_pdf_postings(spark):
    html = '<a href="/d/politica.pdf">Política</a><a href="/d/Bases_concurso%202026.pdf"></a><li><a class="x" href="/d/p.pdf">Perfil del cargo</a></li><a href="/d/p.pdf">Perfil otra vez</a>'
    out = sites.pdf_postings(spark.createDataFrame([(1, "https://m.cl/t/", html)], "source_id int, url string, html string")).collect()
    assert sorted((x["title"], x["url"]) for x in out) == [("Bases concurso 2026", "https://m.cl/d/Bases_concurso%202026.pdf"), ("Perfil del cargo", "https://m.cl/d/p.pdf")]
    links = spark.createDataFrame([(["a/otro.pdf", "a/TDR.pdf", "a/bases.pdf", "a/perfil.pdf"],)], "l array<string>")
    assert links.select(sites.by_relevance(F.col("l"))).first()[0] == ["a/bases.pdf", "a/perfil.pdf", "a/TDR.pdf", "a/otro.pdf"]


def test_court_calls(spark):
    html = "<div><p>Portada</p><p>LLAMA A CONCURSO para el cargo de juez titular</p><p>Corte de Apelaciones de Talca, región de Maule.</p><p>Plazo 30/06/2026</p><script>cargo cargo cargo cargo cargo</script><p>cargo corto</p></div>"
    out = sites.court_calls(spark.createDataFrame([(1, "https://j.cl/c", html)], "source_id int, url string, html string"), lambda c: L.longest_key(c, L.REGIONS)).collect()
    assert [(x["title"], x["body"], str(x["closes"])) for x in out] == [("LLAMA A CONCURSO para el cargo de juez titular", "Portada LLAMA A CONCURSO para el cargo de juez titular Corte de Apelaciones de Talca, región de Maule. Plazo 30/06/2026 cargo corto", "2026-06-30")]
    assert out[0]["url"].startswith("https://j.cl/c#oferta-")


def test_spreadsheets(spark, tmp_path):
    ods = """<office:document-content xmlns:office="o" xmlns:table="t" xmlns:text="x"><table:table table:name="otra"/><table:table table:name="ofertas">
    <table:table-row><table:table-cell><text:p>id</text:p></table:table-cell><table:table-cell><text:p>cargo</text:p></table:table-cell><table:table-cell><text:p>estado</text:p></table:table-cell></table:table-row>
    <table:table-row><table:table-cell><text:p>1</text:p></table:table-cell><table:table-cell table:number-columns-repeated="2"><text:p>x</text:p><text:p>y</text:p></table:table-cell><table:table-cell table:number-columns-repeated="16000"/></table:table-row>
    <table:table-row><table:table-cell table:number-columns-repeated="3"/></table:table-row><table:table-row><table:table-cell><text:p>2</text:p></table:table-cell></table:table-row></table:table></office:document-content>"""
    with zipfile.ZipFile(tmp_path / "h.ods", "w") as z:
        z.writestr("content.xml", ods)
    out = records.spreadsheet(spark, str(tmp_path / "h.ods"), ["id", "cargo", "estado"], sheet="ofertas").collect()
    assert sorted(map(tuple, out)) == [("1", "x y", "x y"), ("2", "", "")]
    cell = lambda r, t, s=False: f'<c r="{r}"{" t=" + chr(34) + "s" + chr(34) if s else ""}><v>{t}</v></c>'
    sheet = f'<worksheet xmlns="m"><sheetData><row r="1">{cell("A1", 0, True)}</row><row r="4">{cell("A4", 1, True)}{cell("C4", 2, True)}</row><row r="5">{cell("A5", 7)}{cell("C5", 3, True)}</row><row r="6"></row><row r="7">{cell("C7", 3, True)}</row></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "c.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="m"><si><t>Título</t></si><si><t>ID</t></si><si><t> Nombre </t></si><si><r><t>Ñu</t></r><r><t>ble</t></r></si></sst>')
    out = records.spreadsheet(spark, str(tmp_path / "c.xlsx"), ["id", "nombre"], header=4, rename={"ID": "id", "Nombre": "nombre"}).collect()
    assert sorted(map(tuple, out)) == [("", "Ñuble"), ("7", "Ñuble")]


def test_sinks_fail_alone(spark, tmp_path):
    rows = spark.createDataFrame([(1, "extract", "2026-01-01")], "institucion_id int, decision string, evaluated_at string")
    broken = rows.select(F.raise_error(F.lit("roto")).cast("string").alias("x"))
    said = records.append_each({"a": (rows, str(tmp_path / "a")), "b": (broken, str(tmp_path / "b")), "c": (rows, str(tmp_path / "c"))})
    assert said["a"] is None and said["c"] is None and said["b"]
    assert spark.read.parquet(str(tmp_path / "c")).count() == 1 and records.last_success(rows).first()["evaluated_at"] == "2026-01-01"


def test_zero_streak_stream(spark, tmp_path):
    days = [[(1, 1, True, 0, False), (2, 1, True, 3, False)], [(1, 2, True, 0, False), (1, 3, False, 0, False), (2, 2, True, 0, False)], [(1, 4, True, 0, True), (2, 3, True, 0, True), (2, 4, True, 2, False)], [(1, 5, True, 0, False), (1, 2, True, 5, False)]]
    schema = "institucion_id long, d int, extracted boolean, found int, bypass boolean"
    for i, rows in enumerate(days):
        f = spark.createDataFrame(rows, schema).withColumn("evaluated_at", F.expr("timestamp '2026-01-01 00:00:00' + make_interval(0, 0, 0, d)")).drop("d")
        f.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(f.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    held = []
    q = state.zero_streaks(stream).writeStream.outputMode("update").foreachBatch(lambda b, e: held.extend(map(tuple, b.select("institucion_id", "ceros", "desvio_usado").collect()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {i: (n, u) for i, n, u in held}
    assert last == {1: (4, True), 2: (0, False)}

"""The markup tree, the JSON walk and the listings read off them, against plain Python over html.parser."""

import json
import random
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from plazamill.functions import json_walk as J
from plazamill.functions import policy_lists as PL
from plazamill.plans import sites as PS
from plazamill.sources import listings as LS
from plazamill.sources import markup as M

SF = "/root/testdata/sf0.001"


class Node:
    def __init__(self, tag, attrs, up):
        self.tag, self.attrs, self.up, self.parts = tag, attrs, up, []

    def walk(self):
        for x in self.parts:
            if isinstance(x, Node):
                yield x
                yield from x.walk()

    def strings(self):
        for x in self.parts:
            if isinstance(x, str):
                if self.tag not in ("script", "style"):
                    yield x
            else:
                yield from x.strings()

    def text(self, sep=" "):
        return " ".join(sep.join(self.strings()).split())

    def above(self, *tags):
        up = self.up
        while up and up.tag not in tags:
            up = up.up
        return up

    @property
    def classes(self):
        return (self.attrs.get("class") or "").split()


class Dom(HTMLParser):
    """A tree of well-formed markup."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.root = self.now = Node(None, {}, None)
        self.feed(html or "")
        self.close()

    def handle_starttag(self, tag, attrs):
        node = Node(tag, dict(attrs), self.now)
        self.now.parts.append(node)
        if tag not in M.VOID:
            self.now = node

    def handle_endtag(self, tag):
        if tag not in M.VOID:
            assert self.now.tag == tag
            self.now = self.now.up

    def handle_data(self, data):
        self.now.parts.append(data)


def well_formed(r, depth=0):
    tags = ["div", "ul", "li", "p", "b", "a", "table", "tr", "td", "h2", "article", "section", "span", "script", "img", "h1"]
    words = ["Concurso p&uacute;blico", "cargo", "bases &amp; requisitos", "uno", "\n", " ", "contrata", "taller", "vacante, postulaci&#243;n hasta 3/4/1998", "&nbsp;", "renta $ 900.000", "planta", "cerrado", "vigente"]
    out = []
    for _ in range(r.randint(1, 4)):
        if depth > 5 or r.random() < 0.45:
            out.append(r.choice(words) + " ")
            continue
        tag = r.choice([t for t in tags if t != "p"]) if depth else r.choice(tags)
        attrs = r.choice(["", " class='card'", ' class="title x"', " class=date", ' href="/a/%d"' % r.randint(0, 9), " href='/d/bases%d.pdf'" % r.randint(0, 9), " href=https://otro.cl/x", ' href="#x"', " datetime='1998-05-01'"])
        if tag == "img":
            out.append(f"<img{attrs}>")
        elif tag == "script":
            out.append("<script>var a = '<b>cargo</b>';</script>")
        elif tag == "table":
            out.append("<table>" + "".join(f"<tr{attrs}><td>{flat(r, words, tag)}</td><td>{r.choice(words)}</td></tr>" for _ in range(2)) + "</table>")
        elif tag in ("li", "tr", "td", "p", "ul", "h1", "h2", "section", "article"):
            out.append(f"<{tag}{attrs}>{flat(r, words, tag)}</{tag}>")
        else:
            out.append(f"<{tag}{attrs}>{well_formed(r, depth + 1)}</{tag}>")
    return "".join(out)


def flat(r, words, tag):
    inner = "".join(r.choice(words) + " " for _ in range(r.randint(0, 4)))
    link = r.choice(["", '<a href="/c/%d">Cargo de concurso</a>' % r.randint(0, 9), "<a href=b/%d.pdf>bases</a>" % r.randint(0, 9), "<b>contrata planta</b>", "" if tag == "p" else "<h3>Cargo <a href=/z>abogado vacante</a></h3>"])
    return inner + link + r.choice(words)


PAGES = [(i, "https://m.cl/lista/", "<body>" + "".join(well_formed(random.Random(100 * i + k)) for k in range(6)) + "</body>") for i in range(40)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([*PAGES, (900, "https://m.cl/", None), (901, "https://m.cl/", "")], "source_id int, url string, html string").withColumn("hosts", F.array(F.lit("m.cl"))).withColumn("name", F.lit("Municipalidad de Talca")).repartition(3)


def test_tree_of_well_formed_pages_is_the_plain_tree(pages):
    t = F.col("t")
    shown = F.transform(t["nodes"], lambda n: F.struct(n["tag"], n["classes"], M.attr(n, "href"), M.said(t, n), M.joined(t, n), F.get(t["nodes"], n["parent"])["tag"], M.up(t, n, lambda x: x["tag"].isin("li", "div", "body"))["tag"], (n["last"] - n["at"])))
    for r in pages.where("html IS NOT NULL").withColumn("t", M.tree(F.col("html"))).select("html", shown.alias("nodes"), M.said(t).alias("said"), M.text(F.col("html")).alias("text"), M.hrefs(t).alias("hrefs")).collect():
        root = Dom(r["html"]).root
        up = lambda n: (n.above("li", "div", "body") or n.up).tag
        want = [(n.tag, n.classes, n.attrs.get("href"), n.text(), n.text(""), n.up.tag, up(n) if n.above("li", "div", "body") else None, sum(1 for _ in n.walk())) for n in root.walk()]
        assert [tuple(x) for x in r["nodes"]] == want
        assert r["said"] == r["text"] == root.text()
        assert r["hrefs"] == [n.attrs["href"] for n in root.walk() if n.tag == "a" and n.attrs.get("href") is not None]


@pytest.mark.parametrize("html, want", [
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", [("ul", None), ("li", "ul"), ("li", "ul"), ("ul", "li"), ("li", "ul"), ("li", "ul")]),
    ("<table><tr><td>1<td>2<tr><td><table><tr><td>x</table>3</table>", [("table", None), ("tr", "table"), ("td", "tr"), ("td", "tr"), ("tr", "table"), ("td", "tr"), ("table", "td"), ("tr", "table"), ("td", "tr")]),
    ("<p>a<p>b<div>c</div></p>d</i><br/>e<dl><dt>x<dd>y<dt>z</dl>", [("p", None), ("p", None), ("div", None), ("br", None), ("dl", None), ("dt", "dl"), ("dd", "dl"), ("dt", "dl")]),
    ("<div><p><b>x<br><p>y</div><h1>z", [("div", None), ("p", "div"), ("b", "p"), ("br", "b"), ("p", "div"), ("h1", None)]),
])
def test_missing_end_tags_are_implied(spark, html, want):
    rows = {r["at"]: r for r in M.node_rows(spark.createDataFrame([(html,)], "html string")).collect()}
    assert [(rows[i]["tag"], rows[rows[i]["parent"]]["tag"] if rows[i]["parent"] >= 0 else None) for i in sorted(rows)] == want


def test_references_and_quotings(spark):
    html = "<title> Recepci&oacute;n&nbsp;de &lt;antecedentes&gt; </title><a href='/x?a=1&amp;b=2'>1</a><a href=/y>2</a><a HREF=\"/z\">3</a><a>4</a><style>p{}</style><script>a<b</script><!-- no -->"
    t = F.col("t")
    r = spark.createDataFrame([(html,)], "h string").withColumn("t", M.tree(F.col("h"))).select(M.title(t), M.hrefs(t), M.said(t), M.scripts(t), M.count(t, "a", "style")).first()
    assert tuple(r) == ("Recepción de <antecedentes>", ["/x?a=1&b=2", "/y", "/z"], "Recepción de <antecedentes> 1 2 3 4", ["a<b"], 5)


def test_node_rows_hold_own_text(spark):
    rows = M.node_rows(spark.createDataFrame([(7, "<div>a<b>b</b>c<i>d<u>e</u></i></div>")], "k int, html string")).collect()
    assert [(r["k"], r["tag"], r["own_text"], r["depth"]) for r in sorted(rows, key=lambda r: r["at"])] == [(7, "div", "a c", 0), (7, "b", "b", 1), (7, "i", "d", 1), (7, "u", "e", 2)]


def test_json_walk_at_any_depth(spark):
    r = random.Random(5)

    def made(depth):
        if depth == 0 or r.random() < 0.2:
            return r.choice([1, "x", None, True, '}"{', "[", 2.5])
        return {r.choice("abcdef") + str(i): made(depth - 1) for i in range(r.randint(0, 3))} if r.random() < 0.5 else [made(depth - 1) for _ in range(r.randint(0, 3))]

    def walk(x):
        if isinstance(x, dict):
            yield x
            for k in sorted(x):
                yield from walk(x[k])
        elif isinstance(x, list):
            for y in x:
                yield from walk(y)

    values = [made(7) for _ in range(40)] + [json.loads("[" * 30 + '{"deep": {}}' + "]" * 30)]
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)] + [(100, "{"), (101, None), (102, "")], "i int, j string")
    got = {x["i"]: [json.loads(o) for o in x["o"]] for x in rows.select("i", F.transform(J.objects(F.col("j")), lambda v: F.to_json(v)).alias("o")).collect()}
    assert got == {**{i: list(walk(v)) for i, v in enumerate(values)}, 100: [], 101: [], 102: []}


# --- listings in plain Python


def fold(text):
    table = str.maketrans("áéíóúüñçÁÉÍÓÚÜÑ", "aeiouuncAEIOUUN")
    return re.sub("[^\x00-\x7f]", "", (text or "").translate(table)).lower().strip()


def looks(title, content, url):
    both = " ".join(f"{title} {content}".split())
    b, u = fold(both), fold(url)
    hits = sum(w in b for w in dict.fromkeys(PL.POSITIVE))
    any_of = lambda patterns, x: any(re.search(p, x) for p in patterns)
    inside = any_of(PL.INTERNAL, b)
    score = min(0.75, 0.1 * hits) - 0.45 * any_of(PL.NEGATIVE_URL, u) - 0.35 * any_of(PL.NEGATIVE, b) - 0.6 * inside - 0.25 * (len(b) < 8)
    return len(both) >= 8 and round(score, 4) >= 0.2 and hits > 0 and not inside


def full(href, base="https://m.cl/lista/"):
    from urllib.parse import urljoin

    return urljoin(base, href)


def crop(text):
    return text if len(text) <= 180 else text[:177].rstrip() + "..."


def allowed(url):
    return url.startswith("https://m.cl/") or url.lower().endswith(".pdf")


def papers(links, words, everywhere=False):
    urls = [full(a.attrs["href"]) for a in links if ".pdf" in a.attrs["href"].lower() or any(w in a.text().lower() for w in words)]
    return list(dict.fromkeys(u for u in urls if everywhere or allowed(u)))


def links_of(node):
    return [a for a in node.walk() if a.tag == "a" and a.attrs.get("href") is not None]


def once(found):
    seen, out = set(), []
    for x in sorted(found, key=lambda x: (x[0], x[1])):
        if (key := x[4] or x[2]) and key not in seen:
            seen.add(key)
            out.append(x)
    return out


def heading_link(node, heads, classes):
    def titled(a):
        up = a.up
        while up:
            if up.tag in heads or set(up.classes) & set(classes):
                return True
            up = up.up
        return False

    return next((a for a in node.walk() if a.tag == "a" and (a.attrs.get("href") is not None or titled(a))), None)


def plain_candidates(html):
    root, base, out = Dom(html).root, "https://m.cl/lista/", []
    at = {id(n): i for i, n in enumerate(root.walk())}
    for n in root.walk():
        if n.tag in ("article", "li", "section") or n.tag == "div" and set(n.classes) & set(LS.CONTAINERS):
            link, content = heading_link(n, LS.HEADINGS, ("title", "job-title")), n.text()
            href = link.attrs.get("href") or "" if link else ""
            date = next((x for x in n.walk() if x.tag == "time" and "datetime" in x.attrs or set(x.classes) & {"date", "fecha", "entry-date"}), None)
            if looks("", content, base) and (not href or allowed(full(href))):
                out.append((1, at[id(n)], (link.text() if link else "") or crop(content), content, full(href), (date.attrs.get("datetime") or date.text() or None) if date else None, None, papers(links_of(n), LS.SITE_PDF)))
        if n.tag == "tr" and n.above("table"):
            link, content = next(iter(links_of(n)), None), n.text()
            href = link.attrs["href"] if link else ""
            if looks("", content, base) and (not href or allowed(full(href))):
                out.append((2, at[id(n)], (link.text() if link else content) or crop(content), content, full(href), None, None, papers(links_of(n), LS.SITE_PDF)))
        if n.tag == "a" and n.attrs.get("href") and not n.attrs["href"].startswith(("#", "mailto:", "tel:", "javascript:")):
            title, block, url = n.text(), n.above(*LS.PARENTS), full(n.attrs["href"])
            content = block.text() if block else title
            if allowed(url) and len(title) >= 6 and title.lower() not in LS.NAVIGATION and not title.replace(" ", "").isdigit() and looks(title, content, url):
                out.append((3, at[id(n)], title, content, url, None, None, [url] if ".pdf" in n.attrs["href"].lower() else []))
    return once(out)


def by_source(rows, *names):
    out = {}
    for r in sorted(rows, key=lambda r: (r["source_id"], r["kind"], r["at"])):
        out.setdefault(r["source_id"], []).append(tuple(r[n] for n in names))
    return out


FIELDS = ("kind", "at", "title", "content", "url", "date_value", "closing_value", "pdfs")


def test_site_candidates_are_the_plain_ones(pages):
    got = by_source(LS.site_candidates(pages).collect(), *FIELDS)
    want = {i: found for i, _, html in PAGES if (found := plain_candidates(html))}
    assert got == want
    assert {x[0] for found in want.values() for x in found} == {1, 2, 3}


def plain_blog(html):
    from plazamill.functions import tables as TB

    def gate(title, body):
        t, b = (" ".join(re.sub("", "", fold_all(x)).split()) for x in (title, body))
        if len(" ".join(f"{title} {body}".split())) < 8 or any(w in t for w in TB.WP_TITLE_REJECT):
            return False
        return any(w in t for w in TB.WP_TITLE_JOB) or sum(w in b for w in ("concurso", "cargo", "postulacion", "seleccion", "contrata", "planta")) >= 2

    def fold_all(x):
        return x.translate(str.maketrans("áéíóúüñç", "aeiouunc")).lower()

    root, out = Dom(html).root, []
    at = {id(n): i for i, n in enumerate(root.walk())}
    for n in root.walk():
        if n.tag == "article" or n.tag == "div" and set(n.classes) & {"post", "type-post", "entry", "blog-item"} or n.tag == "li" and "post" in n.classes:
            link, content = heading_link(n, LS.HEADINGS[:3], ("entry-title",)), n.text()
            title = link.text() if link else ""
            date = next((x for x in n.walk() if x.tag == "time" and "datetime" in x.attrs or "entry-date" in x.classes), None)
            if gate(title, content):
                out.append((1, at[id(n)], title or crop(content), content, full(link.attrs.get("href") or "" if link else ""), (date.attrs.get("datetime") or date.text() or None) if date else None, None, papers(links_of(n), ("bases",), True)))
    if not out:
        for a in links_of(root):
            block, title, url = a.above("li", "p", "div", "article", "section"), a.text(), full(a.attrs["href"].strip())
            content = (block.text() if block else title) or ""
            if gate(title, content):
                out.append((3, at[id(a)], title or crop(content), content, url, None, None, [url] if ".pdf" in a.attrs["href"].lower() else []))
    return once(out)


def test_blog_listing_is_the_plain_one(pages):
    got = by_source(LS.blog_listing(pages).collect(), *FIELDS)
    want = {i: found for i, _, html in PAGES if (found := plain_blog(html))}
    assert got == want and {x[0] for found in want.values() for x in found} == {1, 3}


def test_details_enrich_the_first_candidates(spark):
    rows = [(1, 1, i, f"T{i}", "corto", f"https://m.cl/{i}", None, None, []) for i in range(5)]
    rows += [(1, 1, 7, "P", "x", "https://m.cl/a.pdf", None, None, []), (1, 1, 8, "L", "y" * 400, "https://m.cl/8", None, None, ["https://m.cl/b.pdf"]), (1, 1, 9, "H", "z", "https://m.cl/casa/", None, None, [])]
    found = spark.createDataFrame(rows, "source_id int, kind int, at int, title string, content string, url string, date_value string, closing_value string, pdfs array<string>")
    page = "<h2>Título</h2><p>Texto, publicado 03/05/1998</p><a href=bases.pdf>b</a>"
    details = spark.createDataFrame([(f"https://m.cl/{x}", page) for x in (0, 2, 3, 4, 8, "a.pdf", "casa/")] + [("https://m.cl/1", " ")], "url string, html string")
    own = spark.createDataFrame([(1, ["https://m.cl/casa"])], "source_id int, urls array<string>")
    got = {r["at"]: (r["title"], r["content"], r["date_value"], r["pdfs"]) for r in LS.enriched(found, details, own, most=3).collect()}
    new = ("Título", "Título Texto, publicado 03/05/1998 b", "03/05/1998", ["https://m.cl/bases.pdf"])
    assert got == {0: new, 1: ("T1", "corto", None, []), 2: new, 3: new, 4: ("T4", "corto", None, []), 7: ("P", "x", None, []), 8: ("L", "y" * 400, None, ["https://m.cl/b.pdf"]), 9: ("H", "z", None, [])}


def test_offers_of_candidates(spark):
    found = spark.createDataFrame([
        (1, 1, 0, "Abogado a contrata", "Concurso público, vacante. Postulaciones hasta 05/07/1998. Renta entre $ 900.000 y $ 800.000, grado 12", "https://m.cl/1", "1998-05-01", None, ["https://m.cl/b.pdf"]),
        (1, 1, 1, "", "Vacante de planta, bases y requisitos", "https://m.cl/v.PDF", None, "15/06/1998", []), (1, 1, 2, "Noticias", "Taller", "https://m.cl/noticias/3", None, None, []),
    ], "source_id int, kind int, at int, title string, content string, url string, date_value string, closing_value string, pdfs array<string>")
    sources = spark.createDataFrame([(1, "Municipalidad de Talca", "Municipal", "Maule")], "source_id int, name string, sector string, region string")
    got = sorted(tuple(str(r[c]) for c in ("url", "cargo", "ciudad", "renta_min", "renta_max", "grado", "fecha_publicacion", "fecha_cierre", "area", "url_bases")) for r in LS.offers(found, sources).collect())
    assert got == [
        ("https://m.cl/1", "Abogado a contrata", "Talca", "800000", "900000", "EUS-12", "1998-05-01", "1998-07-05", "derecho", "https://m.cl/b.pdf"),
        ("https://m.cl/v.PDF", "Vacante de planta, bases y requisitos", "Talca", "None", "None", "None", "None", "1998-06-15", "administracion", "https://m.cl/v.PDF"),
    ]


def test_pdf_candidates_and_their_texts(spark):
    html = '<ul><li>Concurso, cargo y bases <a href="/d/politica.pdf">Política</a></li><li>Vacante de planta <a href="/d/x.pdf">Perfil del cargo, postulación</a></li><li><a href=/d/Bases_concurso%20cargo-2026.pdf></a> requisitos</li><li><a href="/d/perfil.html">Perfil del cargo</a></li></ul>'
    found = LS.pdf_candidates(spark.createDataFrame([(1, "https://m.cl/t/", html)], "source_id int, url string, html string"))
    got = {r["url"]: (r["title"], r["content"], r["rank"]) for r in found.collect()}
    assert got == {"https://m.cl/d/x.pdf": ("Perfil del cargo, postulación", "Vacante de planta Perfil del cargo, postulación", 2), "https://m.cl/d/Bases_concurso%20cargo-2026.pdf": ("Bases concurso cargo 2026", "requisitos", 1)}
    texts = spark.createDataFrame([("https://m.cl/d/x.pdf", "Texto  del PDF"), ("https://m.cl/d/otro.pdf", "no")], "url string, body string")
    more = {r["url"]: r["content"] for r in LS.with_pdf_texts(found, texts).collect()}
    assert more["https://m.cl/d/x.pdf"].endswith("postulación Texto del PDF") and more["https://m.cl/d/Bases_concurso%20cargo-2026.pdf"] == "requisitos"


def test_municipal_calls(spark):
    html = """<body><p>Concurso público afuera</p><div class="x entry-content"><h3>Concursos vigentes</h3><p>Cargo: Enfermera de CESFAM. Concurso público a contrata, hasta 05/07/1998, renta $900.000 <a href="#x">no</a><a href="/wp-content/e.pdf">Aquí</a></p>
    <ul><li>Llamado a concurso: Chofer de planta (2 cupos) <a href="https://f.cl/ch">ver más</a></li><li>Taller de planta</li></ul><h4>Cerrados</h4><p>Cargo: Auditor de planta</p><ol><li>Reemplazo de matrón</li></ol><b>En proceso</b><p>Suplencia de abogado. Bases</p><p>Suplencia de abogado. Bases</p></div></body>"""
    links = '<main><ul><li><span>Vacante, cargo de técnico <a href="/t">postular aquí</a></span></li></ul><div><a href="https://facebook.com/x">Concurso público</a></div></main>'
    rows = [(1, "https://m.cl/c", html, "Muni"), (2, "https://n.cl/c/", links.replace("ul>", "div>"), "Otra"), (3, "https://o.cl", "<p>sin cuerpo, contrata</p>", "O")]
    got = sorted((r["source_id"], r["cargo"], r["url"].split("#")[0], r["tipo_cargo"], r["nivel"], r["renta_min"], str(r["fecha_cierre"])) for r in LS.municipal_calls(spark.createDataFrame(rows, "source_id int, url string, html string, name string")).collect())
    assert got == [
        (1, "Chofer de planta", "https://f.cl/ch", "Planta", "Auxiliar", None, "None"), (1, "Enfermera de CESFAM", "https://m.cl/wp-content/e.pdf", "Contrata", "Profesional", 900000, "1998-07-05"),
        (1, "Suplencia de abogado.", "https://m.cl/c", "Contrata", "Profesional", None, "None"), (2, "de técnico postular aquí", "https://n.cl/t", "Contrata", "Técnico", None, "None"),
    ]


def test_simple_sites_take_the_first_kind_that_yields(spark):
    table = "<table><tr><th>Cargo</th></tr><tr><td>Abogado a contrata</td><td><a href=/1>Bases y requisitos</a></td></tr></table>"
    cards = "<div class=job><h4>Vacante analista</h4>contrata, requisitos <a href=/2>ver</a></div><div class=job><h4>x</h4></div>"
    link = '<li>Concurso, cargo a contrata <a href="/3">Cargo de chofer</a></li>'
    rows = [(1, table + cards + link), (2, cards + link), (3, link), (4, "<p>nada</p>")]
    frame = spark.createDataFrame([(i, "https://s.cl/", h) for i, h in rows], "source_id int, url string, html string")
    say = lambda shape: sorted((r["source_id"], r["kind"], r["title"], r["url"]) for r in LS.simple_site(frame, shape).collect())
    assert say("table_first") == [(1, 2, "Abogado a contrata", "https://s.cl/1"), (2, 1, "Vacante analista", "https://s.cl/2"), (3, 3, "Cargo de chofer", "https://s.cl/3")]
    assert {(r[0], r[1]) for r in say("links_first")} >= {(1, 3), (2, 3), (3, 3)}


@pytest.mark.parametrize("name, kinds", [("x23_site_candidates", {0, 1, 2}), ("x15_blog_listing", {1, 3}), ("x26_simple_sites", {1, 2, 3})])
def test_registered_listings_meet_every_branch(spark, name, kinds):
    from plazamill import registry

    rows = registry.QUERIES[name](spark, SF).collect()
    assert {r["kind"] for r in rows} >= kinds and all(r["url"] and r["title"] for r in rows)


def test_registered_offers_and_calls(spark):
    rows = PS.x23_site_offers(spark, SF).collect() if hasattr(PS, "x23_site_offers") else []
    assert {r["cargo"] for r in rows} >= {"Concurso público: abogado a contrata", "Vacante planta administrativo", "Perfil de cargo médico", "Analista de gestión y datos"}
    calls = PS.x25_municipal_calls(spark, SF).collect()
    assert {r["cargo"] for r in calls} >= {"Enfermera de CESFAM"} and not any("Auditor" in r["cargo"] for r in calls)


def test_evaluation_reads_references_quotings_and_graphs(spark):
    from datetime import date

    from plazamill.operators import evaluation as E

    today = F.lit(date(2026, 6, 1))
    deep = '<script type="application/ld+json">[{"@graph": [{"validThrough": "2026-07-01T10:00:00", "datePosted": "2026-05-02", "b": {"datePosted": "2020-01-01"}}]}]</script>'
    meta = "<meta property='article:published_time' content=2026-05-01><meta name=fecha_cierre content='30/06/2026'><time datetime=2026-04-01>x</time>"
    rows = spark.createDataFrame([(1, deep), (2, meta), (3, "<p>Recepci&oacute;n de antecedentes hasta el 15/06/2026</p>")], "i int, h string").withColumn("t", M.tree(F.col("h")))
    got = {r["i"]: tuple(map(str, r["d"])) for r in rows.select("i", E.dates_of(F.col("t"), M.said(F.col("t")), today).alias("d")).collect()}
    assert got[1] == ("2026-05-02", "None", "2026-07-01") and got[2] == ("2026-05-01", "2026-06-30", "None") and got[3][2] == "2026-06-15"
    page = "<title>Concursos p&uacute;blicos</title><a href='/Bases.pdf'>x</a><a href=https://x.hiringroom.com/y>y</a><h1>Cargo</h1><p>Remuneraci&oacute;n</p>"
    t = F.col("t")
    seen = spark.createDataFrame([(page,)], "h string").withColumn("t", M.tree(F.col("h"))).select(E.runtime_hints(F.lit("https://m.cl"), F.lit(None).cast("string"), t), E.page_type(F.lit("https://m.cl"), F.lit("text/html"), F.col("h"), t, F.lit("generic_site"))).first()
    assert tuple(seen) == (["ats_hiringroom"], "detail_page")


def test_history_adapts_the_thresholds(spark):
    """Of sources alike the one with a good history is extracted at a confidence that is not enough without, and the one
    with a poor history isn't where it was."""
    from datetime import date

    from plazamill.operators import evaluation as E

    bodies = ["<h1>Cargo</h1><p>Concurso, vacante, postulacion, bases y requisitos</p>", "<h1>Concurso</h1><p>cierre: 30/06/2026, vacante, cargo, bases</p>", "<p>hola</p>", "<h1>x</h1><p>Noticias y taller, concurso cargo vacante; plazo de postulacion 30/06/2026</p><a href='/bases.pdf'>b</a>"]
    rows = [(10 * i + k, None, f"https://m{i}.cl/{p}", f"https://m{i}.cl/{p}", 200, None, "text/html", None, b) for i, b in enumerate(bodies) for k, p in enumerate(("", "concursos", "noticias/1"))]
    pages = spark.createDataFrame(rows, "id long, platform string, url string, final_url string, status int, error string, content_type string, headers string, html string")
    told = lambda p, r: spark.createDataFrame([(x[0], 500, p, r) for x in rows], "id long, sample int, precision double, recall double")
    read = lambda h: {r["id"]: (r["confidence"], r["decision"]) for r in E.evaluate(pages, date(2026, 6, 1), history=h).select("id", "confidence", "decision").collect()}
    bare, good, poor = read(None), read(told(1.0, 1.0)), read(told(0.1, 0.1))
    assert all(bare[i][0] == good[i][0] == poor[i][0] for i in bare)
    for i, (confidence, decision) in bare.items():
        if decision == "manual_review" and 0.73 <= confidence < 0.78:
            assert good[i][1] == "extract"
        if decision == "extract" and 0.78 <= confidence < 0.83:
            assert poor[i][1] != "extract"
        if decision == "extract":
            assert good[i][1] == "extract"
    assert any(d == "extract" and 0.78 <= c < 0.83 for c, d in bare.values())

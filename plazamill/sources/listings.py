"""Postings read off the markup of listings: generic sites, blog listings, links to PDFs, municipal pages and simple sites.

Pages arrive as rows (source_id, url, html and what a reader names further). ``markup.tree`` parses each page once; every
rule is a column expression over that tree, and the candidates are exploded to one row each before anything is judged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plazamill.functions import dates as DT
from plazamill.functions import json_walk as J
from plazamill.functions import labels as LB
from plazamill.functions import money as MN
from plazamill.functions import policy_lists as PL
from plazamill.functions.lookups import contains_any, count_of
from plazamill.functions.sections import pay_span
from plazamill.functions.text import ascii_fold, clean, host, normal, stable_id
from plazamill.operators import rules as R

from . import markup as M
from .sites import PDF_HINTS, by_relevance, file_title

HEADINGS = ("h1", "h2", "h3", "h4")
PARENTS = ("li", "p", "div", "tr", "article", "section")
#: Classes of a container, titles that only lead through a site, and the most details read of a source.
CONTAINERS = ("card", "box", "panel", "post", "item", "entry")
NAVIGATION = (
    "inicio", "home", "contacto", "contact", "login", "ingresar", "registro", "registrarse", "nosotros", "nosotras", "quienes somos", "transparencia", "noticias", "buscar", "menu", "menú", "ver mas", "ver más", "leer mas", "leer más",
    "anterior", "siguiente", "atras", "atrás", "volver", "siguiente página", "mapa del sitio", "ayuda",
)
MOST_DETAILS = 12
#: Words of a folded title and the area that they stand for; the first that occurs decides.
SITE_AREAS = (
    (("medic", "enfermer", "matron", "salud", "odontolog", "quimico"), "salud"), (("abogad", "jurid", "legal", "fiscal"), "derecho"), (("ingenier", "arquitect", "informatic", "desarrollador", "constructor"), "ingenieria"),
    (("docente", "profesor", "educador", "pedagog"), "educacion"), (("analista", "administr", "gestion", "rrhh", "finanzas"), "administracion"), (("social", "psicolog", "terapeuta", "sociolog"), "social"),
)
#: What a closing date follows.
CLOSES = (
    "(?i)(?:fecha limite de postulacion|recepcion de antecedentes hasta|postulaciones hasta|plazo de postulacion|cierre de postulacion)[^\\d]{0,20}(\\d{1,2}[./-]\\d{1,2}[./-]\\d{2,4})",
    "(?i)(?:hasta el|hasta|postular hasta el)[^\\d]{0,10}(\\d{1,2}[./-]\\d{1,2}[./-]\\d{2,4})",
)
DATE_HINT = "\\b(\\d{4}-\\d{2}-\\d{2}|\\d{1,2}[/-]\\d{1,2}[/-]\\d{4})\\b"


def joined_url(href: Column, base: Column) -> Column:
    """A link as a full address: of its own scheme, of the base's scheme (//), host (/), page (?, #, empty) or folder.
    Dots in a path stay as they are."""
    origin, page = F.regexp_extract(base, "^([A-Za-z]+://[^/?#]+)", 1), F.regexp_replace(base, "[?#].*$", "")
    folder = F.regexp_replace(F.regexp_replace(page, "(^[A-Za-z]+://[^/]+|/)[^/]*$", "$1"), "/$", "")
    h = F.trim(href)
    starts = lambda x: F.startswith(h, F.lit(x))
    return (
        F.when(h == "", base).when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), h).when(starts("//"), F.concat(F.regexp_extract(base, "^([A-Za-z]+:)", 1), h)).when(starts("/"), F.concat(origin, h))
        .when(starts("?"), F.concat(page, h)).when(starts("#"), F.concat(F.regexp_replace(base, "#.*$", ""), h)).otherwise(F.concat(folder, F.lit("/"), h))
    )


def cropped(content: Column, most: int = 180) -> Column:
    """A text as a title."""
    return F.when(F.length(content) <= most, content).otherwise(F.concat(F.rtrim(F.substring(content, 1, most - 3)), F.lit("...")))


def trusted(url: Column, hosts: Column) -> Column:
    """Whether a full address is of one of these hosts (null: any) or a PDF."""
    return hosts.isNull() | F.array_contains(hosts, F.coalesce(host(url), F.lit(""))) | F.lower(url).endswith(".pdf")


def looks_like_offer(title: Column, content: Column, url: Column) -> Column:
    """The candidate policy over title and content."""
    both = clean(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(content, F.lit(""))))
    judged = R.policy(ascii_fold(both), ascii_fold(url), list(PL.POSITIVE), "|".join(PL.NEGATIVE), "|".join(PL.NEGATIVE_URL), "|".join(PL.INTERNAL))
    return (F.length(both) >= 8) & F.coalesce(judged["accept"], F.lit(False))


def first(found: Column) -> Column:
    return F.get(found, F.lit(0))


def _href(node: Column) -> Column:
    return clean(F.coalesce(M.attr(node, "href"), F.lit("")))


def _links(page: Column, node: Column) -> Column:
    return F.filter(M.under(page, node), M.is_link)


def _papers(page: Column, links: Column) -> Column:
    """Addresses and texts of links."""
    return F.transform(links, lambda a: F.struct(_href(a).alias("href"), F.lower(M.said(page, a)).alias("text")))


def pdfs_of(papers: Column, base: Column, words: tuple[str, ...], hosts: Column) -> Column:
    """Full addresses of the papers that are PDFs or whose text holds one of the words, each once."""
    hits = F.filter(papers, lambda p: F.contains(F.lower(p["href"]), F.lit(".pdf")) | contains_any(p["text"], words))
    return F.array_distinct(F.filter(F.transform(hits, lambda p: joined_url(p["href"], base)), lambda u: trusted(u, hosts)))


SITE_PDF = ("bases", "perfil", "descriptor")


def _titled_link(page: Column, node: Column, classes: tuple[str, ...], heads: tuple[str, ...]) -> Column:
    """The first descendant that is a link, or an anchor in a heading or in a titled element."""
    in_title = lambda a: M.up(page, a, lambda x: x["tag"].isin(*heads) | M.has_class(x, *classes)).isNotNull()
    return first(F.filter(M.under(page, node), lambda a: (a["tag"] == "a") & (M.attr(a, "href").isNotNull() | in_title(a))))


def _dated(page: Column, node: Column, fits) -> Column:
    mark = first(F.filter(M.under(page, node), fits))
    return M.let(mark, lambda m: F.nullif(clean(F.coalesce(F.nullif(M.attr(m, "datetime"), F.lit("")), M.said(page, m))), F.lit("")))


def _found(kind: int, at: Column, title: Column, content: Column, href: Column, date: Column | None = None, closes: Column | None = None, papers: Column | None = None) -> Column:
    """What is read of a candidate before anything is judged."""
    text = lambda c: (F.lit(None) if c is None else c).cast("string")
    none = F.array().cast("array<struct<href:string,text:string>>")
    return F.struct(
        F.lit(kind).alias("kind"), at.cast("int").alias("at"), F.coalesce(title, F.lit("")).alias("title"), content.alias("content"), F.coalesce(href, F.lit("")).alias("href"), text(date).alias("date_value"), text(closes).alias("closing_value"),
        (none if papers is None else papers).alias("papers"),
    )


def _blocks(page: Column, fits, classes: tuple[str, ...], heads: tuple[str, ...], dated) -> Column:
    """The blocks that fit, each with its titled link, its date and its links."""
    made = lambda n: M.let(_titled_link(page, n, classes, heads), lambda a: _found(1, n["at"], M.said(page, a), M.said(page, n), _href(a), _dated(page, n, dated), None, _papers(page, _links(page, n))))
    return F.transform(F.filter(page["nodes"], fits), made)


def _rows(page: Column) -> Column:
    """Rows of tables, each with its first link."""
    made = lambda n: M.let(first(_links(page, n)), lambda a: _found(2, n["at"], F.when(a.isNull(), M.said(page, n)).otherwise(M.said(page, a)), M.said(page, n), _href(a), papers=_papers(page, _links(page, n))))
    return F.transform(F.filter(page["nodes"], lambda n: (n["tag"] == "tr") & M.up(page, n, lambda x: x["tag"] == "table").isNotNull()), made)


def _in_context(page: Column, a: Column, parents: tuple[str, ...]) -> Column:
    """The text of the nearest of these parents, else the link's own."""
    return M.let(M.up(page, a, lambda x: x["tag"].isin(*parents)), lambda block: F.when(block.isNull(), M.said(page, a)).otherwise(M.said(page, block)))


def _anchors(page: Column, parents: tuple[str, ...], fits=None) -> Column:
    """Links with what stands around them; one to a PDF is its own paper."""
    made = lambda a: _found(3, a["at"], M.said(page, a), _in_context(page, a, parents), _href(a), papers=F.filter(F.array(F.struct(_href(a).alias("href"), F.lit("").alias("text"))), lambda p: F.contains(F.lower(p["href"]), F.lit(".pdf"))))
    return F.transform(F.filter(page["nodes"], lambda a: M.is_link(a) & (F.lit(True) if fits is None else fits(a))), made)


def _away(a: Column) -> Column:
    return _href(a).rlike("^(#|mailto:|tel:|javascript:)|^$")


def _data(page: Column) -> Column:
    """Postings in linked data at any depth; their content is markup still."""
    objects = F.flatten(F.transform(M.scripts(page, "application/ld+json"), J.objects))
    found = F.filter(objects, lambda v: ascii_fold(J.value(v, "@type")) == "jobposting")
    said = lambda v, name: F.nullif(clean(J.value(v, name)), F.lit(""))
    return F.transform(found, lambda v, i: _found(0, i, clean(J.value(v, "title")), F.coalesce(J.value(v, "description"), F.lit("")), said(v, "url"), said(v, "datePosted"), said(v, "validThrough")))


CANDIDATE = ["source_id", "kind", "at", "title", "content", "url", "date_value", "closing_value", "pdfs"]


def _once(rows: DataFrame) -> DataFrame:
    """Of a source each address (else title) once, the first by kind and place."""
    key = F.coalesce(F.nullif(F.col("url"), F.lit("")), F.nullif(F.col("title"), F.lit("")))
    row = F.struct(*[F.col(c) for c in rows.columns])
    return rows.withColumn("__k", key).where("__k IS NOT NULL").groupBy("source_id", "__k").agg(F.min_by(row, F.struct("kind", "at", "url", "title")).alias("r")).select("r.*")


def _exploded(pages: DataFrame, *arrays: Column) -> DataFrame:
    """One row per found candidate, with url as its full address and the page's own columns but html and page."""
    others = [c for c in pages.columns if c not in ("html", "page", "url")]
    rows = pages.select(*others, F.col("url").alias("base"), F.explode(F.concat(*arrays)).alias("c")).select(*others, "base", "c.*")
    return rows.withColumn("url", joined_url(F.col("href"), F.col("base")))


def site_candidates(pages: DataFrame) -> DataFrame:
    """pages: source_id, url, html, hosts (array of hosts that links may lead to; null: any). Linked data (kind 0), blocks
    (1), rows of tables (2) and links with what stands around them (3) that look like postings; CANDIDATE columns."""
    page, c = F.col("page"), F.col
    fits = lambda n: n["tag"].isin("article", "li", "section") | (n["tag"] == "div") & M.has_class(n, *CONTAINERS)
    dated = lambda x: (x["tag"] == "time") & M.attr(x, "datetime").isNotNull() | M.has_class(x, "date", "fecha", "entry-date")
    rows = pages.select("source_id", "url", "hosts", M.tree(c("html")).alias("page"))
    found = _exploded(rows, _data(page), _blocks(page, fits, ("title", "job-title"), HEADINGS, dated), _rows(page), _anchors(page, PARENTS, lambda a: ~_away(a)))
    led = (F.length("title") < 6) | F.lower("title").isin(*NAVIGATION) | F.replace("title", F.lit(" ")).rlike("^\\d+$")
    found = found.where(((c("kind") == 0) | (c("href") == "") | trusted(c("url"), c("hosts"))) & ((c("kind") != 3) | ~led))
    found = found.withColumn("bare", M.text(F.when(c("kind") == 0, c("content")))).withColumn("content", F.when(c("kind") == 0, c("bare")).otherwise(c("content")))
    by_itself = c("kind").isin(0, 3)
    found = found.where(looks_like_offer(F.when(by_itself, c("title")).otherwise(""), c("content"), F.when(by_itself, c("url")).otherwise(c("base"))))
    own = F.lit(None).cast("array<string>")
    pdfs = F.when(c("kind") == 3, pdfs_of(c("papers"), c("base"), (), own)).otherwise(pdfs_of(c("papers"), c("base"), SITE_PDF, c("hosts")))
    return _once(found.withColumn("title", F.coalesce(F.nullif("title", F.lit("")), cropped(c("content")))).withColumn("pdfs", pdfs).select(*CANDIDATE))


def enriched(candidates: DataFrame, details: DataFrame, own: DataFrame, most: int = MOST_DETAILS) -> DataFrame:
    """candidates with what their own pages add. details: url, html; own: source_id, urls (array of the source's own
    addresses, whose pages are the listing itself). PDFs, texts of 400 characters with PDFs and own addresses stay as they
    are; of a source the first `most` candidates whose page was fetched are enriched."""
    bare = lambda u: F.regexp_replace(u, "/+$", "")
    known = candidates.join(own, "source_id", "left").withColumn("__home", F.exists(F.coalesce("urls", F.array().cast("array<string>")), lambda u: bare(u) == bare(F.col("url")))).drop("urls")
    asks = ~F.lower("url").endswith(".pdf") & ~((F.length("content") >= 400) & (F.size("pdfs") > 0)) & ~F.col("__home")
    fetched = details.where("trim(html) != ''").groupBy(F.col("url").alias("__url")).agg(F.min("html").alias("html"))
    both = known.join(fetched, asks & (F.col("url") == F.col("__url")), "left")
    # who is enriched is settled over keys alone, so no page is sorted
    turn = candidates.select("source_id", "kind", "at", "url").join(known.where(asks).join(fetched.select("__url"), F.col("url") == F.col("__url")).select("source_id", "kind", "at", "url"), ["source_id", "kind", "at", "url"])
    place = F.row_number().over(Window.partitionBy("source_id").orderBy("kind", "at", "url"))
    chosen = turn.withColumn("__n", place).where(F.col("__n") <= most).drop("__n").withColumn("__chosen", F.lit(True))
    read = both.join(chosen, ["source_id", "kind", "at", "url"], "left").withColumn("html", F.when(F.col("__chosen"), F.col("html")))
    read = read.withColumn("page", M.tree(F.col("html")))
    page, was = F.col("page"), F.col("html").isNotNull()
    body = F.nullif(M.said(page), F.lit(""))
    heading = F.nullif(M.said(page, first(F.filter(page["nodes"], lambda n: n["tag"].isin("h1", "h2")))), F.lit(""))
    more = pdfs_of(_papers(page, F.filter(page["nodes"], M.is_link)), F.col("url"), SITE_PDF, F.lit(None).cast("array<string>"))
    hint = F.nullif(F.regexp_extract("html", DATE_HINT, 1), F.lit(""))
    return read.select(
        "source_id", "kind", "at", F.when(was, F.coalesce(heading, "title")).otherwise(F.col("title")).alias("title"), F.when(was, F.coalesce(body, "content")).otherwise(F.col("content")).alias("content"), "url",
        F.coalesce("date_value", F.when(was, hint)).alias("date_value"), "closing_value", F.when(was, F.array_distinct(F.concat("pdfs", more))).otherwise(F.col("pdfs")).alias("pdfs"),
    )


def closing_hint(content: Column) -> Column:
    """The date after the words that announce a closing date."""
    return F.coalesce(*[DT.first_date(F.nullif(F.regexp_extract(content, p, 1), F.lit(""))) for p in CLOSES])


def site_area(text: Column) -> Column:
    t = normal(text)
    out = F.when(t == "", None)
    for words, area in SITE_AREAS:
        out = out.when(contains_any(t, words), area)
    return out.otherwise("administracion")


def town_of(name: Column) -> Column:
    return F.nullif(F.regexp_replace(clean(name), "(?i)^(Municipalidad|Corporacion Municipal|Corporación Municipal) de\\s+", ""), F.lit(""))


def grade(text: Column) -> Column:
    """EUS-n of a grade from 1 to 25."""
    n = F.regexp_extract(F.lower(text), "grado\\s*(?:eus)?\\s*[:\\-]?\\s*(\\d{1,2})\\s*(?:°|º)?", 1).try_cast("int")
    return F.when(n.between(1, 25), F.concat(F.lit("EUS-"), n.cast("string")))


def offers(candidates: DataFrame, sources: DataFrame) -> DataFrame:
    """Candidates that still look like postings, as postings. sources: source_id, name, sector, region."""
    c = F.col
    title = F.coalesce(F.nullif(clean(c("title")), F.lit("")), cropped(c("content")))
    rows = candidates.join(sources, "source_id").where(looks_like_offer(c("title"), c("content"), c("url")))
    pay = MN.pay_between(c("content"))
    return rows.select(
        "source_id", "url", title.alias("cargo"), c("name").alias("institucion"), c("content").alias("descripcion"), "sector", LB.contract_key(c("title")).alias("tipo_cargo"), LB.region_name(c("region")).alias("region"), town_of(c("name")).alias("ciudad"),
        pay["low"].alias("renta_min"), pay["high"].alias("renta_max"), grade(c("content")).alias("grado"), DT.first_date(c("date_value")).alias("fecha_publicacion"), F.coalesce(DT.first_date(c("closing_value")), closing_hint(c("content"))).alias("fecha_cierre"),
        site_area(F.coalesce(F.nullif("title", F.lit("")), c("content"))).alias("area"), F.coalesce(first(c("pdfs")), F.when(F.lower("url").endswith(".pdf"), c("url"))).alias("url_bases"),
    )


def blog_listing(pages: DataFrame) -> DataFrame:
    """pages: source_id, url, html. Posts of a blog's listing that pass the blog gate; of a page without any the links
    that do with what stands around them."""
    page, c = F.col("page"), F.col
    holds = lambda n: (n["tag"] == "article") | (n["tag"] == "div") & M.has_class(n, "post", "type-post", "entry", "blog-item") | (n["tag"] == "li") & M.has_class(n, "post")
    dated = lambda x: (x["tag"] == "time") & (M.attr(x, "datetime").isNotNull() | M.up(page, x, lambda y: M.has_class(y, "posted-on")).isNotNull()) | M.has_class(x, "entry-date")
    rows = pages.select("source_id", "url", M.tree(c("html")).alias("page"))
    found = _exploded(rows, _blocks(page, holds, ("entry-title",), HEADINGS[:3], dated), _anchors(page, ("li", "p", "div", "article", "section")))
    found = found.where(LB.blog_gate(c("title"), c("content")))
    best = found.groupBy("source_id", F.col("base").alias("__base")).agg(F.min("kind").alias("__kind"))
    found = found.join(best, (found["source_id"] == best["source_id"]) & (c("base") == c("__base")) & (c("kind") == c("__kind"))).drop(best["source_id"])
    pdfs = pdfs_of(c("papers"), c("base"), ("bases",), F.lit(None).cast("array<string>"))
    return _once(found.withColumn("pdfs", pdfs).withColumn("title", F.coalesce(F.nullif("title", F.lit("")), cropped(c("content")))).select(*CANDIDATE))


def pdf_candidates(pages: DataFrame) -> DataFrame:
    """pages: source_id, url, html. Links to PDFs that name a matter of postings and, by their text or else by the name of
    the file, look like postings in what stands around them; those of a source by relevance of their names."""
    page, c = F.col("page"), F.col
    rows = pages.select("source_id", "url", M.tree(c("html")).alias("page"))
    found = _exploded(rows, _anchors(page, PARENTS, lambda a: F.contains(F.lower(_href(a)), F.lit(".pdf"))))
    found = found.where(contains_any(normal(F.concat_ws(" ", "title", "href")), PDF_HINTS))
    named = file_title(c("url"))
    by_text, by_name = looks_like_offer(c("title"), c("content"), c("url")), looks_like_offer(named, c("content"), c("url"))
    found = found.withColumn("by_text", by_text).where(c("by_text") | by_name)
    title = F.coalesce(F.nullif(F.when(c("by_text"), c("title")).otherwise(named), F.lit("")), named)
    hint = F.nullif(F.regexp_extract("content", DATE_HINT, 1), F.lit(""))
    one = _once(found.select("source_id", "kind", "at", title.alias("title"), "content", "url", hint.alias("date_value"), "closing_value", F.array("url").alias("pdfs")))
    order = one.groupBy("source_id").agg(by_relevance(F.transform(F.array_sort(F.collect_list(F.struct("at", "url"))), lambda x: x["url"])).alias("urls"))
    return one.join(order, "source_id").withColumn("rank", F.array_position("urls", c("url")).cast("int")).drop("urls")


def with_pdf_texts(candidates: DataFrame, texts: DataFrame, most: int = 2) -> DataFrame:
    """candidates with the texts of their `most` most relevant PDFs behind their own. texts: url, body (what a reader got
    out of the PDF's first pages)."""
    wanted = candidates.select("source_id", "at", "url", F.posexplode(F.slice(by_relevance(F.col("pdfs")), 1, most)).alias("__i", "__pdf"))
    read = texts.where("trim(body) != ''").groupBy(F.col("url").alias("__pdf")).agg(F.min("body").alias("body"))
    bodies = wanted.join(read, "__pdf").groupBy("source_id", "at", "url").agg(F.array_sort(F.collect_list(F.struct("__i", "body"))).alias("__b"))
    merged = clean(F.concat_ws(" ", "content", F.array_join(F.transform("__b", lambda x: x["body"]), " ")))
    return candidates.join(bodies, ["source_id", "at", "url"], "left").withColumn("content", F.when(F.col("__b").isNull(), F.col("content")).otherwise(merged)).drop("__b")


#: Fixed values of municipal pages: words of sections of open and of closed calls, of texts that are no call, that are
#: one at once and that are one in pairs, what a title is cut before and which beginnings it loses, links left out.
OPEN_SECTION = ("en proceso", "vigente", "activo", "llamado a concurso", "concurso municipal", "concursos públicos", "concursos publicos", "postulacion", "postulación", "bases")
CLOSED_SECTION = ("cerrado", "finalizado", "terminado", "adjudicado", "concursos anteriores", "histórico")
NO_CALL = ("noticia", "comunicado", "actividad", "ceremonia", "taller", "capacitación", "capacitacion", "licitación", "licitacion", "proveedor", "subvención", "subvencion", "cuenta pública", "participación ciudadana", "agenda", "operativo")
CALL = (
    "concurso público", "concurso publico", "perfil del cargo", "requisitos del cargo", "funciones del cargo", "recepción de antecedentes", "recepcion de antecedentes", "bases del concurso", "postulaciones hasta", "honorarios", "contrata",
    "planta", "suplencia", "reemplazo",
)
CALL_PAIR = ("cargo", "vacante", "puesto", "llamado a postulación", "llamado a postulacion", "proceso de selección", "proceso de seleccion", "postular")
TITLE_CUT = "\\bAqu[íi]\\b|\\bBases\\b|\\bPostul|\\(\\d"
TITLE_HEADS = ("Llamado a concurso", "Concurso público", "Concurso Público", "Se llama a concurso", "Proceso de selección", "Concurso para")
LINKS_AWAY = ("#", "instagram", "twitter", "facebook", "youtube", "tiktok", "transparencia", "mercadopublico", "leylobby", "javascript:", "mailto:")


def is_call(text: Column) -> Column:
    """Whether a line of a municipal page is a call."""
    t = F.lower(text)
    return (F.length(text) >= 8) & ~contains_any(t, NO_CALL) & (contains_any(t, CALL) | (count_of(t, CALL_PAIR) >= 2))


def call_title(text: Column) -> Column:
    """What is said after "cargo", else the text up to a mark of bases or dates without its opening words."""
    labelled = clean(F.regexp_extract(text, "[Cc]argo[:\\s]+([^\\n.(]{5,150})", 1))
    short = clean(first(F.split(text, TITLE_CUT)))
    for head in TITLE_HEADS:
        rest = lambda x, n=len(head): clean(F.regexp_replace(F.substring(x, n + 1, 1 << 30), "^[ :—-]+", ""))
        short = M.let(short, (lambda h, cut: lambda x: F.when(F.startswith(F.lower(x), F.lit(h)), cut(x)).otherwise(x))(head.lower(), rest))
    return M.let(short, lambda x: F.when(labelled != "", labelled).when(F.length(x).between(5, 300), x).when(F.length(text) > 5, F.trim(F.substring(text, 1, 200))))


def municipal_calls(pages: DataFrame) -> DataFrame:
    """pages: source_id, url, html, name. Paragraphs and list items of the page's main part that are calls, outside of
    sections of closed ones; without any, its links whose surroundings are a call. Each address and beginning of a title
    once; a call without an address of its own gets one made of the page's and its stable id."""
    page, c = F.col("page"), F.col
    rows = pages.select("source_id", "name", F.col("url").alias("base"), M.tree(c("html")).alias("page"))
    parts = (
        lambda n: (n["tag"] == "div") & M.has_class(n, "entry-content"), lambda n: (n["tag"] == "div") & M.has_class(n, "jupiterx-post-content"),
        lambda n: (n["tag"] == "div") & F.exists(n["classes"], lambda x: x.rlike("(?i)post.?content|entry.?content|page.?content")), lambda n: n["tag"] == "article", lambda n: n["tag"] == "main", lambda n: n["tag"] == "body",
    )
    rows = rows.withColumn("main", F.coalesce(*[first(F.filter(page["nodes"], p)) for p in parts])).where("main IS NOT NULL")
    inner, text = M.under(page, c("main")), lambda n: M.joined(page, n)
    links = lambda n: F.transform(F.filter(_links(page, n), lambda a: ~_href(a).rlike("^#|^$")), lambda a: F.struct(M.attr(a, "href").alias("href"), F.lower(text(a)).alias("text")))
    line = lambda kind, turn, n, body, papers: F.struct(F.lit(kind).alias("kind"), turn.alias("turn"), n["at"].alias("at"), body.alias("body"), papers.alias("papers"))
    marks = F.transform(F.filter(inner, lambda n: n["tag"].isin("strong", "b", "h2", "h3", "h4")), lambda n: F.struct(n["at"].alias("at"), F.lower(text(n)).alias("text")))
    marked = F.transform(marks, lambda m: F.struct(m["at"].alias("at"), contains_any(m["text"], CLOSED_SECTION).alias("shut"), contains_any(m["text"], OPEN_SECTION).alias("open")))
    listed = lambda n: (n["tag"] == "li") & M.let(F.get(page["nodes"], n["parent"]), lambda u: u["tag"].isin("ul", "ol") & (u["at"] > c("main.at")))
    said = F.transform(F.filter(inner, lambda n: (n["tag"] == "p") | listed(n)), lambda n: line(0, F.when(n["tag"] == "p", n["at"]).otherwise(n["parent"]), n, text(n), links(n)))
    around = lambda a: M.let(M.up(page, a, lambda x: x["tag"].isin("p", "li")), lambda u: F.when(u.isNull(), text(a)).otherwise(text(u)))
    near = F.filter(inner, lambda a: M.is_link(a) & ~contains_any(M.attr(a, "href"), LINKS_AWAY))
    linked = F.transform(near, lambda a: line(1, a["at"], a, around(a), F.array(F.struct(M.attr(a, "href").alias("href"), text(a).alias("text")))))
    rows = rows.withColumn("marks", F.filter(marked, lambda m: m["shut"] | m["open"]))
    found = rows.select("source_id", "name", "base", "marks", F.explode(F.concat(said, linked)).alias("x")).select("source_id", "name", "base", "marks", "x.*")
    shut = F.try_element_at(F.filter("marks", lambda m: m["at"] < c("turn")), F.lit(-1))["shut"]
    fine = F.when(c("kind") == 0, ~F.coalesce(shut, F.lit(False))).otherwise(F.length(first(c("papers"))["text"]) >= 5)
    found = found.where(fine & is_call(c("body"))).withColumn("title", call_title(c("body"))).where("title IS NOT NULL")
    best = found.groupBy(F.col("source_id").alias("__s"), F.col("base").alias("__b")).agg(F.min("kind").alias("__kind"))
    found = found.join(best, c("source_id").eqNullSafe(c("__s")) & (c("base") == c("__b")) & (c("kind") == c("__kind"))).drop("__s", "__b", "__kind")
    paper = lambda p: contains_any(F.lower(p["href"]), (".pdf", "bases", "wp-content")) | F.startswith(p["href"], F.lit("http")) & contains_any(p["text"], ("aquí", "aqui", "ver", "descarg"))
    href = F.when(c("kind") == 1, first(c("papers"))["href"]).otherwise(first(F.filter("papers", paper))["href"])
    found = found.withColumn("link", joined_url(href, c("base")))
    made = F.concat("base", F.lit("#oferta-"), stable_id(c("source_id").cast("string"), c("name"), c("title"), c("body")))
    found = found.withColumn("url", F.when(c("link").isNull() | (c("link") == c("base")), made).otherwise(c("link"))).select("source_id", "name", "turn", "at", "body", "title", "url")
    row = F.struct(*[c(x) for x in found.columns])
    one = found.groupBy("source_id", "url", F.substring("title", 1, 30).alias("__t")).agg(F.min_by(row, F.struct("turn", "at")).alias("r")).select("r.*")
    body, pay, kinds = c("body"), pay_span(c("body")), F.lower("body")
    named = F.lit("Contrata")
    for word, kind in reversed((("planta", "Planta"), ("contrata", "Contrata"), ("honorario", "Honorarios"), ("reemplazo", "Reemplazo"))):
        named = F.when(F.contains(kinds, F.lit(word)), kind).otherwise(named)
    return one.select(
        "source_id", c("name").alias("institucion"), "url", F.substring("title", 1, 500).alias("cargo"), F.when(F.length(body) > 30, F.substring(body, 1, 2000)).alias("descripcion"), named.alias("tipo_cargo"),
        LB.level(c("title")).alias("nivel"), LB.area(c("title")).alias("area"), pay["low"].alias("renta_min"), pay["high"].alias("renta_max"), last_numeric_date(body).alias("fecha_cierre"),
    )


def last_numeric_date(text: Column) -> Column:
    """The last d/m/y or d-m-y date, else the first written out in Spanish."""
    numeric = F.regexp_extract_all(text, F.lit("\\b\\d{1,2}[/-]\\d{1,2}[/-]\\d{4}\\b"), F.lit(0))
    parts = F.split(F.element_at(numeric, -1), "[/-]")
    named = F.regexp_extract_all(F.lower(text), F.lit("\\b(\\d{1,2}\\s+de\\s+[a-z]+\\s+(?:de\\s+)?\\d{4})\\b"), F.lit(1))
    words = F.split(first(named), "\\s+(?:de\\s+)?")
    return F.coalesce(F.when(F.size(numeric) > 0, DT.day_of(F.get(parts, 2), F.get(parts, 1), F.get(parts, 0))), DT.day_of(F.get(words, 2), DT.month_number(F.get(words, 1)).cast("string"), F.get(words, 0)))


#: A simple site as data: marks of its cards (tag, classes; classes empty: any) in the order they are tried, the parents
#: that a bare link is read in, and the least length of a row's first cell.
SHAPES = {
    "table_first": {"cards": (("div", ("job", "oferta", "vacante", "position", "card")), ("li", ("job", "oferta", "vacante")), ("article", ())), "parents": ("li", "p", "div", "tr", "article"), "least": 5},
    "links_first": {"cards": (("article", ()), ("div", ("job", "oferta", "aviso")), ("li", ("job", "oferta", "aviso"))), "parents": ("article", "li", "tr", "div", "section"), "least": 5},
}


def simple_site(pages: DataFrame, shape: str = "table_first") -> DataFrame:
    """pages: source_id, url, html. Rows of tables (kind 2), cards by the first mark the page has (1), links in their
    surroundings (3): of a page the first of these that yields a posting counts. links_first: links, rows, cards."""
    rule, page, c = SHAPES[shape], F.col("page"), F.col
    rows = pages.select("source_id", "url", M.tree(c("html")).alias("page"))

    def row(n: Column) -> Column:
        cells = F.filter(M.under(page, n), lambda x: x["tag"].isin("td", "th"))
        return _found(2, n["at"], M.said(page, first(cells)), M.said(page, n), _href(first(_links(page, n))))

    def card(n: Column) -> Column:
        head = lambda x: x["tag"].isin(*HEADINGS, "h5") | F.exists(x["classes"], lambda k: F.lower(k).rlike("title|cargo"))
        title = F.nullif(M.said(page, first(F.filter(M.under(page, n), head))), F.lit(""))
        return _found(1, n["at"], F.coalesce(title, cropped(M.said(page, n))), M.said(page, n), _href(first(_links(page, n))))

    body = lambda n: (n["tag"] == "tr") & F.exists(M.under(page, n), lambda x: x["tag"] == "td") & M.up(page, n, lambda x: x["tag"] == "table").isNotNull()
    marked = F.array().cast("array<int>")
    for tag, classes in reversed(rule["cards"]):
        fits = (lambda t, cs: lambda n: (n["tag"] == t) & (M.has_class(n, *cs) if cs else F.lit(True)))(tag, classes)
        held = F.transform(F.filter(page["nodes"], fits), lambda n: n["at"])
        marked = M.let(held, (lambda rest: lambda h: F.when(F.size(h) > 0, h).otherwise(rest))(marked))
    table = F.transform(F.filter(page["nodes"], body), row)
    cards = F.transform(marked, lambda i: M.let(F.get(page["nodes"], i), card))
    found = _exploded(rows, table, cards, _anchors(page, rule["parents"], lambda a: ~_away(a)))
    found = found.where((F.length("title") >= rule["least"]) & looks_like_offer(c("title"), c("content"), c("url")))
    turn = {"table_first": (2, 1, 3), "links_first": (3, 2, 1)}[shape]
    found = found.withColumn("turn", F.array_position(F.array(*[F.lit(k) for k in turn]), c("kind")))
    page_of = Window.partitionBy("source_id", "base")  # not a join with the least turns, for which every page would be parsed twice
    found = found.where("base IS NOT NULL").withColumn("__turn", F.min("turn").over(page_of)).where("turn = __turn")
    return _once(found.select("source_id", "kind", "at", "title", "content", "url"))

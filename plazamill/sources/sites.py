"""Postings from fetched payloads of job sites; input frames hold what was fetched, acquisition is not done here.

Every parser is column expressions over the payload (JSON, markup, lines), exploded to one row a posting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plazamill.functions import labels as LB
from plazamill.functions.lookups import contains_any
from plazamill.functions.text import clean, normal
from plazamill.functions.titles import once
from plazamill.operators.evaluation import visible

from . import markup as M

#: Pages of a listing and posts a page; windows in days, in the order they are tried (null: no bound).
MOST_PAGES, PAGE_POSTS, WINDOWS = 25, 20, (180, None, 365)
POSTS = "array<struct<title: struct<rendered: string>, content: struct<rendered: string>, date: string, link: string>>"
FEED = "items array<struct<title: string, content_html: string, content_text: string, url: string, link: string, date_published: string, date_modified: string>>"
PDF_HINTS = ("perfil", "descriptor", "bases", "concurso", "cargo", "postulacion")
PDF_ORDER = ("bases", "perfil", "descriptor", "concurso", "tdr", "convocatoria")
COURT_WORDS = "(?iu)concurso|convocatoria|cargo|juez|notario|conservador"


def absolute(href: Column, base: Column) -> Column:
    """A link as a full address: full ones stay, those from the root take the base's host, others its folder."""
    origin = F.regexp_extract(base, "^([A-Za-z]+://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, "[?#].*$", ""), "(^[A-Za-z]+://[^/]+|/)[^/]*$", "$1")
    return F.when(href.rlike("(?i)^[a-z]+://"), href).when(F.startswith(href, F.lit("/")), F.concat(origin, href)).otherwise(F.concat(F.regexp_replace(folder, "/$", ""), F.lit("/"), href))


def pdf_links(page: Column, base: Column) -> Column:
    """Full addresses of a tree's links to PDFs."""
    return F.array_distinct(F.transform(F.filter(M.hrefs(page), lambda h: F.contains(F.lower(h), F.lit(".pdf"))), lambda h: absolute(h, base)))


def first_of_key(rows: DataFrame, *order: str) -> DataFrame:
    """Per source each address (else title) once, the first in order."""
    key = F.coalesce(F.nullif(clean(F.col("url")), F.lit("")), F.nullif(clean(F.col("title")), F.lit("")))
    row = F.struct(*[F.col(c) for c in rows.columns])
    return rows.withColumn("__k", key).where("__k IS NOT NULL").groupBy("source_id", "__k").agg(F.min_by(row, F.struct(*order)).alias("r")).select("r.*")


def wordpress_posts(pages: DataFrame) -> DataFrame:
    """pages: source_id, days (of the window; null: no bound), page, payload (JSON list of posts), site. Of a window the
    pages count up to the first short one, 25 at most; posts pass the blog gate; of a source the first window of WINDOWS
    that yields a posting counts."""
    read = pages.withColumn("posts", F.from_json("payload", POSTS)).where("posts IS NOT NULL")
    turn = F.when(F.col("days") == WINDOWS[0], 0).when(F.col("days").isNull(), 1).when(F.col("days") == WINDOWS[2], 2)
    read = read.withColumn("turn", turn).where(F.col("turn").isNotNull() & (F.col("page") <= MOST_PAGES))
    short = read.where(F.size("posts") < PAGE_POSTS).groupBy("source_id", "turn").agg(F.min("page").alias("last"))
    kept = read.join(short, ["source_id", "turn"], "left").where(F.col("last").isNull() | (F.col("page") <= F.col("last")))
    posts = kept.select("source_id", "site", "turn", "page", F.posexplode("posts").alias("at", "p")).withColumn("tree", M.tree(F.col("p.content.rendered")))
    rows = posts.select("source_id", "turn", "page", "at", visible(F.coalesce("p.title.rendered", F.lit(""))).alias("title"), M.said(F.col("tree")).alias("body"), F.col("p.date").alias("date"), clean(F.col("p.link")).alias("url"), pdf_links(F.col("tree"), F.coalesce("p.link", "site")).alias("pdfs"))
    fine = rows.where(LB.blog_gate(F.col("title"), F.col("body")))
    best = fine.groupBy("source_id").agg(F.min("turn").alias("turn"))
    return first_of_key(fine.join(best, ["source_id", "turn"]), "page", "at").drop("turn", "page", "at")


def feed_items(feeds: DataFrame) -> DataFrame:
    """feeds: source_id, slug_order, payload (JSON feed). The first slug with items counts."""
    read = feeds.withColumn("items", F.from_json("payload", FEED)["items"]).where(F.size("items") > 0)
    first = read.groupBy("source_id").agg(F.min_by("items", "slug_order").alias("items"))
    html = F.coalesce(F.nullif("i.content_html", F.lit("")), "i.content_text", F.lit(""))
    rows = first.select("source_id", F.posexplode("items").alias("at", "i")).withColumn("tree", M.tree(html))
    link = clean(F.coalesce(F.nullif("i.url", F.lit("")), "i.link"))
    rows = rows.select("source_id", "at", clean(F.col("i.title")).alias("title"), M.said(F.col("tree")).alias("body"), F.coalesce("i.date_published", "i.date_modified").alias("date"), link.alias("url"), pdf_links(F.col("tree"), link).alias("pdfs"))
    return first_of_key(rows, "at").drop("at")


#: Marks of a card, in the order they are tried: a pattern of the class attribute, and the tags (none: any).
CARDS = (("(?i)(^|\\s)jobs__card(\\s|$)", ()), ("(?i)jobs__card(?!-)", ()), ("(?i)(^|\\s)job-card(\\s|$)", ()), ("JobCard", ()), ("(?i)(^|\\s)job(\\s|$)", ("article",)), ("(?i)(^|\\s)job(\\s|$)", ("li",)))


def job_cards(pages: DataFrame) -> DataFrame:
    """pages: source_id, url, html. Cards of a listing by the first kind of mark that the page has; without title or link
    a card doesn't count; titles said twice are collapsed."""
    page = F.col("page")
    classes = lambda n: F.coalesce(M.attr(n, "class"), F.lit(""))
    kinds = [F.filter(page["nodes"], (lambda p, tags: lambda n: classes(n).rlike(p) & (n["tag"].isin(*tags) if tags else F.lit(True)))(p, tags)) for p, tags in CARDS]
    marked = F.get(F.filter(F.array(*[F.transform(k, lambda n: n["at"]) for k in kinds]), lambda k: F.size(k) > 0), F.lit(0))

    def card(n: Column) -> Column:
        said = lambda fits: F.nullif(M.said(page, F.get(F.filter(M.under(page, n), fits), F.lit(0))), F.lit(""))
        of = lambda name: said(lambda x: F.contains(classes(x), F.lit(name)))
        title = F.coalesce(of("job__card-name"), of("job__card-title"), of("card-title"), said(lambda x: x["tag"] == "h3"), said(lambda x: x["tag"] == "h2"))
        href = M.attr(F.get(F.filter(M.under(page, n), M.is_link), F.lit(0)), "href")
        own = F.when(n["tag"] == "a", M.attr(n, "href"))
        return F.struct(title.alias("title"), F.nullif(F.coalesce(own, href), F.lit("")).alias("href"), of("jobs__card-info").alias("info"))

    rows = pages.select("source_id", F.col("url").alias("base"), M.tree(F.col("html")).alias("page"))
    rows = rows.select("source_id", "base", F.posexplode(F.transform(marked, lambda i: M.let(F.get(page["nodes"], i), card))).alias("at", "c"))
    return rows.select("source_id", "at", clean(once(F.col("c.title"))).alias("title"), absolute(F.col("c.href"), F.col("base")).alias("url"), "c.info").where("title IS NOT NULL AND title <> '' AND url IS NOT NULL")


def file_title(url: Column) -> Column:
    """A title from the name of a PDF."""
    name = F.try_url_decode(F.substring_index(url, "/", -1))
    return clean(F.regexp_replace(F.regexp_replace(F.coalesce(name, F.substring_index(url, "/", -1)), "(?i)\\.pdf$", ""), "[-_]+", " "))


def by_relevance(links: Column) -> Column:
    """PDF links with those first whose name speaks for the matter, in the order of PDF_ORDER, else as they stand."""
    rank = lambda u: F.coalesce(*[F.when(F.contains(F.lower(u), F.lit(h)), i) for i, h in enumerate(PDF_ORDER)], F.lit(len(PDF_ORDER)))
    tagged = F.transform(links, lambda u, i: F.struct(rank(u).alias("r"), i.alias("i"), u.alias("u")))
    return F.transform(F.array_sort(tagged), lambda x: x["u"])


def pdf_postings(pages: DataFrame) -> DataFrame:
    """pages: source_id, url, html. Links to PDFs whose text or name speaks of a posting; the text is the title, else the
    file's name is."""
    page = F.col("page")
    rows = pages.select("source_id", F.col("url").alias("base"), M.tree(F.col("html")).alias("page"))
    papers = F.transform(F.filter(page["nodes"], lambda n: M.is_link(n) & F.contains(F.lower(M.attr(n, "href")), F.lit(".pdf"))), lambda n: F.struct(M.attr(n, "href").alias("href"), M.said(page, n).alias("text")))
    rows = rows.select("source_id", "base", F.posexplode(papers).alias("at", "a")).select("source_id", "at", absolute(F.col("a.href"), F.col("base")).alias("url"), "a.text")
    rows = rows.where(contains_any(normal(F.concat_ws(" ", "text", "url")), PDF_HINTS))
    return first_of_key(rows.select("source_id", "at", "url", F.coalesce(F.nullif("text", F.lit("")), file_title(F.col("url"))).alias("title")), "at").drop("at")


def court_calls(pages: DataFrame, region_name) -> DataFrame:
    """pages: source_id, url, html. Lines of 20 characters or more that speak of a call; the block is the line before
    and four after, with its first date and region; the address is made of the page's and a hash of the block."""
    rows = pages.select("source_id", "url", M.tree(F.col("html")).alias("page"))
    lines = F.filter(F.transform(F.split(F.array_join("page.texts", "\n"), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = rows.select("source_id", "url", lines.alias("lines")).select("source_id", F.col("url").alias("base"), "lines", F.posexplode("lines").alias("at", "line"))
    rows = rows.where(F.col("line").rlike(COURT_WORDS) & (F.length("line") >= 20))
    low = F.greatest(F.col("at"), F.lit(1))
    block = F.array_join(F.slice("lines", low, F.col("at") + 5 - low + 1), " ")
    rows = rows.withColumn("block", block)
    place = F.trim(F.regexp_extract("block", "(?iu)(?:región de|corte de apelaciones de|tribunal de)\\s+([\\wáéíóúñ\\s]+?)(?:\\.|,|$)", 1))
    day = F.try_to_date(F.replace(F.regexp_extract("block", "\\b[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{4}\\b", 0), F.lit("/"), F.lit("-")), "d-M-yyyy")
    name = clean(F.col("line"))
    made = F.concat(F.col("base"), F.lit("#oferta-"), F.substring(F.sha1(F.concat_ws("||", F.lower(name), F.lower(clean(F.col("block"))))), 1, 20))
    out = rows.select("source_id", "at", name.alias("title"), F.col("block").alias("body"), region_name(F.nullif(place, F.lit(""))).alias("region"), day.alias("closes"), made.alias("url"))
    row = F.struct(*[F.col(c) for c in out.columns])
    return out.groupBy("source_id", "url", F.substring("title", 1, 50).alias("__t")).agg(F.min_by(row, "at").alias("r")).select("r.*").drop("at")

"""Postings of portals from what was fetched: objects embedded in scripts, serialised page state, chained listings.

Input frames hold fetched pages; every rule is a column expression over the page's tree or its scripts, except the search
for JSON values inside script text and the following of a listing's next pages, which are small helpers in Arrow and
grouped tasks.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plazamill.functions import dates as DT
from plazamill.functions import json_walk as J
from plazamill.functions import labels as LB
from plazamill.functions.lookups import contains_any
from plazamill.functions.money import pay_between
from plazamill.functions.text import clean, normal

from . import markup as M
from .listings import _once, first, grade, joined_url, looks_like_offer, site_area

#: How many brackets of a script are tried and how much of it is read.
MOST_STARTS, MOST_CHARS = 4000, 800_000
_DECODER = json.JSONDecoder()


def json_values(text: str) -> list[str]:
    """The JSON values that begin at a bracket of the text, as JSON, outermost only: what stands inside a value that could
    be read is not tried again. Of the first MOST_CHARS characters the first MOST_STARTS brackets are tried."""
    text, end, out = text[:MOST_CHARS], 0, []
    for n, m in enumerate(re.finditer(r"[\[{]", text)):
        if n >= MOST_STARTS:
            break
        if m.start() < end:
            continue
        try:
            value, end = _DECODER.raw_decode(text, m.start())
        except (ValueError, RecursionError):
            continue
        out.append(json.dumps(value, ensure_ascii=False))
    return out


@F.arrow_udf(T.ArrayType(T.StringType()))
def _embedded(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in columns:
        yield pa.array([[v for text in texts or [] for v in json_values(text or "")] for texts in batch.to_pylist()], pa.list_(pa.string()))


embedded = _embedded.asNondeterministic()  # else the optimizer may search a script once for every use

#: Names that an object's fields go by, words of its names that make it a posting, words of its script.
TITLES, LINKED_TITLES = ("title", "name", "position"), ("title", "name", "jobTitle")
LINKS, LINKED_LINKS = ("url", "jobUrl", "applyUrl", "publicUrl", "slug"), ("url", "applyUrl", "jobUrl")
PLACES, MODES, DATES = ("location", "city", "region"), ("modality", "workplace", "workMode"), ("datePosted", "publicationDate", "createdAt", "publishedAt")
OBJECT_WORDS, SCRIPT_WORDS = ("title", "position", "job", "vacan", "modality", "location"), ("hiringroom", "job", "vacan")
MODE = "(?i)(remoto|hibrid[oa]|presencial)"


def _alias(v: Column, *names: str) -> Column:
    """The first of these fields that says something."""
    return F.coalesce(*[F.nullif(clean(J.value(v, n)), F.lit("")) for n in names])


def _names(v: Column) -> Column:
    return F.lower(F.array_join(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")), " "))


def _address(v: Column) -> Column:
    """Place of a job location: an address's locality, region and country, of a list those of each."""
    parts = lambda x: F.array_join(F.array_compact(F.array(*[F.nullif(clean(F.try_variant_get(x, f"$.address.{p}", "string")), F.lit("")) for p in ("addressLocality", "addressRegion", "addressCountry")])), ", ")
    many = F.try_variant_get(v, "$.jobLocation", "array<variant>")
    one = F.try_variant_get(v, "$.jobLocation", "variant")
    listed = F.array_join(F.filter(F.transform(many, parts), lambda p: p != ""), ", ")
    return F.coalesce(F.nullif(listed, F.lit("")), F.nullif(parts(one), F.lit("")), _alias(v, "location", "address"), F.lit(""))


def embedded_jobs(pages: DataFrame) -> DataFrame:
    """pages: source_id, url, html. Postings among the objects of linked data (kind 0) and of values embedded in scripts
    (kind 1), at any depth; fields by their aliases, a missing address made of slug, id or title; each address once."""
    c, page = F.col, F.col("page")
    rows = pages.select("source_id", c("url").alias("base"), M.tree(c("html")).alias("page"))
    told = F.filter(M.scripts(page), lambda t: contains_any(F.lower(t), SCRIPT_WORDS))
    rows = rows.withColumn("told", embedded(told))
    linked = F.transform(F.flatten(F.transform(M.scripts(page, "application/ld+json"), J.objects)), lambda v: F.struct(F.lit(0).alias("kind"), v.alias("v")))
    inside = F.transform(F.filter(F.flatten(F.transform("told", J.objects)), lambda v: contains_any(_names(v), OBJECT_WORDS)), lambda v: F.struct(F.lit(1).alias("kind"), v.alias("v")))
    found = rows.select("source_id", "base", F.posexplode(F.concat(linked, inside)).alias("at", "x")).select("source_id", "base", "at", "x.kind", "x.v")
    v, data = c("v"), c("kind") == 0
    text = lambda x: F.coalesce(x, F.lit(""))
    found = found.select(
        "source_id", "base", "at", "kind", text(F.when(data, _alias(v, *LINKED_TITLES)).otherwise(_alias(v, *TITLES))).alias("title"), F.when(data, _alias(v, *LINKED_LINKS)).otherwise(_alias(v, *LINKS)).alias("link"),
        text(F.when(data, _address(v)).otherwise(_alias(v, *PLACES))).alias("place"), text(F.when(data, F.coalesce(_alias(v, "employmentType"), F.nullif(F.regexp_extract(text(J.value(v, "description")), MODE, 1), F.lit("")))).otherwise(_alias(v, *MODES))).alias("mode"),
        F.when(data, _alias(v, "datePosted")).otherwise(_alias(v, *DATES)).alias("date_value"), text(J.value(v, "description")).alias("said"), _alias(v, "slug").alias("slug"), _alias(v, "id", "jobId").alias("id"),
    )
    made = F.coalesce("slug", "id", F.nullif(F.regexp_replace(F.regexp_replace(F.lower("title"), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit("")))
    named = F.concat(F.lit("/jobs/"), F.regexp_replace("link", "^/+|/+$", ""))
    href = F.when(data | c("link").rlike("^(/|http)"), c("link")).when(c("link").isNotNull(), named).otherwise(F.concat(F.lit("/jobs/"), made))
    found = found.withColumn("url", joined_url(href, c("base"))).where("title != '' AND url IS NOT NULL")
    said = clean(F.concat_ws(" ", F.when(~data, c("title")), F.when(data, c("said")), "place", "mode", F.when(~data, c("said"))))
    fine = found.withColumn("judged", said).where(looks_like_offer(c("title"), c("judged"), c("url")))
    return _once(fine.select("source_id", "kind", "at", "title", clean(F.concat_ws(" ", "title", "place", "mode", "judged")).alias("content"), "url", "date_value", "place", "mode"))


# --- serialised page state

#: Marks of the script that holds the state; pairs of an id and a title, what follows them, pages; titles
#: that are none; marks of a company and of a description; labels of a detail page.
STATE = "ShallowReactive|__NUXT|cantidadPaginas|(?i:oferta)"
PAIR = '(\\d{6,8}),"([^"]{6,180})"'
PLACED = '(\\d{6,8}),"[^"]{6,180}","[^"]*","[^"]*","([^"]{5,200})",'
DATED = '(\\d{6,8}).*?"(\\d{4}-\\d{2}-\\d{2} \\d{2}:\\d{2})"'
NO_TITLE = "^(ver\\s+detalle|ver\\s+bases|postular?|postula(?:r)?|buscar\\s+empleo|compartir|guardar|filtrar|orden(?:ar)?)$"
COMPANY, DESCRIPTION = ("company", "empresa"), ("description", "detalle", "content")
LABELS = {
    "place": ("Ubicación", "Lugar", "Comuna", "Ciudad"), "published": ("Fecha publicación", "Publicado", "Publicación"), "closes": ("Fecha cierre", "Cierre", "Postulaciones hasta", "Fecha límite"), "contract": ("Tipo contrato", "Contrato", "Jornada"),
    "pay": ("Sueldo", "Renta", "Salario"), "company": ("Empresa", "Institución", "Institucion"),
}


def is_title(title: Column) -> Column:
    t = clean(title)
    return (F.length(t) >= 4) & ~F.lower(t).rlike(NO_TITLE) & t.rlike("[a-zA-ZáéíóúüñÁÉÍÓÚÜÑ]")


def _keyed(text: Column, pattern: str, last: bool) -> Column:
    """map of the evidence's id to its value: of equal ids the last or the first."""
    ids, values = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    pairs = F.arrays_zip(ids.alias("k"), values.alias("v"))
    ordered = F.transform(pairs, lambda x, i: F.struct(x["k"].alias("k"), x["v"].alias("v"), i.alias("i")))
    kept = F.filter(ordered, lambda x: ~F.exists(ordered, lambda y: (y["k"] == x["k"]) & ((y["i"] > x["i"]) if last else (y["i"] < x["i"]))))
    return F.map_from_entries(F.transform(kept, lambda x: F.struct(x["k"], x["v"])))


def state_offers(pages: DataFrame) -> DataFrame:
    """pages: source_id, url, html, name, sector, region. Postings in the state that a page carries: pairs of an id and a
    title in order, places by id (the last said), dates by id (the first said), and the number of pages; of a page without
    state its cards. One row a pair, repeated ids included."""
    c, page = F.col, F.col("page")
    rows = pages.withColumn("page", M.tree(c("html")))
    script = first(F.filter(M.scripts(page), lambda t: t.rlike(STATE)))
    whole = F.when(c("html").contains("cantidadPaginas") | c("html").rlike(PAIR), c("html"))
    rows = rows.withColumn("state", F.coalesce(script, whole))
    held = rows.where("state IS NOT NULL").withColumns({"places": _keyed(c("state"), PLACED, True), "days": _keyed(c("state"), DATED, False)})
    count = F.coalesce(F.regexp_extract("state", "cantidadPaginas[^:]*[:.,]\\s*(\\d+)", 1).try_cast("int"), F.lit(1))
    pairs = F.arrays_zip(F.regexp_extract_all("state", F.lit(PAIR), F.lit(1)).alias("id"), F.regexp_extract_all("state", F.lit(PAIR), F.lit(2)).alias("title"))
    said = held.select("source_id", "url", "name", "sector", "region", count.alias("pages"), "places", "days", F.posexplode(pairs).alias("at", "p")).where(is_title(c("p.title")))
    place = F.try_element_at("places", c("p.id"))
    parts = F.split(place, ",")
    origin = F.regexp_extract("url", "^([A-Za-z]+://[^/?#]+)", 1)
    known = said.select(
        "source_id", "at", "pages", F.concat(origin, F.lit("/oferta/"), c("p.id")).alias("url"), clean(c("p.title")).alias("cargo"), c("name").alias("institucion"), F.lit(None).cast("string").alias("descripcion"), "sector", LB.contract_key(c("p.title")).alias("tipo_cargo"),
        F.coalesce(LB.region_name(F.trim(F.element_at(parts, -1))), LB.region_name(c("region"))).alias("region"), clean(F.get(parts, 0)).alias("ciudad"), F.lit(None).cast("string").alias("renta"), DT.first_date(F.try_element_at("days", c("p.id"))).alias("fecha_publicacion"), F.lit(None).cast("date").alias("fecha_cierre"), site_area(c("p.title")).alias("area"),
    )
    cards = F.filter(page["nodes"], lambda n: (n["tag"] == "article") | M.has_class(n, "job-card", "oferta-card", "card"))

    def card(n: Column) -> Column:
        head = first(F.filter(M.under(page, n), lambda x: x["tag"].isin("h2", "h3") | M.has_class(x, "job-title", "titulo")))
        return F.struct(M.said(page, head).alias("title"), F.coalesce(M.attr(first(F.filter(M.under(page, n), M.is_link)), "href"), F.lit("")).alias("href"))

    plain = rows.where("state IS NULL").select("source_id", "url", "name", "sector", "region", F.posexplode(F.transform(cards, card)).alias("at", "k"))
    plain = plain.withColumn("full", joined_url(c("k.href"), c("url"))).where(looks_like_offer(c("k.title"), F.lit(""), c("full")) & (c("k.title") != ""))
    none = lambda t: F.lit(None).cast(t)
    other = plain.select(
        "source_id", "at", F.lit(1).alias("pages"), c("full").alias("url"), c("k.title").alias("cargo"), c("name").alias("institucion"), none("string").alias("descripcion"), "sector", none("string").alias("tipo_cargo"), LB.region_name(c("region")).alias("region"),
        none("string").alias("ciudad"), none("string").alias("renta"), none("date").alias("fecha_publicacion"), none("date").alias("fecha_cierre"), site_area(c("k.title")).alias("area"),
    )
    return known.unionByName(other)


def tidy_lines(text: Column) -> Column:
    """Lines cleaned, each once, without those of signs only and those of over 200 characters without a stop."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "[\\n\\r]+"), clean)
    fine = F.filter(lines, lambda x: (x != "") & ~x.rlike("^[^\\p{L}\\p{N}]+$") & ~((F.length(x) > 200) & ~x.rlike("[.!?:;]")))
    kept = F.filter(F.transform(fine, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda a: ~F.exists(F.slice(fine, 1, a["i"]), lambda b: F.lower(b) == F.lower(a["x"])))
    return F.array_join(F.transform(kept, lambda a: a["x"]), "\n")


def labelled(page: Column, labels: tuple[str, ...]) -> Column:
    """What a label on a page says: the element after the label's, else the rest of the label's own element."""

    def one(label: str) -> Column:
        spots = F.filter(F.transform(page["texts"], lambda t, i: F.when(clean(t).rlike(f"(?iu)^{re.escape(label)}\\s*:?$"), i)), lambda i: i.isNotNull())

        def value(i: Column) -> Column:
            holder = F.element_at(F.filter(page["nodes"], lambda n: (n["first"] <= i) & (n["past"] > i)), -1)
            after = lambda n: M.let(F.get(page["nodes"], n["last"] + 1), lambda s: F.when(s["parent"] == n["parent"], F.nullif(M.said(page, s), F.lit(""))))
            rest = lambda n: F.nullif(F.regexp_replace(M.said(page, n), f"(?iu)^{re.escape(label)}\\s*:?\\s*", ""), F.lit(""))
            return M.let(holder, lambda n: F.coalesce(after(n), rest(n)))

        return first(F.filter(F.transform(spots, value), lambda x: x.isNotNull()))

    return F.coalesce(*[one(x) for x in labels])


def with_details(offers: DataFrame, details: DataFrame) -> DataFrame:
    """Postings with what their detail pages (url, html) say; where a page says nothing the posting's own value stays. A
    posting whose page has no valid title or a description of less than 30 characters goes."""
    c, page = F.col, F.col("page")
    fetched = details.where("trim(html) != ''").groupBy(c("url").alias("__url")).agg(F.min("html").alias("html"))
    rows = offers.join(fetched, c("url") == c("__url"), "left").withColumn("page", M.tree(c("html")))
    by_class = lambda name: lambda n: F.contains(F.lower(F.coalesce(M.attr(n, "class"), F.lit(""))), F.lit(name))
    pick = lambda fits: first(F.filter(page["nodes"], fits))
    filled = lambda x: F.nullif(x, F.lit(""))
    og = M.attr(pick(lambda n: (n["tag"] == "meta") & (M.attr(n, "property") == "og:title")), "content")
    heading = F.coalesce(filled(M.said(page, pick(lambda n: n["tag"] == "h1"))), filled(og), M.title(page))
    company = F.coalesce(*[filled(M.said(page, pick(by_class(x)))) for x in COMPANY])
    in_main = lambda name: lambda n: by_class(name)(n) & M.up(page, n, lambda x: x["tag"] == "main").isNotNull()
    long = lambda node: M.let(tidy_lines(F.array_join(F.slice(page["texts"], node["first"] + 1, node["past"] - node["first"]), "\n")), lambda t: F.when(F.length(t) >= 60, t))
    blocks = [*[pick(in_main(x)) for x in DESCRIPTION], pick(lambda n: M.attr(n, "id") == "job-description"), pick(lambda n: M.has_class(n, "job-description")), pick(lambda n: n["tag"] == "article")]
    said = F.coalesce(*[M.let(b, long) for b in blocks])
    read = rows.select("*", F.coalesce(heading, "cargo").alias("__cargo"), company.alias("__company"), F.coalesce(said, tidy_lines(c("descripcion"))).alias("__said"), *[labelled(page, v).alias(f"__{k}") for k, v in LABELS.items() if k != "company"], labelled(page, LABELS["company"]).alias("__firm")).drop("page")
    has = c("html").isNotNull()
    read = read.where(~has | is_title(c("__cargo")) & (F.length("__said") >= 30))
    parts = F.split("__place", ",")
    new = {
        "cargo": c("__cargo"), "institucion": F.coalesce(F.when(is_title(c("__company")), c("__company")), "__firm", "institucion"), "descripcion": c("__said"), "tipo_cargo": LB.contract_key(F.concat_ws(" ", "__cargo", "__contract")),
        "region": F.coalesce(LB.region_name(F.trim(F.element_at(parts, -1))), "region"), "ciudad": F.coalesce(filled(clean(F.get(parts, 0))), "ciudad"), "renta": F.coalesce("__pay", "renta"), "fecha_publicacion": F.coalesce(DT.first_date(c("__published")), "fecha_publicacion"),
        "fecha_cierre": F.coalesce(DT.first_date(c("__closes")), "fecha_cierre"),
    }
    return read.select(*[F.when(has, new[n]).otherwise(c(n)).alias(n) if n in new else c(n) for n in offers.columns])


# --- listings that are chained page by page

#: Texts of a link to the next page.
NEXT = ("siguiente", "proxima", "next", "sig", "adelante")
POST_BACK = "__doPostBack\\('([^']*)','([^']*)'\\)"


def next_request(page: Column, url: Column) -> Column:
    """struct(method, url, data): the request for the page after this one; null on the last. A rel=next link goes first, then
    the first link that says next, by its address or by its post-back with the form's hidden fields; numbered
    post-backs count too."""
    nodes = page["nodes"]
    get = lambda href: F.struct(F.lit("GET").alias("method"), joined_url(href, url).alias("url"), F.create_map().cast("map<string,string>").alias("data"))
    ruled = first(F.filter(nodes, lambda n: M.is_link(n) & (M.attr(n, "rel") == "next")))
    form = first(F.filter(nodes, lambda n: n["tag"] == "form"))
    hidden = M.let(form, lambda f: F.filter(M.under(page, f), lambda n: (n["tag"] == "input") & M.attr(n, "name").isNotNull() & F.lower(F.coalesce(M.attr(n, "type"), F.lit(""))).isin("hidden", "")))
    own = F.filter(F.transform(hidden, lambda n: F.struct(M.attr(n, "name").alias("k"), F.coalesce(M.attr(n, "value"), F.lit("")).alias("v"))), lambda e: ~e["k"].isin("__EVENTTARGET", "__EVENTARGUMENT"))
    once = F.map_from_entries(F.array_distinct(own))

    def step(a: Column) -> Column:
        text = F.rtrim(F.lower(M.said(page, a)))
        payload = F.coalesce(F.nullif(M.attr(a, "onclick"), F.lit("")), M.attr(a, "href"))
        return M.let(F.struct(F.regexp_replace(text, "\\.+$", "").alias("text"), payload.alias("payload"), M.attr(a, "href").alias("href")), asked)

    def asked(x: Column) -> Column:
        says = contains_any(x["text"], NEXT) | x["text"].isin(">", ">>")
        plain = says & (x["href"] != "") & ~F.contains(x["href"], F.lit("__doPostBack"))
        back = F.contains(x["payload"], F.lit("__doPostBack")) & (says | x["text"].rlike("^\\d+$")) & x["payload"].rlike(POST_BACK) & form.isNotNull()
        event = F.create_map(F.lit("__EVENTTARGET"), F.regexp_extract(x["payload"], POST_BACK, 1), F.lit("__EVENTARGUMENT"), F.regexp_extract(x["payload"], POST_BACK, 2))
        post = F.struct(F.lit("POST").alias("method"), joined_url(F.coalesce(F.nullif(M.attr(form, "action"), F.lit("")), url), url).alias("url"), F.map_concat(once, event).alias("data"))
        return F.when(plain, get(x["href"])).when(back, post)

    steps = F.filter(F.transform(F.filter(nodes, M.is_link), step), lambda s: s.isNotNull())
    return F.when(ruled.isNotNull(), get(M.attr(ruled, "href"))).otherwise(first(steps))


def signature(method: Column, url: Column, data: Column) -> Column:
    """One text for a request."""
    return F.concat_ws("\n", method, url, F.to_json(F.array_sort(F.map_entries(data))))


def chained(pages: DataFrame, items: Column) -> DataFrame:
    """pages: portal, url, method, data, html (as fetched) and started (true for the request that a portal begins with); items:
    array of the addresses that a page (its tree: column `page`) lists. The pages of each portal that its chain
    reaches, with turn from 1: it ends with a request made before, a page without items, a page that lists what an
    earlier one did, or a request that was not fetched. Only signatures are grouped, so a portal's group is as small
    as its number of pages."""
    c = F.col
    rows = pages.withColumn("page", M.tree(c("html"))).withColumn("sign", signature(c("method"), c("url"), c("data")))
    rows = rows.withColumn("items", F.array_distinct(items)).withColumn("next", next_request(c("page"), c("url")))
    links = rows.select("portal", "sign", "started", signature(c("next.method"), c("next.url"), c("next.data")).alias("then"), F.when(F.size("items") > 0, F.sha2(F.array_join(F.array_sort("items"), "\n"), 256)).alias("seen"))

    def follow(links: pa.Table) -> pa.Table:
        rows = links.to_pylist()
        held = {r["sign"]: (r["then"], r["seen"]) for r in rows}
        now, out, lists = min((r["sign"] for r in rows if r["started"]), default=None), [], set()
        while now in held and now not in out and held[now][1] is not None and held[now][1] not in lists:
            lists.add(held[now][1])
            out.append(now)
            now = held[now][0]
        return pa.table({"portal": links.column("portal")[:1].combine_chunks().take(pa.array([0] * len(out), pa.int32())), "sign": pa.array(out, pa.string()), "turn": pa.array(range(1, len(out) + 1), pa.int32())})

    kind = dict(pages.dtypes)["portal"]
    order = links.groupBy("portal").applyInArrow(follow, f"portal {kind}, sign string, turn int")
    one = rows.groupBy(c("portal").alias("__p"), c("sign").alias("__s")).agg(F.min_by(F.struct("url", "html", "items", "page"), "html").alias("r"))
    return order.join(one, (c("portal") == c("__p")) & (c("sign") == c("__s"))).select("portal", "turn", "r.*")


#: What makes a link the one to the details, hints of the link to the bases in their order, and what it may
#: not be about; the parts of a detail page and the labels in its head.
DETAIL_LINK = "convpostularavisotrabajo"
BASES = ("bases", "bases del concurso", "bases administrativas", "tdr", "termino de referencia", "términos de referencia", "perfil", "convocatoria")
NOT_BASES = ("privacidad", "privacy", "cookies", "aviso legal", "terminos de uso", "términos de uso")
FRAME = "avisopizarronficha.aspx"
HEADING_TAGS = ("h1", "h2", "h3", "h4", "h5", "h6")


def _without(page: Column, node: Column, *tags: str) -> Column:
    """The text of a node without that of these elements in it."""
    inner = F.filter(M.under(page, node), lambda x: x["tag"].isin(*tags))
    kept = F.filter(F.transform(F.slice(page["texts"], node["first"] + 1, node["past"] - node["first"]), lambda t, i: F.struct(t.alias("t"), (i + node["first"]).alias("i"))), lambda s: ~F.exists(inner, lambda x: (x["first"] <= s["i"]) & (x["past"] > s["i"])))
    return clean(F.array_join(F.transform(kept, lambda s: s["t"]), " "))


def listed_cards(pages: DataFrame) -> DataFrame:
    """The cards of a portal's chained pages (as `chained` takes them), each detail address once, the first: portal, url,
    turn, at, cargo, institucion, descripcion, fecha_publicacion, fecha_cierre, externo (digits of its address). A badge in
    the title's place gives way to the next heading."""
    c, page = F.col, F.col("page")
    boxes = F.filter(page["nodes"], lambda n: (n["tag"] == "div") & M.has_class(n, "caja") & M.has_class(n, "row"))
    usable = lambda n: F.filter(M.under(page, n), lambda a: M.is_link(a) & ~M.attr(a, "href").rlike("^(#|javascript:)|^$"))
    named = lambda n: first(F.filter(usable(n), lambda a: F.contains(F.lower(M.attr(a, "href")), F.lit(DETAIL_LINK)) | (F.lower(M.said(page, a)) == "ver bases")))
    link = lambda n: F.coalesce(M.attr(named(n), "href"), M.attr(first(usable(n)), "href"))
    rows = chained(pages, F.array_compact(F.transform(boxes, link)))
    badge = lambda t: F.lower(t).rlike("^solo difusi[oó]n") | (t == "")

    def read(n: Column) -> Column:
        pick = lambda fits: first(F.filter(M.under(page, n), fits))
        by_id = lambda name: pick(lambda x: (x["tag"] == "div") & (M.attr(x, "id") == name))
        heads = F.filter(F.transform(F.filter(M.under(page, n), lambda x: x["tag"].isin("h2", "h3", "h4", "b") | M.has_class(x, "card-title")), lambda x: M.said(page, x)), lambda t: ~badge(t))
        title = F.coalesce(M.said(page, by_id("bx_titulos")), F.lit(""))
        summary = by_id("bx_resumen")
        within = lambda tag: M.let(summary, lambda r: M.said(page, first(F.filter(M.under(page, r), lambda x: x["tag"] == tag))))
        return F.struct(
            n["at"].alias("at"), M.let(title, lambda t: F.when(badge(t), first(heads)).otherwise(t)).alias("cargo"), within("strong").alias("institucion"), M.let(summary, lambda r: _without(page, r, "strong", "em")).alias("descripcion"),
            F.coalesce(F.nullif(within("em"), F.lit("")), M.said(page, n)).alias("plazos"), link(n).alias("href"),
        )

    found = rows.select("portal", "turn", c("url").alias("base"), F.explode(F.transform(boxes, read)).alias("k")).select("portal", "turn", "base", "k.*").where("href IS NOT NULL AND cargo IS NOT NULL")
    found = found.withColumn("url", joined_url(c("href"), c("base"))).withColumn("r", DT.date_range(c("plazos")))
    row = F.struct("turn", "at", "cargo", last_part(c("institucion")).alias("institucion"), F.nullif("descripcion", F.lit("")).alias("descripcion"), c("r.start").alias("fecha_publicacion"), c("r.stop").alias("fecha_cierre"))
    one = found.groupBy("portal", "url").agg(F.min_by(row, F.struct("turn", "at")).alias("r"))
    return one.select("portal", "url", "r.*", F.nullif(F.regexp_extract("url", "(\\d{3,})", 1), F.lit("")).alias("externo"))


def last_part(text: Column) -> Column:
    """The last part of a hierarchy that slashes divide."""
    return F.element_at(F.filter(F.transform(F.split(text, "/"), clean), lambda x: x != ""), -1)


def bases_link(page: Column, url: Column) -> Column:
    """The link to the bases: by the first hint that any link has, in the hints' order, else the first PDF, else the page
    itself; never one about privacy or terms of use."""
    links = F.transform(F.filter(page["nodes"], M.is_link), lambda a: F.struct(M.attr(a, "href").alias("href"), F.lower(M.said(page, a)).alias("text")))
    fine = F.filter(links, lambda x: ~contains_any(x["text"], NOT_BASES) & ~contains_any(F.lower(x["href"]), NOT_BASES))
    ranked = F.transform(fine, lambda x, i: F.struct(F.coalesce(*[F.when(F.contains(x["text"], F.lit(h)) | F.contains(F.lower(x["href"]), F.lit(h)), k) for k, h in enumerate(BASES)], F.when(F.contains(F.lower(x["href"]), F.lit(".pdf")), len(BASES))).alias("rank"), i.alias("i"), x["href"].alias("href")))
    best = M.let(F.array_min(F.filter(ranked, lambda x: x["rank"].isNotNull())), lambda b: joined_url(b["href"], url))
    return F.coalesce(best, url)


def calendar(page: Column) -> Column:
    """struct(start, stop): of the first table that speaks of applications or publication, the dates beside that label."""
    speaks = lambda t: normal(t).rlike("postulacion|difusion")
    tables = F.filter(page["nodes"], lambda n: (n["tag"] == "table") & speaks(M.said(page, n)))
    cells = lambda r: F.filter(M.under(page, r), lambda x: x["tag"].isin("td", "th"))
    pairs = lambda t: F.transform(F.filter(M.under(page, t), lambda x: x["tag"] == "tr"), lambda r: M.let(cells(r), lambda cs: F.when(F.size(cs) >= 2, F.struct(M.said(page, F.get(cs, F.lit(0))).alias("label"), M.said(page, F.get(cs, F.lit(1))).alias("value")))))
    hits = F.filter(F.flatten(F.transform(tables, pairs)), lambda x: speaks(x["label"]))
    return M.let(first(hits), lambda x: DT.date_range(x["value"]))


def headed(page: Column, box: str) -> Column:
    """map of the headings in a part of the page (by its id) to the text up to the next heading."""
    node = first(F.filter(page["nodes"], lambda n: M.attr(n, "id") == box))

    def read(n: Column) -> Column:
        heads = F.filter(M.under(page, n), lambda x: x["tag"].isin(*HEADING_TAGS))
        spans = F.transform(heads, lambda h, i: F.struct(normal(M.said(page, h)).alias("k"), h["past"].alias("a"), F.coalesce(F.get(heads, i + 1)["first"], n["past"]).alias("b")))
        said = F.transform(spans, lambda s: F.struct(s["k"].alias("k"), clean(F.array_join(F.slice(page["texts"], s["a"] + 1, s["b"] - s["a"]), " ")).alias("v")))
        kept = F.filter(said, lambda s: (s["k"] != "") & (s["v"] != ""))
        lasting = F.filter(F.transform(kept, lambda s, i: F.struct(s["k"].alias("k"), s["v"].alias("v"), i.alias("i"))), lambda s: ~F.exists(kept, lambda o: (o["k"] == s["k"]) & (o["v"] != s["v"])) | (F.element_at(F.filter(kept, lambda o: o["k"] == s["k"]), -1)["v"] == s["v"]))
        return F.map_from_entries(F.array_distinct(F.transform(lasting, lambda s: F.struct(s["k"], s["v"]))))

    return M.let(node, lambda n: F.when(n.isNotNull(), read(n)))


def section(page: Column, box: str) -> Column:
    """The text of a part of the page without its headings."""
    return M.let(first(F.filter(page["nodes"], lambda n: M.attr(n, "id") == box)), lambda n: F.nullif(_without(page, n, *HEADING_TAGS), F.lit("")))


def with_portal_details(cards: DataFrame, details: DataFrame) -> DataFrame:
    """Cards with what their detail pages (url, html) say; a page that only frames another one is replaced by it."""
    c, page = F.col, F.col("page")
    pages = details.groupBy("url").agg(F.min("html").alias("html")).withColumn("page", M.tree(c("html")))
    frame = first(F.filter(page["nodes"], lambda n: (n["tag"] == "iframe") & M.attr(n, "src").isNotNull() & ((M.attr(n, "id") == "ifFicha") | F.contains(M.attr(n, "src"), F.lit(FRAME)))))
    framed = pages.select(c("url").alias("__url"), "page", joined_url(M.attr(frame, "src"), c("url")).alias("__frame"))
    inner = pages.select(c("url").alias("__inner"), c("page").alias("__page"))
    read = framed.join(inner, c("__frame") == c("__inner"), "left").select("__url", F.coalesce("__page", "page").alias("page"))
    rows = cards.join(read, c("url") == c("__url"), "left").withColumn("meta", headed(page, "lblAvisoTrabajoDatos")).withColumn("work", headed(page, "lblFunciones")).withColumn("days", calendar(page))
    meta = lambda *names: F.coalesce(*[F.try_element_at("meta", F.lit(n)) for n in names])
    blocks = lambda *pairs: F.nullif(F.array_join(F.array_compact(F.array(*[F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v)) for k, v in pairs])), "\n\n"), F.lit(""))
    work = blocks(*[(k, F.try_element_at("work", F.lit(k.lower()))) for k in ("Objetivo del cargo", "Funciones del cargo")])
    needs = blocks(("Formacion educacional", section(page, "lblFormacion")), ("Especializacion y capacitacion", section(page, "lblEspecializaciones")), ("Experiencia", section(page, "lblExperiencias")))
    pay = F.concat_ws(" | ", section(page, "lblRenta"), section(page, "lblCondiciones"), section(page, "lblTexto"))
    rows = rows.withColumn("pay", pay)
    span, has = pay_between(c("pay")), c("__url").isNotNull()
    return rows.select(
        "portal", "url", "turn", "at", "externo", F.coalesce(meta("convocatoria", "cargo"), "cargo").alias("cargo"), F.coalesce(last_part(meta("institucion", "institucion / entidad")), "institucion").alias("institucion"), F.coalesce(work, "descripcion").alias("descripcion"),
        F.when(has, needs).alias("requisitos"), LB.contract_key(meta("tipo de vacante")).alias("tipo_contrato"), LB.region_name(meta("region")).alias("region"), meta("ciudad").alias("ciudad"), meta("jornada").alias("jornada"), F.coalesce(meta("area de trabajo"), site_area(c("cargo"))).alias("area"),
        span["low"].alias("renta_min"), span["high"].alias("renta_max"), grade(c("pay")).alias("grado"), F.coalesce("days.start", "fecha_publicacion").alias("fecha_publicacion"), F.coalesce("days.stop", "fecha_cierre").alias("fecha_cierre"), F.when(has, bases_link(page, c("url"))).alias("url_bases"),
    )

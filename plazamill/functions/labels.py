"""Labels from text: areas, levels, contracts, platforms, laws, mail addresses, links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as TB
from .lookups import contains_any, count_of, first_group, first_word
from .text import ascii_fold, clean, normal, strip_accents

#: Words in a lower-case title and the professional area; the first group decides.
AREAS = (
    (("abogad", "juridic", "jurídic", "legal", "fiscal"), "Derecho"),
    (("médic", "medic", "enfermer", "kinesiol", "matron", "salud", "psiquiatr", "farmac"), "Salud"),
    (("ingenier", "técnic", "tecnolog"), "Ingeniería"),
    (("trabajador social", "asistente social", "social"), "Ciencias Sociales"),
    (("psicolog",), "Psicología"),
    (("contador", "contabilidad", "auditor", "finanz"), "Finanzas"),
    (("econom",), "Economía"),
    (("sistem", "informát", "computaci", "software", "datos", "ti ", " ti,", "tecnología inform"), "TI"),
    (("architect", "diseñ"), "Arquitectura/Diseño"),
    (("educad", "docent", "profesor", "pedagog"), "Educación"),
    (("comunicacion", "comunicación", "periodist", "relacione"), "Comunicaciones"),
    (("administr", "gestión", "gestión de personas", "rrhh", "recursos humanos"), "Administración"),
    (("agrón", "agron", "veterinar", "forestal", "agropecuar"), "Agropecuario/Forestal"),
    (("geolog", "geógraf", "ambiental", "ambient"), "Medioambiente"),
    (("fiscaliz", "inspector"), "Fiscalización"),
)
#: Words in a lower-case title and its level.
LEVELS = (
    (("director", "jefe", "encargado", "coordinador", "subdirector"), "Directivo"),
    (("médico", "abogado", "ingeniero", "psicólogo", "asistente social", "trabajador social", "arquitecto", "contador", "periodista", "educador", "matrón", "enfermero", "kinesiólogo"), "Profesional"),
    (("técnico", "paramédico", "tens"), "Técnico"),
    (("administrativo", "secretaria", "digitador"), "Administrativo"),
    (("auxiliar", "conductor", "chofer", "guardia", "jardinero"), "Auxiliar"),
)
#: Patterns of contracts, working days and modalities; the first decides.
CONTRACTS = (("honorarios?", "honorarios"), ("contrata", "contrata"), ("planta", "planta"), ("c[oó]digo del trabajo", "codigo_trabajo"), ("plazo fijo", "plazo_fijo"), ("reemplazo", "reemplazo"))
WORKDAYS = (("jornada completa", "completa"), ("media jornada|jornada parcial", "parcial"))
MODALITIES = (("h[ií]brid", "hibrida"), ("remot|teletrabajo", "remota"), ("presencial", "presencial"))
#: Cues of the capital's region, then regions and towns that name one, in order.
CAPITAL = ("santiago", "metropolitana", "providencia", "ñuñoa", "nunoa", "independencia", "estacion central", "estación central", "las condes", "maipu", "maipú")
REGION_CUES = (
    "arica", "tarapaca", "antofagasta", "atacama", "coquimbo", "valparaiso", "valparaíso", "ohiggins", "maule", "nuble", "ñuble", "biobio", "biobío", "araucania", "araucanía", "los rios", "los ríos",
    "los lagos", "aysen", "aysén", "magallanes", "punta arenas", "talca",
)
TOWNS = (
    "santiago", "providencia", "ñuñoa", "independencia", "estación central", "antofagasta", "valparaíso", "viña del mar", "concepción", "temuco", "valdivia", "puerto montt", "punta arenas", "talca", "iquique",
)
#: Platform names that stay, and their difficulty; others are a site of one's own.
PLATFORMS = ("WordPress", "Sitio propio Joomla", "Sitio propio", "SPA JavaScript", "PHP propio", "HiringRoom", "Buk (RRHH)", "Trabajando.cl/OMIL", "empleospublicos.cl")
EASY, HARD = ("empleospublicos.cl", "HiringRoom", "Buk (RRHH)", "Trabajando.cl/OMIL"), ("SPA JavaScript", "Vue.js SPA")
#: Patterns of links to outside platforms; the first link that fits one decides, by its first pattern.
OUTSIDE = (
    (r"empleospublicos\.cl", "empleospublicos.cl"), (r"hiringroomcampus\.com", "HiringRoom"), (r"\.hiringroom\.com", "HiringRoom"), (r"\.buk\.cl", "Buk (RRHH)"), (r"buk\.works", "Buk (RRHH)"),
    (r"trabajando\.cl", "Trabajando.cl/OMIL"), (r"\.omil\.cl", "Trabajando.cl/OMIL"), ("reqlut", "Reqlut"), ("procit", "Procit"),
)
#: Reasons that the run log keeps as they are.
OLD_MOTIVES = ("keyword_negativa", "sin_keywords", "vencida", "duplicada", "fecha_invalida", "contenido_vacio")
#: Words in the file name of an attachment that matters.
ATTACHMENTS = "bases|perfil|tdr|t[eé]rminos? de referencia|anexo|concurso|convocatoria"
ADDRESS = r"^[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}$"


def area(title: Column) -> Column:
    return first_group(F.lower(title), AREAS, "Administración")


def level(title: Column) -> Column:
    return first_group(F.lower(title), LEVELS, "Profesional")


def _by_pattern(text: Column, table) -> Column:
    out = F.lit(None).cast("string")
    for pattern, label in reversed(table):
        out = F.when(text.rlike(f"(?iu){pattern}"), label).otherwise(out)
    return out


def contract_terms(text: Column) -> Column:
    """struct(contract, workday, modality)."""
    t = F.coalesce(text, F.lit(""))
    return F.struct(_by_pattern(t, CONTRACTS).alias("contract"), _by_pattern(t, WORKDAYS).alias("workday"), _by_pattern(t, MODALITIES).alias("modality"))


def place_cues(text: Column, region_name) -> Column:
    """struct(region, town) by words of a text; region_name turns a cue into a region's name."""
    t = F.lower(text)
    town = first_word(t, TOWNS)
    region = F.when(contains_any(t, CAPITAL), "Metropolitana de Santiago").otherwise(region_name(first_word(t, REGION_CUES)))
    return F.struct(F.when(t != "", region).alias("region"), F.initcap(town).alias("town"))


def platform(name: Column) -> Column:
    """struct(platform, difficulty, needs_js)."""
    kept = F.when(name.isin(*PLATFORMS), name).otherwise("Sitio propio")
    return F.struct(kept.alias("platform"), F.when(name.isin(*EASY), "Baja").when(name.isin(*HARD), "Alta").otherwise("Media").alias("difficulty"), F.when(name.isin(*HARD), "Sí").otherwise("No").alias("needs_js"))


def outside_platform(links: Column) -> Column:
    """struct(platform, link) of the first link that names an outside platform, or null."""
    hit = lambda x: _by_pattern(F.lower(x), OUTSIDE)
    found = F.get(F.filter(links, lambda x: hit(x).isNotNull()), 0)
    return F.when(found.isNotNull(), F.struct(hit(found).alias("platform"), found.alias("link")))


def page_platform(html: Column, powered_by: Column) -> Column:
    """struct(platform, reason) by generator tag, paths, script frameworks and the server's header."""
    h = F.lower(html)
    tag = F.regexp_extract(h, "<meta\\s+name=[\"']generator[\"']\\s+content=[\"']([^\"']+)", 1)
    has = lambda m: F.contains(h, F.lit(m))
    row = lambda p, r: F.struct(F.lit(p).alias("platform"), (F.lit(r) if isinstance(r, str) else r).alias("reason"))
    by_tag = lambda prefix: F.concat(F.lit(prefix), F.substring(tag, 1, 40))
    return (
        F.when(F.contains(tag, F.lit("wordpress")), row("WordPress", by_tag("meta:")))
        .when(F.contains(tag, F.lit("joomla")), row("Sitio propio Joomla", by_tag("meta:")))
        .when(F.contains(tag, F.lit("drupal")), row("Sitio propio", by_tag("Drupal meta:")))
        .when(has("/wp-content/") | has("/wp-includes/"), row("WordPress", "wp-content"))
        .when(has("/components/com_") | has("media/jui/") | has("/templates/system/"), row("Sitio propio Joomla", "paths joomla"))
        .when((has('id="app"') | has('id="root"')) & (has("vue.js") | has("vue.min") | has("react-dom")), row("SPA JavaScript", "SPA Vue/React"))
        .when(F.contains(F.lower(F.coalesce(powered_by, F.lit(""))), F.lit("php")), row("PHP propio", "X-Powered-By:PHP"))
        .otherwise(row("Sitio propio", "html estatico"))
    )


def link_score(text: Column, href: Column) -> Column:
    """struct(score, trace): strong words count; weak ones only below 4; dated, news, PDF and long links lose."""
    t, h = F.trim(F.lower(text)), F.trim(F.lower(href))

    def hits(c, words, mark):
        return F.transform(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(c, w)), lambda w: F.concat(F.lit(mark), w))

    marked = [hits(t, TB.LINK_STRONG_TEXT, "T+"), hits(h, TB.LINK_STRONG_HREF, "H+"), hits(t, TB.LINK_WEAK_TEXT, "t+"), hits(h, TB.LINK_WEAK_HREF, "h+")]
    n = [F.size(m) for m in marked]
    strong = n[0] * 5 + n[1] * 4
    weak = strong < 4
    none = F.array().cast("array<string>")
    losses = ((h.rlike("/20[0-9]{2}/[0-9]{1,2}(/[0-9]{1,2})?/"), 10, "-fecha"), (h.rlike("/noticias?/"), 5, "-noticia"), (h.endswith(".pdf"), 3, "-pdf"), (F.length(text) > 100, 3, "-texto_largo"))
    score = strong + F.when(weak, n[2] * 3 + n[3] * 2).otherwise(0)
    for hit, points, _ in losses:
        score = score - hit.cast("int") * points
    trace = F.concat(marked[0], marked[1], F.when(weak, F.concat(marked[2], marked[3])).otherwise(none), F.array_compact(F.array(*[F.when(hit, m) for hit, _, m in losses])))
    return F.struct(score.alias("score"), trace.alias("trace"))


def domain_variations(url: Column, name: Column) -> Column:
    """Sorted candidate sites for a town's name, without the known one."""
    bare = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), "^www\\.", "")
    plain = F.regexp_replace(F.lower(name), "municipalidad\\s+de\\s+", "")
    for article in ("la", "el", "los", "las"):
        plain = F.regexp_replace(plain, f"^{article}\\s+", "")
    plain = F.translate(plain, "áéíóúñü", "aeiounu")
    slugs = F.filter(F.array(F.regexp_replace(plain, "[^a-z0-9]", ""), F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]", "-"), "^-+|-+$", "")), lambda s: s != "")
    made = [("https://", p, m, t) for p in ("www.", "") for m, t in (("", ".cl"), ("", ".gob.cl"), ("municipalidad", ".cl"), ("municipalidadde", ".cl"), ("muni", ".cl"), ("i", ".cl"))] + [("http://", p, "", ".cl") for p in ("www.", "")]
    every = F.flatten(F.transform(slugs, lambda s: F.array(*[F.concat(F.lit(a + p + m), s, F.lit(t)) for a, p, m, t in made])))
    sites = F.array_distinct(F.concat(F.array(F.concat(F.lit("https://"), bare), F.concat(F.lit("http://"), bare)), every))
    return F.array_sort(F.filter(sites, lambda x: ~x.isin(url, F.replace(url, F.lit("https://"), F.lit("http://")))))


def mail_check(address: Column) -> Column:
    """struct(valid, address, suggestion, disposable, reason)."""
    a = F.lower(F.trim(address))
    local, domain = F.split_part(a, F.lit("@"), F.lit(1)), F.split_part(a, F.lit("@"), F.lit(2))
    right = {t: d for d, typos in TB.MISSPELT.items() for t in typos}
    right["gmail.cl"] = "gmail.com"
    typo = F.try_element_at(F.create_map(*[F.lit(x) for kv in right.items() for x in kv]), domain)
    gone = domain.isin(*TB.DISPOSABLE)
    reason = (
        F.when(~F.coalesce(a.rlike(ADDRESS), F.lit(False)), "Formato de email inválido")
        .when(F.length(local) > 64, "Parte local del email demasiado corta o larga")
        .when(gone, "Dominio de email temporal o desechable. Usa un email permanente.")
    )
    fine = reason.isNull()
    return F.struct(fine.alias("valid"), a.alias("address"), F.when(fine & typo.isNotNull(), F.concat(local, F.lit("@"), typo)).alias("suggestion"), F.coalesce(reason.startswith("Dominio"), F.lit(False)).alias("disposable"), reason.alias("reason"))


def region_name(region: Column) -> Column:
    """The display name of a region as written anywhere."""
    kept = F.trim(region)
    key = F.upper(clean(F.replace(strip_accents(kept), F.lit("."), F.lit(""))))
    alias = F.try_element_at(F.create_map(*[F.lit(x) for kv in TB.REGION_ALIASES.items() for x in kv]), key)
    return F.when(F.coalesce(kept, F.lit("")) == "", "").when(alias.isNotNull(), alias).when(kept.rlike("(?iu)^regi[oó]n\\s+"), kept).otherwise(F.concat(F.lit("Región de "), kept))


def contract_key(value: Column) -> Column:
    key = clean(F.regexp_replace(F.lower(strip_accents(F.trim(value))), "[^a-z0-9\\s]", " "))
    has = lambda *words: contains_any(key, words)
    return (
        F.when(F.coalesce(key, F.lit("")) == "", "sin_datos").when(has("planta"), "planta").when(has("contrata"), "contrata").when(has("honorario"), "honorarios")
        .when(has("codigo") & has("trabajo"), "codigo_trabajo").when(has("reemplazo", "suplencia"), "reemplazo").when(has("no informa", "no especifica", "sin especificar"), "no_informa").otherwise("otro")
    )


def law(name: Column, short: Column, sector: Column, kind: Column) -> Column:
    """struct(law, title, norm, source) that rules an institution: by its name or abbreviation, else by sector."""
    row = lambda a, b, c, d: F.struct(F.lit(a).alias("law"), F.lit(b).alias("title"), F.lit(c).alias("norm"), F.lit(d).alias("source"))
    n, s = F.lower(name), F.lower(F.coalesce(sector, F.lit("")))
    out = None
    for key, *found in TB.LAWS:
        hit = F.contains(n, F.lit(key.lower())) | F.coalesce(F.lower(short) == key.lower(), F.lit(False))
        out = F.when(hit, row(*found, "bcn_directo")) if out is None else out.when(hit, row(*found, "bcn_directo"))
    town = row("Ley 18.883", "Estatuto Administrativo para Funcionarios Municipales", "30132", "estatuto_sector")
    code = row("DFL 1 (Trabajo, 2002)", "Código del Trabajo", "207436", "estatuto_sector")
    rest = row("Ley 18.834", "Estatuto Administrativo", "30099", "estatuto_sector")
    return out.when(F.contains(s, F.lit("municipal")) | F.contains(n, F.lit("municipalidad")), town).when(F.contains(F.lower(F.coalesce(kind, F.lit(""))), F.lit("honorario")), code).otherwise(rest)


def old_motive(reason: Column) -> Column:
    return F.when(reason.isin(*OLD_MOTIVES), reason).when(contains_any(reason, ("salary", "institution", "catalog")), "fecha_invalida").otherwise("keyword_negativa")


def job_gate(title: Column, body: Column) -> Column:
    """struct(accept, reason, word): hard words, then other words in the title reject; a job word anywhere accepts."""
    t = normal(title)
    both = F.concat(t, F.lit(" "), normal(body))
    hard, soft, good = first_word(t, TB.HARD_REJECT_WORDS), first_word(t, TB.REJECT_WORDS), first_word(both, TB.JOB_WORDS)
    row = lambda a, r, w: F.struct(F.lit(a).alias("accept"), F.lit(r).alias("reason"), w.alias("word"))
    blank = F.trim(F.coalesce(title, F.lit(""))) == ""
    return (
        F.when(blank, row(False, "contenido_vacio", F.lit(""))).when(hard.isNotNull(), row(False, "keyword_negativa", hard)).when(soft.isNotNull(), row(False, "keyword_negativa", soft))
        .when(good.isNotNull(), row(True, "ok", good)).otherwise(row(False, "sin_keywords", F.lit("")))
    )


def blog_gate(title: Column, body: Column) -> Column:
    """Whether a blog post is a posting: words of the title decide, else two words of the body."""
    t, b = normal(title), normal(body)
    short = F.length(clean(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(body, F.lit(""))))) < 8
    hits = count_of(b, ("concurso", "cargo", "postulacion", "seleccion", "contrata", "planta"))
    return F.when(short, False).when(contains_any(t, TB.WP_TITLE_REJECT), False).when(contains_any(t, TB.WP_TITLE_JOB), True).otherwise(hits >= 2)


def availability(error: Column, status: Column, body: Column, content_type: Column) -> Column:
    b = F.trim(F.regexp_replace(ascii_fold(body), "\\s+", " "))
    bot = contains_any(b, TB.BOT_MARKERS)
    return (
        F.when(error.isin("timeout", "dns_error", "ssl_error", "redirect_loop"), error).when(status == 404, "http_404").when((status == 403) & bot, "blocked_by_bot_protection").when(status == 403, "http_403")
        .when(status >= 500, "http_500").when((b == "") & ~F.contains(F.coalesce(content_type, F.lit("")), F.lit("pdf")), "empty_response").when(bot, "blocked_by_bot_protection")
        .when(contains_any(b, TB.JS_MARKERS) & (F.length(b) < 500), "js_required").otherwise("ok")
    )


def attachment_matters(url: Column) -> Column:
    name = F.lower(F.substring_index(url, "/", -1))
    return name.endswith(".pdf") & name.rlike(ATTACHMENTS)


def job_title(title: Column, headings: Column, more: Column) -> Column:
    """A labelled title, else the first heading of two words, else the page's title."""
    joined = F.concat_ws("\n", F.coalesce(title, F.lit("")), F.array_join(headings, " "), F.coalesce(more, F.lit("")))
    labelled = [F.nullif(F.trim(F.regexp_extract(joined, f"(?iu){p}[:\\s]+([^\\n.]+)", 1)), F.lit("")) for p in ("nombre del cargo", "cargo", "se requiere")]
    wide = F.get(F.filter(headings, lambda h: F.size(F.split(clean(h), " ")) >= 2), 0)
    return F.coalesce(*labelled, F.trim(wide), title)

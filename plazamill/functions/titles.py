"""Titles and bodies for display: cleaning, collapsing, cutting, splitting, paragraphs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as TB
from .context import matches
from .text import clean, strip_accents

#: Texts after which a page repeats itself, and heads of requirements.
BOILERPLATE = "[0-9]+\\s+personas han compartido su experiencia postulando|ver experiencias completas"
REQUIREMENTS = "(?:documentos necesarios|requisitos(?: principales)?|perfil requerido|lo que necesitas|para postular[,\\s]+(?:debes|necesitas|env[íi]a)|antecedentes\\s+requeridos|curriculum vitae\\b)"
LETTER = "A-Za-zÁÉÍÓÚÜÑáéíóúüñ"
#: Codes, quantities and heads before a title.
CODE = "(?i)^\\s*(?:c[oó]d(?:igo)?[:\\s-]*)?(?:[a-z]{0,4}[0-9]{1,5}[a-z]{0,4}(?:[-/][0-9]{1,5}[a-z]{0,4})+|[0-9]{1,5}[a-z]{0,4}(?:[-/][0-9]{1,5}[a-z]{0,4})+)\\s+"
MONTH = {m: i for i, m in enumerate("enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(), 1)}
#: What stands before a closing date in a post.
CLOSING = "(?:cierre\\s+de\\s+postulaci[oó]n|plazo\\s+de\\s+postulaci[oó]n|fecha\\s+(?:l[ií]mite|de\\s+cierre|de\\s+vencimiento)|recepci[oó]n\\s+de\\s+antecedentes(?:\\s+hasta)?|postulaciones?\\s+(?:abiertas?\\s+)?hasta|postular\\s+hasta(?:\\s+el)?|hasta\\s+el\\s+(?:d[ií]a\\s+)?|v[eé]nce?(?:\\s+el)?|plazo\\s+hasta)[^0-9A-Za-z_áéíóúñ]{0,25}"
NUMERIC = "[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}"
WORDED = "(?:(?:lunes|martes|mi[ée]rcoles|jueves|viernes|s[áa]bado|domingo)\\s*)?([0-9]{1,2})\\s+de\\s+(enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre)(?:\\s+de\\s+([0-9]{4}))?"


def without_code(title: Column) -> Column:
    """A title without its code, a leading number, quantities of posts and a head like "Cargo:"."""
    s = F.regexp_replace(F.regexp_replace(F.coalesce(title, F.lit("")), CODE, ""), "(?iu)^\\s*[0-9]{1,3}\\s+(?=[a-záéíóúüñ])", "")
    s = F.regexp_replace(F.regexp_replace(s, "(?i)\\b[0-9]+\\s*(?:cargos?|vacantes?|cupos?|plazas?)\\b", ""), "(?i)^\\s*(?:cargos?|vacantes?|cupos?|plazas?)\\b[:\\s-]*", "")
    return F.trim(F.regexp_replace(F.regexp_replace(s, "^[\\s:;,.–—-]+", ""), "\\s{2,}", " "))


def capital(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))


def acronyms(text: Column) -> Column:
    """Dotted letters and known acronyms in capitals."""
    dotted = "(?:[A-Za-z]\\.){2,}(?:[A-Za-z]\\.?)?"
    parts = F.regexp_extract_all(text, F.lit(f"{dotted}|[0-9_{LETTER}]+|[^0-9_{LETTER}]"), F.lit(0))
    known = F.array(*[F.lit(w) for w in TB.TITLE_ACRONYMS])
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(f"^{dotted}$") | F.array_contains(known, F.upper(x)), F.upper(x)).otherwise(x)), "")


def tidy_title(title: Column) -> Column:
    """Cleaned title: shouted ones (capitals more than three times the small letters) are spelt word by word, with
    capitals, proper names and accents that the tables hold; others keep their spelling. Punctuation is closed up."""
    s = without_code(title)
    up, low = F.length(F.regexp_replace(s, "[^A-ZÁÉÍÓÚÜÑ]", "")), F.length(F.regexp_replace(s, "[^a-záéíóúüñ]", ""))
    shouted = (up > 0) & ((low == 0) | (up > 3 * F.greatest(low, F.lit(1))))
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    spelt = table(TB.TITLE_PROPER | {w: w.upper() for w in TB.TITLE_CAPITALS})
    accents, small = table(TB.TITLE_ACCENTS), F.array(*[F.lit(w) for w in TB.TITLE_SMALL])
    marks = F.regexp_extract_all(s, F.lit("\\s+|[-/(),.:;]|[^-/(),.:;\\s]+"), F.lit(0))
    is_word = lambda x: ~x.rlike("^(\\s+|[-/(),.:;])$")
    first = F.array_position(F.transform(marks, is_word), True)

    def word(x: Column, i: Column) -> Column:
        base = strip_accents(F.lower(x))
        plain = F.coalesce(F.try_element_at(accents, base), F.lower(x))
        kept = F.when((i + 1 > first) & F.array_contains(small, base), plain).otherwise(capital(plain))
        return F.when(is_word(x), F.coalesce(F.try_element_at(spelt, base), kept)).otherwise(x)

    calm = F.array_join(F.transform(marks, word), "")
    out = acronyms(capital(F.trim(F.regexp_replace(F.when(shouted, calm).otherwise(s), "\\s{2,}", " "))))
    out = F.regexp_replace(F.regexp_replace(out, "\\s+([,;:!?])", "$1"), "([,;:])(?=[^\\s0-9])", "$1 ")
    return F.trim(F.regexp_replace(out, "[ \\t]{2,}", " "))


def once(title: Column) -> Column:
    """A title said twice: its first words (two to half of them) if the rest begins or ends with them."""
    words = F.filter(F.split(title, "\\s+"), lambda w: w != "")
    n = F.size(words)

    def attempt(k: Column) -> Column:
        head, rest = F.array_join(F.slice(words, F.lit(1), k), " "), F.array_join(F.slice(words, k + 1, n), " ")
        return F.when(F.startswith(rest, head) | F.endswith(rest, head), head)

    tries = F.array_compact(F.transform(F.sequence(F.lit(2), F.floor(n / 2).cast("int")), attempt))
    return F.when(n >= 4, F.coalesce(F.get(tries, 0), title)).otherwise(title)


def before_boilerplate(text: Column) -> Column:
    at = F.regexp_instr(text, F.lit(f"(?i){BOILERPLATE}"))
    return F.when(at > 0, F.trim(F.substring(text, F.lit(1), at - 1))).otherwise(text)


def split_requirements(text: Column) -> Column:
    """struct(description, requirements): cut at the first head that stands 80 characters or more in."""
    at = F.regexp_instr(text, F.lit(f"(?iu){REQUIREMENTS}"))
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    cut = at > 80
    return F.struct(F.when(cut, some(F.substring(text, F.lit(1), at - 1))).otherwise(F.nullif(text, F.lit(""))).alias("description"), F.when(cut, some(F.substr(text, at))).alias("requirements"))


def escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def paragraphs(text: Column, most: int = 2000, width: int = 400) -> Column:
    """Sentences gathered to paragraphs of about `width` characters as escaped <p>; texts over `most` characters end
    in an ellipsis, which is the feature of this preview."""
    t = clean(F.coalesce(text, F.lit("")))
    t = F.when(F.length(t) > most, F.concat(F.regexp_replace(F.substring(t, 1, most - 1), "[ ,.\\-]+\\z", ""), F.lit("…"))).otherwise(t)
    sentences = F.filter(F.split(t, "(?<=[.!?])\\s+"), lambda s: s != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))

    def step(a: Column, s: Column) -> Column:
        full = (a["now"] != "") & (F.length(a["now"]) + F.length(s) > width)
        joined = F.when(a["now"] == "", s).otherwise(F.trim(F.concat(a["now"], F.lit(" "), s)))
        return F.struct(F.when(full, F.concat(a["done"], F.array(F.trim(a["now"])))).otherwise(a["done"]).alias("done"), F.when(full, s).otherwise(joined).alias("now"))

    parts = F.aggregate(sentences, start, step, lambda a: F.when(a["now"] != "", F.concat(a["done"], F.array(F.trim(a["now"])))).otherwise(a["done"]))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.lit("<p>"), escaped(p), F.lit("</p>"))), "")


def short_title(text: Column, most: int = 90) -> Column:
    """A long title cut at its first dash, bracket, sentence end or comma between the 21st and 119th character, else at
    a blank near `most`; full stops of abbreviations and initials end no sentence. No mark looks further ahead than
    three characters, so those of the whole text are found in its first 125."""
    within = lambda i: F.when((i > 20) & (i < 120), i)
    start = F.substring(text, 1, 125)
    first = lambda p: within(F.regexp_instr(start, F.lit(p)) - 1)

    def ends(m: Column) -> Column:
        i = m["start"]
        word = F.regexp_extract(F.substring(start, F.lit(1), i), "([A-Za-zÑñÁÉÍÓÚÜáéíóúü]*)\\z", 1)
        short = (F.length(word) == 1) & word.rlike("^[A-ZÑ]$") | ((i >= 2) & (F.substring(start, i - 1, F.lit(1)) == "."))
        return (i > 20) & (i < 120) & ((word == "") | ~(short | F.lower(word).isin(*TB.ABBREVIATIONS)))

    stop = F.get(F.filter(matches(start, "\\.(?=\\s|\\z)"), ends), 0)["start"]
    best = F.least(first("\\s[-–—]\\s"), first("\\s\\("), stop, first("[,;:](?=\\s|\\z)"))
    head = F.substring(text, 1, most)
    blank = F.length(head) - F.instr(F.reverse(head), " ")
    cut = F.when((F.instr(head, " ") > 0) & (blank > 50), F.substring(head, F.lit(1), blank)).otherwise(head)
    return F.when(F.length(text) <= most, text).when(best.isNotNull(), F.trim(F.substring(text, F.lit(1), best))).otherwise(F.concat(F.trim(cut), F.lit("…")))


def post_closing_date(text: Column, today: Column) -> Column:
    """The date right after a closing phrase (numeric or in words), phrase by phrase; else the first date in words.
    Two-digit years are of this century; words without a year take the year of today."""
    t = clean(F.coalesce(text, F.lit("")))

    def numeric(c: Column) -> Column:
        part = lambda g: F.regexp_extract(c, "^([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{2,4})", g)
        year = F.when(F.length(part(3)) == 2, F.concat(F.lit("20"), part(3))).otherwise(part(3))
        return F.try_to_date(F.concat_ws("-", year, part(2), part(1)), "y-M-d")

    def worded(c: Column) -> Column:
        part = lambda g: F.regexp_extract(c, f"(?iu){WORDED}", g)
        month = F.try_element_at(F.create_map(*[F.lit(x) for kv in MONTH.items() for x in kv]), F.lower(part(2)))
        return F.try_to_date(F.concat_ws("-", F.coalesce(F.nullif(part(3), F.lit("")), F.year(today).cast("string")), month.cast("string"), part(1)), "y-M-d")

    def after(m: Column) -> Column:
        rest = F.ltrim(F.substr(t, m["start"] + F.length(m["value"]) + 1))
        return F.coalesce(F.when(rest.rlike(f"^{NUMERIC}"), numeric(rest)), F.when(rest.rlike(f"(?iu)^{WORDED}"), worded(rest)))

    near = F.get(F.array_compact(F.transform(matches(t, f"(?iu){CLOSING}"), after)), 0)
    return F.coalesce(near, F.get(F.array_compact(F.transform(F.regexp_extract_all(t, F.lit(f"(?iu){WORDED}"), F.lit(0)), worded)), 0))

"""The rule engine of pages: weighted patterns, guards, thresholds, a fallback for the unclear, and the pipeline of a
page from its class to a scored posting.

Pages come as columns title, crumbs, hint, body, tables, attachments (texts), files (array of URLs), url, headings
(array), http_status. Scores are rounded to six digits before they meet a threshold.
"""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plazamill.functions import labels as LB
from plazamill.functions import policy_lists as PL
from plazamill.functions import sections as S
from plazamill.functions.dates import all_dates
from plazamill.functions.lookups import fits

#: Further positive rules as id, pattern, weight, reason and what they look at.
EXTRA = (
    ("url_recruitment", r"/trabaja-con-nosotros|/concursos|/postulacion|/ofertas-laborales|/rrhh|/transparencia/(activa/)?trabaje-con-nosotros", 0.16, "URL de reclutamiento", "url"),
    ("table_job_columns", r"cargo\s+.*renta.*cierre|renta.*cargo", 0.14, "tabla con estructura laboral", "tables"),
    ("email_postulacion", r"(enviar|remitir|postular).{0,45}[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}", 0.20, "correo explícito de postulación", "text"),
)
#: Which parts of a rule's id make it vouch for what.
ESSENTIALS = (("title", ("title", "cargo")), ("deadline", ("fecha", "cierre")), ("functions", ("funciones", "requisitos")), ("attachments", ("adjunto", "bases")), ("terms", ("renta", "contrat", "jornada")))
NEWS = r"noticias?|prensa|comunicado|bolet[ií]n|blog|sala\s*de\s*prensa"
#: Kinds of pages that are no posting, by the first pattern in address or text.
OTHER_KINDS = (
    (r"resultados?|n[oó]mina de seleccionados|adjudicaci[oó]n", "results_page"), (r"noticias?|prensa|comunicado|bolet[ií]n|blog", "news_article"), (r"evento|seminario|charla|taller|agenda", "event"),
    (r"archivo|hist[oó]rico|memoria anual", "historical_archive"),
)
#: Labels before dates of a call.
CALL_DATES = {
    "end": "(?:hasta el|cierre de postulaci[oó]n|plazo de postulaci[oó]n|recepci[oó]n de antecedentes hasta|postulaciones hasta)\\s*:?\\s*[^\\n.]{0,60}",
    "start": "(?:desde el|inicio de postulaci[oó]n|apertura de postulaci[oó]n|recepci[oó]n de antecedentes desde)\\s*:?\\s*[^\\n.]{0,60}",
    "published": "(?:publicad[oa]|fecha de publicaci[oó]n|publicaci[oó]n)\\s*:?\\s*[^\\n.]{0,60}",
}
CLOSED = "proceso finalizado|cerrado|adjudicado|n[oó]mina de seleccionados"


def positive_rules() -> list[tuple[str, str, float, str, str]]:
    slug = lambda k: re.sub(r"[^a-z0-9]+", "_", k.lower()).strip("_")
    return [(f"positive_{slug(k)}", r"\s+".join(re.escape(w) for w in k.split(" ")), 0.08, f"palabra clave positiva: {k}", "text") for k in PL.POSITIVE] + list(EXTRA)


def negative_rules() -> list[tuple[str, str, float, str, str]]:
    texts = [(f"negative_pattern_{i}", p, -0.20, f"patrón negativo #{i}", "text") for i, p in enumerate(PL.NEGATIVE, 1)]
    return texts + [(f"negative_url_{i}", re.escape(p), -0.25, f"URL negativa: {p}", "url") for i, p in enumerate(PL.NEGATIVE_URL, 1)]


def vouched() -> dict[str, list[int]]:
    """For each essential the places in positive_rules() of the rules that vouch for it."""
    return {name: [i for i, r in enumerate(positive_rules()) if any(p in r[0] for p in parts)] for name, parts in ESSENTIALS}


def years(today: date) -> tuple[str, str]:
    """Patterns of old years (two to six back) and of signs of the present."""
    y = today.year
    return rf"\b({'|'.join(str(x) for x in range(y - 6, y - 1))})\b", rf"\b({y - 1}|{y}|{y + 1}|vigente|abierto|postulaciones hasta|en curso)\b"


def historical(text: Column, today: date) -> Column:
    old, now = years(today)
    return text.rlike(old) & ~text.rlike(now)


def classified(pages: DataFrame, today: date, accept: float = 0.80, unclear: float = 0.55, essentials: int = 2) -> DataFrame:
    """Adds text, hits, misses (reasons of the rules that hold), essential, score, is_job, kind and why."""
    c = F.col
    blank = lambda n: F.coalesce(c(n), F.lit(""))
    text = F.lower(F.concat_ws("\n", *[blank(n) for n in ("title", "crumbs", "hint", "body", "tables", "attachments")]))
    out = pages.withColumn("text", text).withColumn("low_url", F.lower(blank("url"))).withColumn("low_tables", F.lower(blank("tables")))
    target = {"text": c("text"), "url": c("low_url"), "tables": c("low_tables")}
    flags = lambda rules: F.array(*[fits(target[r[4]], r[1]).cast("int") for r in rules])
    good, bad = positive_rules(), negative_rules()
    out = out.withColumn("g", flags(good)).withColumn("b", flags(bad))
    total = lambda name, rules: F.aggregate(F.zip_with(c(name), F.array(*[F.lit(r[2]) for r in rules]), lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)
    reasons = lambda name, rules: F.transform(F.filter(F.zip_with(c(name), F.array(*[F.lit(r[3]) for r in rules]), lambda x, r: F.struct(x.alias("x"), r.alias("r"))), lambda s: s["x"] == 1), lambda s: s["r"])
    held = {n: F.greatest(*[F.get("g", i) for i in at], F.lit(0)) for n, at in vouched().items()}
    out = out.withColumn("essential", sum(held.values(), F.lit(0))).withColumn("dated", held["deadline"] == 1)
    news = F.lower(F.concat_ws("\n", blank("url"), blank("title"), blank("crumbs"), blank("hint"))).rlike(NEWS) & ~c("dated")
    score = total("g", good) + total("b", bad) - F.when(c("essential") == 0, 0.25).otherwise(0.0) - F.when(news, 0.22).otherwise(0.0)
    out = out.withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(0.5) + score)), 6))
    none = F.array().cast("array<string>")
    out = out.withColumn("hits", reasons("g", good)).withColumn("misses", F.concat(
        reasons("b", bad), F.when(c("essential") == 0, F.array(F.lit("ausencia total de cargo/requisitos/fechas"))).otherwise(none), F.when(news, F.array(F.lit("contexto noticioso sin fecha de cierre verificable"))).otherwise(none)))
    row = lambda job, kind, why: F.struct(F.lit(job).alias("is_job"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), (F.lit(why).cast("string") if why is None or isinstance(why, str) else why).alias("why"))
    candidate = F.concat(blank("url"), F.lit(" "), c("text"))
    other = F.lit("informational_page")
    for pattern, kind in reversed(OTHER_KINDS):
        other = F.when(candidate.rlike(pattern), kind).otherwise(other)
    broken = c("http_status") >= 400
    decided = (
        F.when(broken, row(False, "broken_page", F.concat(F.lit("http_status="), c("http_status").cast("string")))).when(historical(c("text"), today), row(False, "historical_archive", "publicación histórica sin vigencia actual"))
        .when((c("score") >= accept) & (c("essential") >= essentials), row(True, F.when(F.contains(c("text"), F.lit("concurso")), "public_competition").otherwise("job_posting"), None))
        .when(c("score") >= accept, row(False, "informational_page", "faltan señales esenciales mínimas")).when(c("score") >= unclear, row(False, "unknown", "zona ambigua")).otherwise(row(False, other, "score bajo por reglas"))
    )
    old = F.coalesce(historical(c("text"), today) & ~F.coalesce(broken, F.lit(False)), F.lit(False))
    out = out.withColumn("misses", F.when(old, F.concat("misses", F.array(F.lit("aviso antiguo detectado")))).otherwise(c("misses"))).withColumn("score", F.when(broken, 0.0).otherwise(c("score"))).withColumn("d", decided)
    out = out.withColumn("confidence", F.when(broken, 1.0).when(old, 0.95).otherwise(c("score")))
    return out.select(*pages.columns, "text", "hits", "misses", "essential", "score", "confidence", "d.*")


def judge_by_words(title: Column, preview: Column) -> Column:
    """The deterministic judge of unclear pages: struct(is_job, kind, confidence, for_job, against). Any function of the
    same arguments and result can take its place in `resolved`."""
    t = F.lower(F.coalesce(preview, F.lit("")))
    good, bad = t.rlike("cargo|postulación|requisitos|funciones"), t.rlike("noticia|comunicado|evento|resultados")
    job = good | ~bad
    one = lambda c, text: F.when(c, F.array(F.lit(text))).otherwise(F.array().cast("array<string>"))
    return F.struct(job.alias("is_job"), F.when(job, "job_posting").otherwise("news_article").alias("kind"), F.lit(0.62).alias("confidence"), one(good, "fragmentos laborales presentes").alias("for_job"), one(bad, "fragmentos no laborales presentes").alias("against"))


def resolved(pages: DataFrame, today: date, judge=judge_by_words, preview: int = 1600, accept: float = 0.80, unclear: float = 0.55) -> DataFrame:
    """classified, with unclear pages given to the judge: scores between the thresholds, or pages with signs of both
    sides, a score of 0.40 and an open kind. The judge sees the first `preview` characters, as its protocol says."""
    c = F.col
    out = classified(pages, today, accept, unclear)
    ask = ((c("score") >= unclear) & (c("score") < accept)) | ((F.size("hits") > 0) & (F.size("misses") > 0) & (c("score") >= 0.40) & c("kind").isin("unknown", "news_article", "informational_page"))
    out = out.withColumn("asked", ask).withColumn("j", judge(c("title"), F.substring(F.coalesce("body", F.lit("")), 1, preview)))
    strong = F.exists("misses", lambda m: F.contains(m, F.lit("URL de noticias")) | F.contains(m, F.lit("resultados/cierre")))
    return out.withColumns({
        "is_job": F.when(c("asked"), c("j.is_job")).otherwise(c("is_job")), "kind": F.when(c("asked"), c("j.kind")).otherwise(c("kind")), "confidence": F.when(c("asked"), F.greatest("confidence", "j.confidence")).otherwise(c("confidence")),
        "hits": F.when(c("asked"), F.concat("hits", "j.for_job")).otherwise(c("hits")), "misses": F.when(c("asked"), F.concat("misses", "j.against")).otherwise(c("misses")), "contradiction": c("asked") & c("j.is_job") & strong,
    }).drop("j")


def call_dates(body: Column, tables: Column, attachments: Column, today: Column) -> Column:
    """struct(published, start, stop, expired, why, sure): labelled pieces of body (0.85), tables (0.9) and attachments
    (0.85 too, at least 0.8); the surest dated piece of a label counts, the first of equals. A date is the first numeric
    one of a piece."""
    sources = ((F.coalesce(tables, F.lit("")), 0.9), (F.coalesce(body, F.lit("")), 0.85), (F.coalesce(attachments, F.lit("")), 0.85))
    pieces = lambda text, label: F.regexp_extract_all(text, F.lit(f"(?iu){CALL_DATES[label]}"), F.lit(0))
    first = lambda text, label: F.get(F.array_compact(F.transform(pieces(text, label), lambda x: F.get(all_dates(x), 0))), 0)
    best = {label: F.coalesce(*[first(t, label) for t, _ in sources]) for label in CALL_DATES}
    said = F.lower(F.array_join(F.concat(*[pieces(t, label) for label in CALL_DATES for t, _ in (sources[1], sources[0], sources[2])]), " "))
    closed = said.rlike(CLOSED)
    aged = said.rlike("\\b(2020|2021|2022|2023|2024)\\b") & ~said.rlike("\\b2025|2026|vigente|abierto|en proceso\\b")
    past = best["end"] < today
    return F.struct(
        best["published"].alias("published"), best["start"].alias("start"), best["end"].alias("stop"), F.when(aged | closed, True).otherwise(past).alias("expired"),
        F.when(aged, "historical_year_without_current_signals").when(closed, "explicit_closed_signal").when(past, "application_end_at_in_past").alias("why"),
        F.when(aged, "medium").when(closed | best["end"].isNotNull(), "high").otherwise("low").alias("sure"),
    )


def quality_score(confidence: Column, kind: Column, contradiction: Column, fields: list[Column], pay: Column, requirements: Column, sure: Column) -> Column:
    """struct(score, review): confidence .30, six fields .25, dates .20, pay .10, requirements .15; less .2 for news and
    results; below .60 or contradictory: review."""
    held = sum((c.cast("double") for c in fields), F.lit(0.0)) / len(fields)
    dated = F.when(sure == "high", 0.95).when(sure == "medium", 0.65).otherwise(0.35)
    raw = confidence * 0.30 + held * 0.25 + dated * 0.20 + F.when(pay, 0.85).otherwise(0.25) * 0.10 + F.when(requirements, 0.85).otherwise(0.25) * 0.15 - F.when(kind.isin("news_article", "results_page"), 0.2).otherwise(0.0)
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 4)
    return F.struct(score.alias("score"), ((score < 0.60) | contradiction).alias("review"))


def expiry(kind: Column, is_job: Column, expired: Column, why: Column) -> Column:
    """The reason why a page is past, or null."""
    return F.when(kind.isin("results_page", "historical_archive", "news_article", "event"), F.concat(F.lit("content_type="), kind)).when(expired, F.coalesce(why, F.lit("expired"))).when((kind == "informational_page") & ~is_job, "informational_non_posting")


def missing(title: Column, functions: Column, requirements: Column, pay: Column, contract: Column, documents: Column, files: Column) -> Column:
    """The names of the four parts of a posting that are not there; two parts are enough."""
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    parts = {"title": some(title), "functions_or_requirements": (F.size(functions) > 0) | (F.size(requirements) > 0), "salary_or_contract": pay.isNotNull() | contract.isNotNull(), "documents_or_attachments": (F.size(documents) > 0) | (F.size(files) > 0)}
    return F.array_compact(F.array(*[F.when(~c, n) for n, c in parts.items()]))


def pipeline(pages: DataFrame, today: date) -> DataFrame:
    """Every page with what becomes of it: class, fields, dates, expiry, completeness, quality; `rejected` says why not."""
    c = F.col
    out = resolved(pages, today)
    matter = F.filter("files", LB.attachment_matters)
    out = out.withColumn("full", F.concat_ws("\n", F.coalesce("body", F.lit("")), F.coalesce("tables", F.lit("")), F.when(F.size(matter) > 0, F.coalesce("attachments", F.lit(""))).otherwise("")))
    out = out.withColumn("job_title", LB.job_title(c("title"), c("headings"), F.concat_ws("\n", F.coalesce("tables", F.lit("")), F.coalesce("attachments", F.lit("")))))
    out = out.withColumn("functions", S.functions(c("full"))).withColumn("r", S.requirements(c("full"))).withColumn("pay", S.pay_in_context(c("full"))).withColumn("terms", LB.contract_terms(c("full"))).withColumn("mail", S.mails(c("full")))
    out = out.withColumn("dates", call_dates(c("body"), c("tables"), c("attachments"), F.lit(today))).withColumn("past", expiry(c("kind"), c("is_job"), c("dates.expired"), c("dates.why")))
    out = out.withColumn("missing", missing(c("job_title"), c("functions"), c("r.required"), c("pay.amount"), c("terms.contract"), c("r.documents"), matter))
    fields = [F.coalesce(c("job_title"), F.lit("")) != "", F.size("functions") > 0, F.size("r.required") > 0, c("pay.amount").isNotNull(), c("terms.contract").isNotNull(), c("dates.stop").isNotNull()]
    out = out.withColumn("q", quality_score(c("confidence"), c("kind"), c("contradiction"), fields, c("pay.amount").isNotNull(), F.size("r.required") > 0, c("dates.sure")))
    rejected = F.when(~c("is_job"), F.coalesce("why", F.lit("non_job_content"))).when(c("past").isNotNull(), c("past")).when(F.size("missing") > 2, "minimum_completeness_failed")
    return out.withColumn("rejected", rejected).select(
        *pages.columns, "is_job", "kind", "score", "confidence", "asked", "rejected", "missing", "job_title", "functions", c("r.required").alias("requirements"), c("r.desirable").alias("desirable"), c("r.documents").alias("documents"), c("pay.amount").alias("amount"),
        c("terms.contract").alias("contract"), c("terms.workday").alias("workday"), c("terms.modality").alias("modality"), c("mail.channel").alias("channel"), c("dates.published").alias("published"), c("dates.start").alias("starts"), c("dates.stop").alias("ends"), c("q.score").alias("quality"), c("q.review").alias("review"),
    )

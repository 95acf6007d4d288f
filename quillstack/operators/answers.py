"""Contexts for answers, and analytics of answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import taxonomy as T
from ..functions import text as X
from ..functions.names import unused


def _line(label: str, value: Column) -> Column:
    return F.when(F.coalesce(value.cast("string"), F.lit("")) != "", F.concat(F.lit(label), value.cast("string"), F.lit("\n"))).otherwise("")


# The labels and the layout of a source in a context.
def source_block(rank: Column) -> Column:
    """One result as text: its source, optional lines and up to 1000 characters of content."""
    c = F.col
    notes = F.when((c("source_type") == "judgment") & (F.size("footnotes") > 0), F.concat(F.lit("Footnotes: "), F.array_join(F.slice("footnotes", 1, 3), ", "), F.lit("\n"))).otherwise("")
    summary = F.when(F.length(X.strip(c("summary"))) > 10, F.concat(F.lit("Summary: "), c("summary"), F.lit("\n"))).otherwise("")
    cut = F.when(F.length("content") > 1000, "...[Content truncated]\n").otherwise("")
    return F.concat(
        F.lit("=== SOURCE "), rank.cast("string"), F.lit(" ===\nDocument: "), c("document_name"), F.lit("\n"), _line("Page: ", c("page_number")), _line("Section: ", c("section")),
        F.coalesce(notes, F.lit("")), _line("Article: ", c("article")), F.coalesce(summary, F.lit("")), F.lit("Content:\n"), F.substring("content", 1, 1000), F.lit("\n"), cut,
    )


def context_text(results: DataFrame, by: str) -> DataFrame:
    """(by, rank, ...) -> (by, context): source blocks in rank order."""
    rows = results.select(by, F.struct("rank", source_block(F.col("rank")).alias("t")).alias("r"))
    return rows.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["t"]), "\n\n").alias("context"))


def structured_context(results: DataFrame, by: str) -> DataFrame:
    """Sources numbered by rank, treaty sources before judgments: by, source_id, list_ord and the source's fields."""
    return results.select(by, F.col("rank").alias("source_id"), F.when(F.col("source_type") == "judgment", 1).otherwise(0).alias("list_ord"), "document_name", "source_type", "page_number", "section", "article", "summary", F.substring("content", 1, 1000).alias("content"), "score")


# The layout of a line in the list of sources.
def source_line() -> Column:
    c = F.col
    part = lambda before, v, after="": F.when(F.coalesce(v.cast("string"), F.lit("")) != "", F.concat(F.lit(before), v.cast("string"), F.lit(after))).otherwise("")
    return F.concat(F.lit("Source "), c("source_id").cast("string"), F.lit(": "), c("document_name"), part(" (page ", c("page_number"), ")"), part(" - ", c("article")), part(" - ", c("section")), F.lit(" ["), c("source_type"), F.lit("]"))


def source_list(sources: DataFrame, by: str) -> DataFrame:
    rows = sources.select(by, F.struct("list_ord", "source_id", source_line().alias("t")).alias("r"))
    return rows.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["t"]), "\n").alias("sources"))


def citations(text: Column) -> Column:
    """Distinct citations of the families with their marks, sorted."""
    found = [_marked(X.all_matches(text, p, g, any_case), mark, k == 0) for k, (p, g, any_case, mark) in enumerate(T.CITATIONS)]
    return F.array_sort(F.array_distinct(F.concat(*found)))


def _marked(found: Column, mark: str, stripped: bool) -> Column:
    return F.transform(found, lambda m: F.concat(F.lit(mark), X.strip(m) if stripped else m, F.lit(mark)))


def section_text(text: Column, name: str) -> Column:
    """What follows the last heading of that name up to the next known heading; null without one."""
    names = "|".join(T.ANSWER_SECTIONS)
    return F.try_element_at(X.all_matches(text, rf"##\s+{name}(.*?)(?=##\s+(?:{names})|\z)", 1, dotall=True), F.lit(-1))


def section_citations(text: Column) -> Column:
    """struct of citations per section; section references don't count here."""
    families = [f for k, f in enumerate(T.CITATIONS) if k != 4]
    found = lambda own: F.array_sort(F.array_distinct(F.concat(*[_marked(X.all_matches(own, p, g, ac), mark, k == 0) for k, (p, g, ac, mark) in enumerate(families)])))
    # The text and each section's part of it are made once, not once a family.
    part = lambda t, name: X.let(F.coalesce(section_text(t, name), F.lit("")), found)
    return X.let(text, lambda t: F.struct(*[part(t, name).alias(key) for name, key in T.ANSWER_SECTIONS.items()]))


# Sections of consulted resources and their items.
_TREATY_PART = r"## Resources Consulted.*?### Geneva Convention Documents(.*?)(?=###|\z)"
_JUDGMENT_PART = r"### ICTY/ICC Judgments(.*?)(?=###|\z)"
_OTHER_PART = r"### Additional References(.*?)(?=##|\z)"
_DOCUMENT_ITEM = r"\*\*([^*]+)\*\*\s*-\s*`([^`]+)`\s*\(\*([^*]+)\*\)"
_CASE_ITEM = r"\*\*([^*]+)\*\*\s*\(\*([^*]+)\*\)\s*-\s*\[([^\]]+)\]"


def resources(text: Column) -> Column:
    """struct of arrays: treaty documents and other references (document_name, article, page), judgments (case_name, page, source_type)."""

    def items(part: str, item: str, names: list[str]) -> Column:
        own = F.regexp_extract(text, X.rx(part, True, dotall=True), 1)
        groups = [F.transform(X.all_matches(own, item, g), X.strip) for g in (1, 2, 3)]
        return F.transform(F.arrays_zip(*[g.alias(n) for g, n in zip(groups, names, strict=True)]), lambda s: F.struct(*[s[n].alias(n) for n in names]))

    doc, case = ["document_name", "article", "page"], ["case_name", "page", "source_type"]
    return F.struct(items(_TREATY_PART, _DOCUMENT_ITEM, doc).alias("geneva_documents"), items(_JUDGMENT_PART, _CASE_ITEM, case).alias("judgment_documents"), items(_OTHER_PART, _DOCUMENT_ITEM, doc).alias("additional_references"))


def with_resources(answers: DataFrame, sources: DataFrame, by: str) -> DataFrame:
    """Adds ``resources``; an answer without any takes them from its sources."""
    rows = sources.select(by, "list_ord", F.struct("source_id", "document_name", F.coalesce("article", F.lit("")).alias("article"), F.coalesce("page_number", F.lit("")).alias("page"), "source_type").alias("s"))
    r, t, j = (unused(answers, name) for name in ("own", "treaties", "judgments"))
    listed = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.when(F.col("list_ord") == 0, F.col("s")))).alias(t), F.array_sort(F.collect_list(F.when(F.col("list_ord") == 1, F.col("s")))).alias(j))
    own = answers.withColumn(r, resources(F.col("analysis"))).join(listed, by, "left")
    docs = F.transform(t, lambda s: F.struct(s["document_name"].alias("document_name"), s["article"].alias("article"), s["page"].alias("page")))
    cases = F.transform(j, lambda s: F.struct(s["document_name"].alias("case_name"), s["page"].alias("page"), s["source_type"].alias("source_type")))
    empty = F.size(f"{r}.geneva_documents") + F.size(f"{r}.judgment_documents") + F.size(f"{r}.additional_references") == 0
    fallback = F.struct(F.coalesce(docs, F.col(f"{r}.geneva_documents")).alias("geneva_documents"), F.coalesce(cases, F.col(f"{r}.judgment_documents")).alias("judgment_documents"), F.col(f"{r}.additional_references").alias("additional_references"))
    return own.withColumn("resources", F.when(empty, fallback).otherwise(F.col(r))).drop(r, t, j)


def key_findings(text: Column, most: int = 10) -> Column:
    """Bullets, then numbered lines, over 10 characters when stripped; the first ``most``."""
    found = F.concat(X.all_matches(text, r"[•\-\*]\s*([^\n]+)", 1), X.all_matches(text, r"\d+\.\s*([^\n]+)", 1))
    return F.slice(F.filter(F.transform(found, X.strip), lambda f: F.length(f) > 10), 1, most)


def confidence(n_sources: Column, text: Column) -> Column:
    return F.least(
        F.lit(1.0),
        F.least(n_sources / 10.0, F.lit(1.0)) + F.least(F.length(text) / 2000.0, F.lit(0.3)) + F.least(F.size(citations(text)) / 5.0, F.lit(0.2)) + F.least(F.size(key_findings(text)) / 3.0, F.lit(0.2)),
    )


def band(score: Column) -> Column:
    return F.when(score >= 0.8, "High").when(score >= 0.6, "Medium").otherwise("Low")


# Layout of a formatted answer.
_MARKS = {"High": "🟢", "Medium": "🟡", "Low": "🔴"}
_NO_ANALYSIS = "## 📋 Analysis\n\nNo detailed analysis available.\n\n"
_FOOTER = "---\n*This analysis is based on retrieved legal documents and should be verified against primary sources.*\n"


def format_response(question: Column, analysis: Column, findings: Column, score: Column, n_sources: Column, seconds: Column) -> Column:
    """The answer as Markdown: header, analysis, findings unless the analysis has its own, and a footer."""
    level = band(score)
    mark = F.coalesce(*[F.when(level == k, v) for k, v in _MARKS.items()])
    clean = lambda f: X.strip(F.replace(F.replace(f, F.lit("•"), F.lit("")), F.lit("*"), F.lit("")))
    line = lambda f, i: F.concat(F.when(clean(f).startswith("📋"), "").otherwise(F.concat((i + 1).cast("string"), F.lit(". "))), clean(f), F.lit("\n"))
    extra = F.concat(F.lit("\n## 🔍 Additional Key Findings\n\n"), F.array_join(F.transform(findings, line), ""), F.lit("\n"))
    return F.concat(
        F.lit("# ⚖️ Legal Research Analysis\n\n**Research Question:** "), question, F.lit("\n\n**Analysis Quality:** "), mark, F.lit(" "), level,
        F.format_string(" Confidence (%.2f)\n**Sources Analyzed:** ", score), n_sources.cast("string"), F.format_string(" documents\n**Processing Time:** %.2fs\n\n", seconds),
        F.when(analysis != "", analysis).otherwise(_NO_ANALYSIS), F.when((F.size(findings) > 0) & ~analysis.contains("Key Findings"), extra).otherwise(""), F.lit(_FOOTER),
    )


# Messages of requests that can't run, and the text of their answer.
_EMPTY, _RANGE, _FAILED = "Question cannot be empty", "top_k must be between 1 and 50", "Error generating analysis: "
_RESOURCES = ("geneva_documents", "judgment_documents", "additional_references")


def validated(requests: DataFrame) -> DataFrame:
    """Adds ``_error``: why a request (question, top_k) can't run; null if it can. top_k is 10 by default."""
    k = F.coalesce("top_k", F.lit(10))
    error = F.when(F.coalesce(X.strip(F.col("question")), F.lit("")) == "", _EMPTY).when((k < 1) | (k > 50), _RANGE)
    return requests.withColumns({"top_k": k, "_error": error})


def first_request(requests: DataFrame, *order: str) -> DataFrame:
    """The one request that a call answers where it takes no more than the first row (by ``order``) of its input."""
    return requests.orderBy(*order).limit(1)


def error_answers(failed: DataFrame, seconds: Column | None = None) -> DataFrame:
    """Requests with an ``_error`` -> the same rows with an answer that holds the reason, empty lists and zeros.

    Rows without an ``_error`` are left out. Columns of an answer that the requests have already are replaced.
    """
    none = F.array().cast("array<string>")
    entries = F.create_map(*[x for k in _RESOURCES for x in (F.lit(k), F.array().cast("array<map<string,string>>"))])
    answer = {
        "analysis": F.concat(F.lit(_FAILED), "_error"), "key_findings": none, "citations": none, "resource_list": entries,
        "confidence_score": F.lit(0.0), "sources_used": F.lit(0).cast("long"), "processing_time": (F.lit(0.0) if seconds is None else seconds).cast("double"),
    }
    return failed.filter("_error is not null").withColumns(answer)


def projected(answered: DataFrame, *keep: str, response: Column) -> DataFrame:
    """The columns of a chat response; those that the answers don't have are null (``routing_decision`` and ``sources`` with answers of the model).

    ``processing_time`` comes as ``processing_time_seconds``; ``keep`` are further columns to carry.
    """
    types = {
        "analysis": "string", "routing_decision": "string", "sources_used": "long", "confidence_score": "double",
        "key_findings": "array<string>", "citations": "array<string>", "processing_time": "double", "sources": "array<string>",
    }
    of = lambda c, t: F.col(c) if c in answered.columns else F.lit(None).cast(t)
    return answered.select(*keep, response.alias("response"), *[of(c, t).alias("processing_time_seconds" if c == "processing_time" else c) for c, t in types.items()])

"""Multiplicative re-ranking of search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import taxonomy as T
from ..functions import text as X


def _null_safe(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def authority(chamber: Column, case_name: Column) -> Column:
    base = F.coalesce(*[F.when(chamber == k, v) for k, v in T.CHAMBERS.items()], F.lit(1.0))
    return base * F.when(X.any_hit(F.lower(_null_safe(case_name)), T.FAMOUS_CASES), 1.15).otherwise(1.0)


def quality(content: Column, summary: Column) -> Column:
    n, s = F.length(content), F.length(X.strip(_null_safe(summary)))
    base = F.when((n >= 200) & (n <= 2000), 1.2).when((n >= 100) & (n < 200), 0.9).when(n > 2000, 1.1).otherwise(0.7)
    return base * F.when(s > 30, 1 + F.least(s / 200.0, F.lit(1.0)) * 0.3).otherwise(1.0)


def relevance(query: Column, content: Column, summary: Column, article: Column, section: Column) -> Column:
    """Shares of the query's distinct words that are substrings of content and summary, and whether one is in the labels."""
    terms = F.array_distinct(X.words(F.lower(query)))
    held = lambda c: X.let(F.lower(_null_safe(c)), lambda low: F.size(F.filter(terms, lambda t: F.contains(low, t))))
    share = lambda c: held(c) / F.nullif(F.size(terms), F.lit(0))
    boost = lambda c, w: F.when(F.coalesce(share(c), F.lit(0.0)) > 0, w).otherwise(1.0)
    return (1 + F.coalesce(share(content), F.lit(0.0)) * 0.5) * (1 + F.coalesce(share(summary), F.lit(0.0)) * 0.3) * boost(article, 1.2) * boost(section, 1.15)


def completeness(*fields: Column) -> Column:
    present = sum((F.when(F.coalesce(f.cast("string"), F.lit("")) != "", 1).otherwise(0) for f in fields), F.lit(0))
    return 1 + present / float(len(fields)) * 0.2


def domain(content: Column) -> Column:
    return 1 + F.least(X.hits(F.lower(content), T.DOMAIN_TERMS) / 10.0, F.lit(0.3))


def rerank(results: DataFrame, compat: bool = True) -> DataFrame:
    """(query, content, summary, score, article, section, page_number, chamber, case_name) -> the rows with their new score, at most 1.

    With ``compat`` only the article counts as metadata, as the others never reach it.
    """
    c = F.col
    none = F.lit(None).cast("string")
    chamber, case_name = (none, none) if compat else (c("chamber"), c("case_name"))
    fields = (none, none, c("article"), none, none) if compat else (c("page_number"), c("section"), c("article"), c("case_name"), c("chamber"))
    score = c("score") * authority(chamber, case_name) * quality(c("content"), c("summary")) * relevance(c("query"), c("content"), c("summary"), c("article"), c("section")) * completeness(*fields) * domain(c("content"))
    return results.withColumn("score", F.least(score, F.lit(1.0)))

"""Structural blocks and articles, cut inside each row: no explode before the result, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import taxonomy as T
from ..functions import text as X


def blocks(text: Column, headings: list[str] = T.HEADINGS, markers: list[str] = T.PARAGRAPHS) -> Column:
    """array<struct(text, type, section_id)>: every heading or paragraph marker opens a block; other lines follow it."""
    return X.let(F.transform(F.split(text, "\n"), X.strip), lambda lines: _blocks(lines, headings, markers))


def _blocks(lines: Column, headings: list[str], markers: list[str]) -> Column:
    kind = lambda x: F.when(X.matches(x, headings, True), "heading").when(X.matches(x, markers), "paragraph")
    n = F.size(lines)
    # A virtual start opens the block of the lines before the first marker.
    found = F.concat(F.array(F.lit(0)), F.filter(F.sequence(F.lit(1), n), lambda i: kind(F.get(lines, i - 1)).isNotNull()))

    def block(starts: Column, start: Column, k: Column) -> Column:
        end = F.coalesce(F.get(starts, k + 1), n + 1)
        own = F.slice(lines, F.greatest(start, F.lit(1)), end - F.greatest(start, F.lit(1)))
        # Blank lines before a block's first text are not kept.
        body = F.regexp_replace(F.array_join(own, "\n"), r"^\n+", "")
        opened = F.when(start > 0, kind(F.get(lines, start - 1)))
        title = F.get(lines, start - 1)
        section = F.when(start == 0, "").when(opened == "heading", F.replace(F.upper(title), F.lit(" "), F.lit("_"))).otherwise(title)
        return F.struct(body.alias("text"), F.coalesce(opened, F.lit("paragraph")).alias("type"), section.alias("section_id"))

    return F.filter(X.let(found, lambda starts: F.transform(starts, lambda s, k: block(starts, s, k))), lambda b: X.strip(b["text"]) != "")


def structural_blocks(docs: DataFrame, **patterns) -> DataFrame:
    """(doc_id, text) -> doc_id, block_ord, text, type, section_id."""
    return docs.select("doc_id", F.posexplode(blocks(F.col("text"), **patterns)).alias("block_ord", "b")).select("doc_id", "block_ord", "b.*")


def _marked(lines: Column, patterns: list[str], word: str) -> Column:
    """array<struct(at, label)> of the lines that match, in order. The last pattern that matches a line wins."""
    at = F.filter(F.sequence(F.lit(0), F.size(lines)), lambda i: (i < F.size(lines)) & X.matches(F.get(lines, i), patterns, True))
    return F.transform(at, lambda i: F.struct(i.alias("at"), X.let(F.get(lines, i), lambda line: _label(line, patterns, word)).alias("label")))


def _label(line: Column, patterns: list[str], word: str) -> Column:
    number = F.coalesce(*[F.nullif(F.regexp_extract(line, X.rx(p, True), 1), F.lit("")) for p in reversed(patterns)], F.lit(""))
    title = X.strip(F.coalesce(*[F.nullif(F.regexp_extract(line, X.rx(p, True), 2), F.lit("")) for p in reversed(patterns)], F.lit("")))
    return F.when(title == "", F.concat(F.lit(word + " "), number)).otherwise(F.concat(F.lit(word + " "), number, F.lit(": "), title))


def articles(text: Column, compat: bool = True) -> Column:
    """array<struct(text, article_num, article_title, part, section, article_type, paragraphs)>.

    Lines before the first article are dropped, blank lines too; paragraph lines go to ``paragraphs`` only.
    With ``compat`` the article's line stands twice at the head of its text.
    """
    return X.let(F.filter(F.transform(F.split(text, "\n"), X.strip), lambda x: x != ""), lambda lines: _articles(lines, compat))


def _running(marked: Column, i: Column) -> Column:
    """Label of the last marked line up to i; '' if there is none."""
    return F.coalesce(F.try_element_at(F.filter(marked, lambda m: m["at"] <= i), F.lit(-1))["label"], F.lit(""))


def _articles(lines: Column, compat: bool) -> Column:
    n = F.size(lines)
    is_article = lambda x: X.matches(x, T.ARTICLES, True)
    is_paragraph = lambda x: X.matches(x, T.ARTICLE_PARAGRAPHS)
    found = F.filter(F.sequence(F.lit(0), n), lambda i: (i < n) & is_article(F.get(lines, i)))

    def article(heads: Column, start: Column, k: Column) -> Column:
        starts = heads["starts"]
        end = F.coalesce(F.get(starts, k + 1), n)
        head, own = F.get(lines, start), F.slice(lines, start + 2, end - start - 1)
        number, title = X.first_match(head, T.ARTICLES, group=1), X.strip(X.first_match(head, T.ARTICLES, group=2))
        plain = F.filter(own, lambda x: ~is_paragraph(x))
        paragraphs = F.transform(F.filter(own, is_paragraph), lambda x: F.struct(X.first_match(x, T.ARTICLE_PARAGRAPHS, False, 1).alias("num"), X.strip(X.first_match(x, T.ARTICLE_PARAGRAPHS, False, 2)).alias("text")))
        return F.struct(
            F.array_join(F.concat(F.array(head, head) if compat else F.array(head), plain), "\n").alias("text"),
            number.alias("article_num"),
            title.alias("article_title"),
            _running(heads["parts"], start).alias("part"),
            _running(heads["sections"], start).alias("section"),
            article_type(number, title, compat).alias("article_type"),
            paragraphs.alias("paragraphs"),
        )

    heads = F.struct(found.alias("starts"), _marked(lines, T.PARTS, "Part").alias("parts"), _marked(lines, T.SECTIONS, "Section").alias("sections"))
    return X.let(heads, lambda h: F.transform(h["starts"], lambda s, k: article(h, s, k)))


def article_type(number: Column, title: Column, compat: bool = True) -> Column:
    common = number == "3"
    if not compat:
        common = common | title.rlike(X.rx(r"common\s+to\s+the|common\s+article|\(common\)", True))
    return F.when(common, "common_article").otherwise("regular_article")


def split_articles(docs: DataFrame, compat: bool = True) -> DataFrame:
    """(doc_id, text) -> doc_id, article_ord and the article's fields."""
    return docs.select("doc_id", F.posexplode(articles(F.col("text"), compat)).alias("article_ord", "a")).select("doc_id", "article_ord", "a.*")

"""Page layout: headers and footers, footnotes, tables of contents, cleaning."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import taxonomy as T
from ..functions import text as X


def headers_footers(words: DataFrame, share: float = 5, threshold: float = 0.7) -> DataFrame:
    """(doc_id, ord, text, y0, page_num) -> doc_id, kind, text, pages: strings that head or foot at least ``threshold`` of a document's pages.

    Per page the top and bottom max(1, words // share) words by height are joined in that order. Windows are by
    document and page; page counts are summed before the shuffle.
    """
    page = Window.partitionBy("doc_id", "page_num")
    down = page.orderBy("y0", "ord")
    ranked = words.select("doc_id", "page_num", "text", F.row_number().over(down).alias("rank"), F.count("*").over(page).alias("n"))
    edge = F.greatest(F.lit(1), F.floor(F.col("n") / share))
    kinds = F.filter(F.array(F.when(F.col("rank") <= edge, "header"), F.when(F.col("rank") > F.col("n") - edge, "footer")), lambda k: k.isNotNull())
    strips = ranked.withColumn("kind", F.explode(kinds)).filter(X.strip(F.col("text")) != "")
    lines = strips.groupBy("doc_id", "page_num", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda s: s["text"]), " ").alias("text"))
    pages = words.groupBy("doc_id").agg(F.count_distinct("page_num").alias("all_pages"))
    counts = lines.groupBy("doc_id", "kind", "text").agg(F.count("*").alias("pages"))
    return counts.join(pages, "doc_id").filter(F.col("pages") >= F.col("all_pages") * threshold).select("doc_id", "kind", "text", "pages")


#: What ``text.strip`` takes for white space.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def _pages(column: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    """Page numbers and which of them are null; those are one page of their own."""
    return column.values.fill_null(-(1 << 31)).to_numpy(zero_copy_only=False).astype(np.int64), column.values.is_null().to_numpy(zero_copy_only=False)


def _edge_strings(words: list[str | None], order: np.ndarray, pages: np.ndarray, share: float) -> Counter:
    """On how many pages each (kind, string) stands, of words in the order of their pages and heights."""
    out = Counter()
    starts = np.flatnonzero(np.r_[True, pages[1:] != pages[:-1]]) if len(pages) else np.zeros(0, np.int64)
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(pages)], strict=True):
        edge = max(1, int((b - a) // share))
        for kind, own in (("header", order[a : a + edge]), ("footer", order[max(a, b - edge) : b])):
            kept = [w for i in own.tolist() if (w := words[i]) is not None and w.strip(_WHITE)]
            if kept:
                out[kind, " ".join(kept)] += 1
    return out


def edge_literals(words: Column, share: float = 5, threshold: float = 0.7) -> Column:
    """The strings of ``headers_footers`` of one document, sorted, from its array of words; nothing leaves the row."""

    @F.arrow_udf("array<string>")
    def run(ords: pa.Array, texts: pa.Array, heights: pa.Array, pages: pa.Array) -> pa.Array:
        out = []
        for o, t, y, p in zip(ords, texts, heights, pages, strict=True):
            if not t.is_valid or not len(t.values):
                out.append([])
                continue
            number, null = _pages(p)
            height = y.values.fill_null(-np.inf).to_numpy(zero_copy_only=False)
            order = np.lexsort((o.values.fill_null(-(1 << 62)).to_numpy(zero_copy_only=False), height, number))
            found = _edge_strings(t.values.to_pylist(), order, number[order], share)
            least = len(np.unique(number[~null])) * threshold
            out.append(sorted({text for (_, text), n in found.items() if n >= least}, key=str.encode))
        return pa.array(out, pa.list_(pa.string()))

    field = lambda name, kind: F.transform(words, lambda w: w[name].cast(kind))
    return run(field("ord", "long"), field("text", "string"), field("y0", "double"), field("page_num", "long"))


def small_words(words: Column, small: float = 0.8) -> Column:
    """The words of a document that are small on their page, as ``footnotes`` seeks them, from its array of words."""

    @F.arrow_udf("array<boolean>")
    def run(sizes: pa.Array, pages: pa.Array) -> pa.Array:
        out = []
        for s, p in zip(sizes, pages, strict=True):
            if not s.is_valid:
                out.append(None)
                continue
            size, (number, _) = s.values.fill_null(np.nan).to_numpy(zero_copy_only=False), _pages(p)
            _, page = np.unique(number, return_inverse=True)
            good = size > 0
            count, total = np.bincount(page, good), np.bincount(page, np.where(good, size, 0.0))
            mean = np.divide(total, count, out=np.full(len(count), 12.0), where=count > 0)
            out.append((size < small * mean[page]).tolist() if len(size) else [])
        return pa.array(out, pa.list_(pa.bool_()))

    flags = run(F.transform(words, lambda w: w["font_size"].cast("double")), F.transform(words, lambda w: w["page_num"].cast("long")))
    return X.let(flags, lambda f: F.filter(words, lambda w, i: F.get(f, i) & (X.strip(w["text"]) != "")))


def repeated_lines(docs: DataFrame, key: str, threshold: float) -> DataFrame:
    """Lines that stand in at least ``threshold`` of the rows of a key: (key, line, n_docs)."""
    lines = docs.select(key, "doc_id", F.explode(F.array_distinct(F.transform(F.split("text", "\n"), X.strip))).alias("line")).filter("line <> ''")
    counts = lines.groupBy(key, "line").agg(F.count("*").alias("n_docs"))
    rows = docs.groupBy(key).agg(F.count("*").alias("n"))
    return counts.join(rows, key).filter(F.col("n_docs") >= F.col("n") * threshold).select(key, "line", "n_docs")


def footnotes(words: DataFrame, small: float = 0.8, gap: float = 20.0) -> DataFrame:
    """(doc_id, ord, text, x0, y0, x1, y1, font_size, page_num) -> footnotes: small words of a page, split where the gap in height is ``gap``."""
    page = Window.partitionBy("doc_id", "page_num")
    mean = F.coalesce(F.avg(F.when(F.col("font_size") > 0, F.col("font_size"))).over(page), F.lit(12.0))
    return footnote_islands(words.withColumn("mean", mean).filter((F.col("font_size") < small * F.col("mean")) & (X.strip(F.col("text")) != "")), gap)


def footnote_islands(few: DataFrame, gap: float = 20.0) -> DataFrame:
    """Small words, a row each, -> footnotes."""
    down = Window.partitionBy("doc_id", "page_num").orderBy("y0", "ord")
    islands = few.withColumn("new", F.when(F.col("y0") - F.lag("y1").over(down) < gap, 0).otherwise(1)).withColumn("note", F.sum("new").over(down))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "ord", "text"))), lambda s: s["text"]), " ")
    return islands.groupBy("doc_id", "page_num", "note").agg(whole.alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.avg("font_size").alias("font_size"))


def contents_bounds(text: Column) -> Column:
    """struct(found, first, last) of the table of contents in the first 15 % of the lines; -1 where there is none."""
    return X.let(F.transform(F.split(text, "\n"), X.strip), _bounds)


def _bounds(lines: Column) -> Column:
    n = F.size(lines)
    at = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
    head = F.filter(at, lambda i: (i < F.floor(n * 0.15)) & X.matches(F.lower(F.get(lines, i)), T.CONTENTS))
    return X.let(F.coalesce(F.get(head, F.lit(0)), F.lit(-1)), lambda first: _stop(lines, n, first))


def _stop(lines: Column, n: Column, first: Column) -> Column:
    ends = lambda i: X.matches(F.get(lines, i), T.CONTENTS_ENDS) | X.matches(F.get(lines, i), T.CONTENTS_ENDS_ANY_CASE, True) | ((F.get(lines, i) == "") & (i > first + 5))
    last = F.least(first + 49, n - 1)
    stop = F.when(last > first, F.coalesce(F.get(F.filter(F.sequence(first + 1, last), ends), F.lit(0)), last))
    return F.struct((first >= 0).alias("found"), first.alias("first"), F.when(first >= 0, F.coalesce(stop, F.lit(-1))).otherwise(-1).alias("last"))


def clean_text(text: Column, literals: Column | None = None) -> Column:
    """Without the table of contents and the given headers and footers, wherever they stand; white space tidied."""
    out = X.let(contents_bounds(text), lambda toc: F.when(~toc["found"], text).otherwise(F.array_join(F.filter(F.split(text, "\n"), lambda _, i: ~(toc["found"] & (toc["last"] > toc["first"]) & (i >= toc["first"]) & (i < toc["last"]))), "\n")))
    return X.tidy(X.remove_literals(out, literals) if literals is not None else out)


def strip_lines(docs: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """Rows without the lines given for their key; order and columns stay. The lines of a key travel as one array."""
    by_key = lines.groupBy(key).agg(F.collect_set("line").alias("_drop"))
    kept = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains(F.coalesce("_drop", F.array().cast("array<string>")), X.strip(x)))
    return docs.join(by_key, key, "left").withColumn("text", F.array_join(kept, "\n")).select(docs.columns)


def judgment_metadata(text: Column, filename: Column) -> Column:
    judges = F.array_sort(F.array_distinct(F.concat(*[X.all_matches(text, p, any_case=True) for p in T.JUDGES])))
    return F.struct(F.replace(filename, F.lit(".pdf")).alias("doc_id"), X.first_match(text, T.CASE_NUMBERS).alias("case_number"), X.first_match(text, T.DATES).alias("date"), judges.alias("judges"))


def document_type(text: Column, compat: bool = True) -> Column:
    """First document type whose pattern is found. With ``compat`` always unknown: capitals are sought in lower-cased text."""
    if compat:
        return F.lit("unknown")
    return F.coalesce(*[F.when(X.matches(text, p, True), name) for name, p in T.DOCUMENT_TYPES.items()], F.lit("unknown"))


def treaty_metadata(text: Column, filename: Column, compat: bool = True) -> Column:
    title = X.first_match(text, T.TITLES)
    return F.struct(F.when(title != "", title).otherwise(F.replace(filename, F.lit(".pdf"))).alias("doc_name"), X.first_match(text, T.TREATY_DATES).alias("date"), document_type(text, compat).alias("source"))

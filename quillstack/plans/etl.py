"""From extracted files to chunk tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import folds
from ..operators import chunking, classify, layout, structure
from ..sources import files as S
from ..sources.scratch import saved


def cleaned(docs: DataFrame, share: float) -> DataFrame:
    """(doc_id, text, words, ...) -> the rows with ``clean``, without headers, footers and contents; words stay in their row."""
    docs = docs.withColumn("_literals", layout.edge_literals(F.col("words"), share))
    return docs.withColumn("clean", layout.clean_text(F.col("text"), F.coalesce("_literals", F.array().cast("array<string>")))).drop("_literals")


def _with_ids(files: DataFrame, name: Column) -> DataFrame:
    return S.readable(files).withColumn("doc_id", name)


def judgment_chunks(files: DataFrame, sizes: tuple = chunking.JUDGMENT, similar: float = 0.88, stop: list[str] | None = None) -> DataFrame:
    """(filename, text, words, _error) -> the 17 columns of judgment chunks.

    A document is cut into blocks, and these are split, overlapped, merged where neighbours are alike and packed, within its
    row; there its chunks are numbered and their pages are found, too. Only footnotes are shuffled; they join by rare words.
    """
    target, least, most, ratio = sizes
    docs = cleaned(_with_ids(files, F.replace("filename", F.lit(".pdf"))), 5).withColumn("meta", layout.judgment_metadata(F.col("clean"), F.col("filename")))
    # Of the words, their sizes and pages are kept, and those that may be footnotes.
    of = lambda value, kind, name: F.transform("words", lambda w: value(w).cast(kind)).alias(name)
    docs = saved(docs.select("doc_id", "meta", "clean", of(lambda w: F.length(w["text"]), "int", "sizes"), of(lambda w: w["page_num"], "int", "of"), layout.small_words(F.col("words")).alias("words")), "docs")
    parts = lambda b: folds.with_overlap(folds.recursive_split(b["text"], target), ratio)
    blocks = F.transform(structure.blocks(F.col("clean")), lambda b: F.struct(b["type"].alias("type"), b["section_id"].alias("section_id"), classify.classify(b["text"], "judgment").alias("c"), parts(b).alias("parts")))
    rows = docs.select("doc_id", "meta.case_number", "meta.date", "meta.judges", "clean", "sizes", "of", blocks.alias("blocks"))
    alike = chunking.neighbour_similarities(F.transform("blocks", lambda b: F.transform(b["parts"], lambda x: x["text"])), stop=stop)
    # Saved, as Python's results may not be inlined into the functions of an array that follow.
    rows = saved(rows.withColumn("alike", alike), "blocks").withColumn("both", F.arrays_zip("blocks", "alike")).drop("blocks", "alike")
    merged = lambda both: folds.merge_small(chunking.merged_neighbours(both["blocks"]["parts"], both["alike"], similar, target), least, target, most)
    chunk = lambda b, x: F.struct(x["text"].alias("text"), x["tokens"].alias("tokens"), x["split_method"].alias("split_method"), b["type"].alias("type"), b["section_id"].alias("section_id"), b["c"].alias("c"))
    rows = rows.withColumn("cs", F.flatten(F.transform("both", lambda both: F.transform(merged(both), lambda x: chunk(both["blocks"], x))))).drop("both")
    heads = F.transform("cs", lambda x: F.struct(F.substring(x["text"], 1, 100).alias("head"), F.length(x["text"]).alias("size")))
    rows = rows.withColumn("places", chunking.pages_by_sizes(F.col("clean"), F.col("sizes"), F.col("of"), heads)).select("doc_id", "case_number", "date", "judges", "places", F.posexplode("cs").alias("n", "x"))
    numbered = rows.select("doc_id", "case_number", "date", "judges", F.concat("doc_id", F.lit("_chunk_"), F.col("n").cast("string")).alias("chunk_id"), F.get("places", F.col("n")).alias("pages"), "x.*")
    notes = saved(layout.footnote_islands(S.words_of(docs)).select("doc_id", F.concat_ws("-", "page_num", "note").alias("note_id"), "text"), "notes")
    if notes.isEmpty():
        full = numbered.withColumn("footnotes", F.array().cast("array<string>"))
    else:
        numbered = saved(numbered, "chunks")
        links = chunking.footnote_links(numbered.select("doc_id", "chunk_id", "text"), notes, "doc_id").join(notes.select("doc_id", "note_id", F.col("text").alias("note")), ["doc_id", "note_id"])
        full = numbered.join(links.groupBy("doc_id", "chunk_id").agg(F.array_sort(F.collect_list("note")).alias("footnotes")), ["doc_id", "chunk_id"], "left")
    return full.select(
        "chunk_id", "text", "doc_id", "case_number", "pages", F.col("section_id").alias("section"), "c.section_type", F.col("c.confidence").alias("section_hierarchy"),
        F.coalesce("footnotes", F.array().cast("array<string>")).alias("footnotes"), "date", "judges", F.array(F.lit(0).cast("long"), F.length("text").cast("long")).alias("char_offset"),
        F.col("type").alias("parent_section"), F.col("c.confidence").alias("classification_confidence"), F.col("c.evidence").alias("classification_evidence"), "tokens", "split_method",
    )


def treaty_chunks(files: DataFrame, sizes: tuple = chunking.TREATY, compat: bool = True) -> DataFrame:
    """(filename, text, words, _error) -> the 18 columns of treaty chunks."""
    target, least, most, ratio = sizes
    docs = saved(cleaned(_with_ids(files, F.col("filename")), 7).withColumn("meta", layout.treaty_metadata(F.col("clean"), F.col("filename"), compat)).select("doc_id", "meta", "clean"), "docs")
    rows = docs.select("doc_id", "meta", F.posexplode(structure.articles(F.col("clean"), compat)).alias("article_ord", "a"))
    rows = saved(rows.withColumn("c", classify.classify(F.col("a.text"), "treaty")), "articles")
    merged = folds.merge_small(chunking.article_chunks(F.col("a"), target), least, target, most)
    chunks = chunking.exploded(rows, folds.with_overlap(merged, ratio), "doc_id", "meta", "article_ord", "a", "c")
    numbered = chunking.chunk_ids_over(chunks.withColumn("doc_name", F.col("meta.doc_name")), "doc_name", "doc_id", "article_ord", "chunk_ord")
    none = F.lit(None).cast("string")
    return numbered.select(
        "chunk_id", "text", "doc_name", "a.part", "a.section", F.col("a.article_num").alias("article"), none.alias("paragraph"), none.alias("sub_paragraph"),
        F.array(F.lit(1).cast("long"), F.lit(1).cast("long")).alias("pages"), "meta.date", "meta.source", "a.article_type", "c.section_type", F.col("c.confidence").alias("section_hierarchy"),
        F.col("c.confidence").alias("classification_confidence"), F.col("c.evidence").alias("classification_evidence"), "tokens", "split_method",
    )

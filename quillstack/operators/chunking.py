"""Chunks of blocks and articles, their pages, footnotes and ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import folds, locate, sparse
from ..functions import text as X
from ..sources.scratch import saved

#: Sizes in tokens: target, least, most, and the overlap's share.
JUDGMENT, TREATY = (700, 200, 1000, 0.18), (600, 200, 800, 0.12)


def exploded(df: DataFrame, chunks: Column, *keep: str) -> DataFrame:
    """One row per chunk, numbered in order."""
    return df.select(*keep, F.posexplode(chunks).alias("chunk_ord", "_c")).select(*keep, "chunk_ord", "_c.*")


def recursive_split(df: DataFrame, *keep: str, target: int = JUDGMENT[0], overlap: float = JUDGMENT[3]) -> DataFrame:
    """Paragraphs packed to ``target`` tokens, long ones by sentences, then the overlap."""
    return exploded(df, folds.with_overlap(folds.recursive_split(F.col("text"), target), overlap), *keep)


def article_chunks(article: Column, target: int = TREATY[0]) -> Column:
    """An article up to ``target`` tokens is one chunk of its text; else its paragraphs are, long ones by sentences."""
    head = F.concat(F.lit("Article "), article["article_num"], F.lit(": "), article["article_title"])

    def paragraph(p: Column) -> Column:
        text = F.concat(head, F.lit("\n\n("), p["num"], F.lit(") "), p["text"])
        return F.when(X.token_count(text) <= target, F.array(folds.chunk(text, X.token_count(text), "paragraph"))).otherwise(folds.pack_sentences(text, target))

    n = X.token_count(article["text"])
    return (
        F.when(n <= target, F.array(folds.chunk(article["text"], n, "article")))
        .when(F.size(article["paragraphs"]) > 0, F.flatten(F.transform(article["paragraphs"], paragraph)))
        .otherwise(folds.pack_sentences(article["text"], target))
    )


def chunk_ids(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Adds chunk_id ``{key}_chunk_{n}``, n from 0 per document in order."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    return df.withColumn("chunk_id", F.concat(F.col(key).cast("string"), F.lit("_chunk_"), n.cast("string")))


def chunk_ids_over(df: DataFrame, key: str, part: str, *order: str) -> DataFrame:
    """Adds chunk_id ``{key}_chunk_{n}``, n from 0 per key by (part, order), however many parts have the same key.

    Rows are numbered in their part. What stands before a part is summed over one row a part, dealt out by ranges
    of (key, part), and then over one row for each key of a range: no task gets all rows of a key.
    """
    rows = saved(df, "numbered")
    parts = rows.groupBy(key, part).agg(F.count("*").alias("_n"))
    parts = saved(parts.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key, part).withColumn("_range", F.spark_partition_id()), "parts")
    before = lambda of, by: F.coalesce(F.sum("_n").over(Window.partitionBy(*of).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = parts.groupBy(key, "_range").agg(F.sum("_n").alias("_n")).withColumn("_start", before([key], "_range"))
    ranges, inner = ranges.select(F.col(key).alias("_k"), F.col("_range").alias("_r"), "_start"), parts.withColumn("_within", before([key, "_range"], part))
    starts = inner.join(ranges, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_range") == F.col("_r"))).select(F.col(key).alias("_key"), F.col(part).alias("_part"), (F.col("_start") + F.col("_within")).alias("_before"))
    own = rows.withColumn("_own", F.row_number().over(Window.partitionBy(key, part).orderBy(*order)) - 1)
    found = own.join(starts, F.col(key).eqNullSafe(F.col("_key")) & F.col(part).eqNullSafe(F.col("_part")))
    return found.withColumn("chunk_id", F.concat(F.col(key).cast("string"), F.lit("_chunk_"), (F.col("_before") + F.col("_own")).cast("string"))).select(*df.columns, "chunk_id")


def chunk_stats(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents, chunks, chunks a document and tokens a chunk, in one row."""
    per = chunks.groupBy(key).agg(F.count("*").alias("n"), F.sum("tokens").alias("t"))
    return per.agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_chunks"), F.avg("n").alias("chunks_per_doc"), (F.sum("t") / F.sum("n")).alias("tokens_per_chunk"))


def pages_in_row(text: Column, words: Column, chunks: Column) -> Column:
    """Pages [first, last] of every chunk of a document, in the document's row.

    ``words``: array of (size, page) in reading order, ``chunks``: array of (head, size) with the first 100 characters.
    All heads are found in one pass over the text; a page is found by bisection in the sums of the word sizes.
    """
    return pages_by_sizes(text, F.transform(words, lambda w: w["size"].cast("long")), F.transform(words, lambda w: w["page"].cast("long")), chunks)


def pages_by_sizes(text: Column, sizes: Column, pages: Column, chunks: Column) -> Column:
    """``pages_in_row`` from the words' sizes and pages as two arrays of integers."""
    return locate.pages()(text, sizes, pages, F.transform(chunks, lambda c: c["head"]), F.transform(chunks, lambda c: c["size"].cast("long")))


def chunk_pages(chunks: DataFrame, words: DataFrame, texts: DataFrame) -> DataFrame:
    """Adds ``pages``: the pages at the places of a chunk's first and last character.

    (doc_id, text) chunks are sought by their first 100 characters in the document's cleaned text; a word's
    place is the sum of the lengths before it, each with a space. The bound is the first word at or after
    a place, page 1 beyond the last; [1, 1] if the chunk is not found. chunk_id must be unique in its document.
    """
    of_doc = lambda df, name, *c: df.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*c))).alias(name))
    # Numbers of 4 bytes each: this is all that is shuffled of a word.
    placed = of_doc(words, "_words", F.col("ord").cast("int").alias("ord"), F.length("text").alias("size"), F.col("page_num").cast("int").alias("page"))
    asked = of_doc(chunks, "_chunks", "chunk_id", F.substring("text", 1, 100).alias("head"), F.length("text").alias("size"))
    rows = asked.join(placed, "doc_id", "left").join(texts.select("doc_id", F.col("text").alias("_text")), "doc_id", "left")
    rows = rows.select("doc_id", "_chunks", pages_in_row(F.col("_text"), F.col("_words"), F.col("_chunks")).alias("_pages"))
    found = rows.select("doc_id", F.explode(F.arrays_zip(F.transform("_chunks", lambda c: c["chunk_id"]).alias("chunk_id"), F.col("_pages").alias("pages"))).alias("x")).select("doc_id", "x.*")
    one = F.lit(1).cast("long")
    return chunks.join(found, ["doc_id", "chunk_id"], "left").withColumn("pages", F.coalesce("pages", F.array(one, one)))


#: Counters of the word frequencies by which ``footnote_links`` orders words.
COUNTERS = 1 << 16
#: One text in so many is counted, by a hash: counts decide the order of words only, and any order gives the same pairs.
COUNTED = 8


def _counter(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(COUNTERS)).cast("int")


def word_frequencies(*tables: DataFrame) -> Column:
    """How many of the counted texts hold a word, summed by ``COUNTERS`` counters, as an array: that many numbers however large the tables are."""
    words = lambda df: df.filter(F.pmod(F.xxhash64("text"), F.lit(COUNTED)) == 0).select(F.explode(F.array_distinct(X.words(F.lower("text")))).alias("_w"))
    every = words(tables[0])
    for t in tables[1:]:
        every = every.unionByName(words(t))
    counts = [0] * COUNTERS
    for slot, n in every.groupBy(_counter(F.col("_w"))).count().collect():
        counts[slot] = n
    return F.split(F.lit(",".join(map(str, counts))), ",").cast("array<bigint>")  # folded to one literal


def words_held(df: DataFrame) -> Column:
    """Which counters the words of all texts fall on, as an array of booleans: a word on another one is in no text."""
    slots = {r[0] for r in df.select(F.explode(X.words(F.lower("text"))).alias("_w")).select(_counter(F.col("_w"))).distinct().collect()}
    return F.split(F.lit(",".join("true" if k in slots else "false" for k in range(COUNTERS))), ",").cast("array<boolean>")  # folded to one literal


def word_sets(df: DataFrame, name: str, key: tuple[str, ...], frequencies: Column, among: Column | None = None) -> DataFrame:
    """(key, text) -> key, name, distinct words ``_ws`` with the rarest first, by counter and then by word; only those that ``among`` of ``words_held`` allows."""
    counted = lambda w: F.struct(F.get(frequencies, _counter(w)).alias("n"), w.alias("w"))
    words = X.words(F.lower("text"))
    if among is not None:
        words = F.filter(words, lambda w: F.get(among, _counter(w)))
    words = F.array_sort(F.transform(F.array_distinct(words), counted))
    return df.select(*key, name, F.transform(words, lambda s: s["w"]).alias("_ws"))


def rare_words(sets: DataFrame, name: str, key: tuple[str, ...], more_than: int) -> DataFrame:
    """All but the ``more_than`` most frequent words of each set, a row each: sets with more common words than that share one."""
    prefix = F.slice("_ws", 1, F.greatest(F.size("_ws") - more_than, F.lit(0)))
    return sets.select(*key, name, F.explode(prefix).alias("_w"))


def footnote_links(chunks: DataFrame, notes: DataFrame, *key: str, more_than: int = 3) -> DataFrame:
    """Pairs of chunks and footnotes with more than ``more_than`` common words: (key, chunk_id, text) and (key, note_id, text) -> key, chunk_id, note_id, common.

    Words of both sides are ordered by how rare they are. Of two sets with more than m common words, each
    has one of these among all but its m last words, so only those meet in an equi-join, and a word that stands everywhere
    joins nothing but sets of such words. Words of chunks that are in no note are left out at once. What the m last words of the candidates have in common is added from short
    lists: those words, and which of all such words a set holds. (key, id) must be distinct.
    """
    frequencies = word_frequencies(chunks, notes)
    left = saved(word_sets(chunks, "chunk_id", key, frequencies, words_held(notes)), "word-sets")
    right = saved(word_sets(notes, "note_id", key, frequencies), "word-sets")
    first, last = F.slice("_ws", 1, F.greatest(F.size("_ws") - more_than, F.lit(0))), F.slice("_ws", F.greatest(F.size("_ws") - more_than, F.lit(0)) + 1, F.lit(more_than))
    lasts = [saved(df.select(F.explode(last).alias("_w")).distinct(), "last-words") for df in (left, right)]

    def lists(sets: DataFrame, name: str, words: Column, others: DataFrame, own: str, met: str) -> DataFrame:
        """The last words of each set, and those of ``words`` that are among the last of some set of the other side."""
        found = sets.select(*key, name, F.explode(words).alias("_w")).join(others, "_w", "left_semi").groupBy(*key, name).agg(F.collect_list("_w").alias(met))
        return sets.select(*key, name, last.alias(own)).join(found, [*key, name], "left").withColumn(met, F.coalesce(met, F.array().cast("array<string>")))

    pairs = rare_words(left, "chunk_id", key, more_than).join(rare_words(right, "note_id", key, more_than), [*key, "_w"])
    pairs = pairs.groupBy(*key, "chunk_id", "note_id").agg(F.count("*").alias("n"))
    whole = pairs.join(lists(left, "chunk_id", first, lasts[1], "_a", "_am"), [*key, "chunk_id"]).join(lists(right, "note_id", F.col("_ws"), lasts[0], "_b", "_bm"), [*key, "note_id"])
    held = lambda few, many: F.size(F.filter(few, lambda w: F.array_contains(F.col(many), w)))
    more = held("_a", "_bm") + held("_b", "_am")
    return whole.withColumn("common", (F.col("n") + more).cast("long")).filter(F.col("common") > more_than).select(*key, "chunk_id", "note_id", "common")


def neighbour_similarity(texts: Column, features: int | None = 1000, stop: list[str] | None = None) -> Column:
    """TF-IDF cosine of every text of an array with the next one, as an array with one value less; nothing leaves the row.

    Terms are lower-cased runs of two or more letters, numbers and underscores (Python's ``\\w``; Java's takes marks for word
    characters, and not all numbers); the ``features`` most frequent of the array stay (all
    if None; ties by term). A term's weight is tf * (ln((1 + n) / (1 + df)) + 1) for n texts. Null gives null.
    """
    return sparse.neighbour_cosines(features)(_terms(texts, stop))


def neighbour_similarities(blocks: Column, features: int | None = 1000, stop: list[str] | None = None) -> Column:
    """``neighbour_similarity`` of every array of texts of an array."""
    return sparse.neighbour_cosines_of_each(features)(F.transform(blocks, lambda texts: _terms(texts, stop)))


def _terms(texts: Column, stop: list[str] | None) -> Column:
    terms = F.transform(texts, lambda t: X.all_matches(F.lower(F.coalesce(t, F.lit(""))), r"[\pL\pN_]{2,}"))
    if not stop:
        return terms
    left_out = F.lit(list(stop))
    return F.transform(terms, lambda ts: F.filter(ts, lambda t: ~F.array_contains(left_out, t)))


def merged_neighbours(chunks: Column, similarity: Column, threshold: float, target: int) -> Column:
    """Array of chunks -> chunks: one joins the next if they are alike and small enough together; pairs don't chain."""
    start = F.struct(folds.none_yet().alias("done"), F.lit(False).alias("skip"))

    def step(acc: Column, i: Column) -> Column:
        a, b = F.get(chunks, i), F.get(chunks, i + 1)
        join = b.isNotNull() & (F.coalesce(F.get(similarity, i), F.lit(0.0)) > threshold) & (a["tokens"] + b["tokens"] <= target * 1.5)
        both = F.concat(a["text"], F.lit("\n\n"), b["text"])
        one = F.when(join, folds.chunk(both, X.token_count(both), "semantic_merge")).otherwise(folds.chunk(a["text"], a["tokens"], a["split_method"]))
        return F.struct(F.when(acc["skip"], acc["done"]).otherwise(F.concat(acc["done"], F.array(one))).alias("done"), (~acc["skip"] & F.coalesce(join, F.lit(False))).alias("skip"))

    at = F.when(F.size(chunks) > 0, F.sequence(F.lit(0), F.size(chunks) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(at, start, step, lambda acc: acc["done"])


def _in_order(parts: DataFrame, block: list[str], order: str, *columns: str) -> DataFrame:
    """One row per block with its parts ``c`` in order."""
    return parts.groupBy(*block).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), *columns))).alias("c"))


def adjacent_similarity(parts: DataFrame, block: list[str], order: str, features: int | None = 1000, stop: list[str] | None = None) -> DataFrame:
    """``neighbour_similarity`` of parts that are rows: (block, order, similarity), with one shuffle by block."""
    rows = _in_order(parts, block, order, "text")
    rows = rows.withColumn("s", neighbour_similarity(F.transform("c", lambda x: x["text"]), features, stop))
    one = F.transform("s", lambda s, i: F.struct(F.get(F.col("c"), i)["o"].alias(order), s.alias("similarity")))
    return rows.select(*block, F.explode(one).alias("x")).select(*block, "x.*")


def semantic_merge(parts: DataFrame, block: list[str], order: str, threshold: float = 0.88, target: int = JUDGMENT[0], **options) -> DataFrame:
    """(block, order, text, tokens, split_method) -> merged chunks of each block."""
    rows = _in_order(parts, block, order, "text", "tokens", "split_method")
    rows = rows.withColumn("s", neighbour_similarity(F.transform("c", lambda x: x["text"]), **options))
    return exploded(rows, merged_neighbours(F.col("c"), F.col("s"), threshold, target), *block)


def merge_small(df: DataFrame, chunks: Column, *keep: str, sizes: tuple = JUDGMENT) -> DataFrame:
    return exploded(df, folds.merge_small(chunks, sizes[1], sizes[0], sizes[2]), *keep)

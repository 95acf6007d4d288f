"""Top-k search, fusion, caps and weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import taxonomy as T
from ..functions import text as X
from ..functions.names import unused
from .vector_index import VectorIndex


def top_k(queries: DataFrame, corpus: DataFrame | VectorIndex, k: Column | int, by: str = "query_id", id_col: str = "vec_id", same: str | None = None) -> DataFrame:
    """Exact cosine top-k: (by, qvec[, k]) against (id_col, embedding, ...) -> by, corpus columns, score, rank; ties by id_col.

    ``corpus`` is an index that was built before, or a table of which one is built for this search. However many
    queries there are, it is one plan of equi-joins on cells. Wide corpus columns should be joined to what is found. ``same`` names a
    column of both in which they must agree (of an index, its ``_agree``). Vectors that are null, zero or not finite match nothing.
    """
    if isinstance(corpus, VectorIndex):
        return corpus.search(queries, k, by, agree=same).drop("_row")
    index = VectorIndex.build(corpus.withColumn("_agree", F.col(same).cast("string")) if same else corpus, id_col)
    found = index.search(queries, k, by, agree=same)
    more = [c for c in corpus.columns if c not in ("embedding", id_col)]
    return (found.join(index.table.select("_row", *more), "_row") if more else found).drop("_row")


#: Characters by which contents are told apart.
PREFIX = 100


def first_of_prefix(results: DataFrame, by: list[str], *order: str, length: int = PREFIX) -> DataFrame:
    """Of results of a question with the same first ``length`` characters the first in order stays."""
    w = Window.partitionBy(*by, F.substring("content", 1, length)).orderBy(*order)
    n = unused(results, "n")
    return results.withColumn(n, F.row_number().over(w)).filter(F.col(n) == 1).drop(n)


def above(results: DataFrame, least: float = 0.01) -> DataFrame:
    return results.filter(F.col("score") >= least)


def source_cap(results: DataFrame, by: list[str], source: list[str], *ties: str, most: int = 2) -> DataFrame:
    """At most ``most`` results of a source, by score."""
    w = Window.partitionBy(*by, *source).orderBy(F.desc("score"), *ties)
    n = unused(results, "n")
    return results.withColumn(n, F.row_number().over(w)).filter(F.col(n) <= most).drop(n)


def first_k(results: DataFrame, by: list[str], k: int, *ties: str) -> DataFrame:
    """The k best by score with their ``rank``."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), *ties)
    return results.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def weighted_merge(treaty: DataFrame, judgments: DataFrame, routes: DataFrame, by: str, k: int, tie: str) -> DataFrame:
    """Scores times 1 + 0.5 * priority, both lists as one (treaty first on ties), the k best."""
    both = treaty.withColumn("list_ord", F.lit(0)).unionByName(judgments.withColumn("list_ord", F.lit(1)))
    priority = F.when(F.col("list_ord") == 0, F.col("treaty_priority")).otherwise(F.col("judgment_priority"))
    weighed = both.join(routes.select(by, "treaty_priority", "judgment_priority"), by).withColumn("score", F.col("score") * (1 + 0.5 * priority)).drop("treaty_priority", "judgment_priority")
    return first_k(weighed, [by], k, "list_ord", tie)


def article_references(text: Column, most: int = 3) -> Column:
    """"Article a, b, c" of the references found, pattern by pattern, distinct in order; null if there is none."""
    found = F.slice(F.array_distinct(F.filter(F.concat(*[X.all_matches(text, p, 1, True) for p in T.ARTICLE_REFERENCES]), lambda a: a != "")), 1, most)
    return F.when(F.size(found) > 0, F.concat(F.lit("Article "), F.array_join(found, ", ")))


def concepts_of(content: Column, summary: Column) -> Column:
    """Concepts one of whose phrases stands in content or summary, in dictionary order."""
    both = [F.lower(F.coalesce(c, F.lit(""))) for c in (content, summary)]
    return F.filter(F.array(*[F.when(X.any_hit(both[0], v) | X.any_hit(both[1], v), k) for k, v in T.CONCEPTS.items()]), lambda c: c.isNotNull())


def concepts(results: DataFrame, by: str, order: str, most: int = 8) -> DataFrame:
    """(by, order, content, summary, article) -> (by, concepts): per result its article label, which may repeat, and its concepts, which may not."""
    return folded_concepts(results.withColumn("found", concepts_of(F.col("content"), F.col("summary"))), by, order, most)


def folded_concepts(results: DataFrame, by: str, order: str, most: int = 8) -> DataFrame:
    """``concepts`` of results that have those of their contents in ``found``."""
    own = results.select(by, F.struct(F.col(order).alias("o"), "article", "found").alias("r"))
    rows = own.groupBy(by).agg(F.array_sort(F.collect_list("r")).alias("rs"))
    empty = F.array().cast("array<string>")
    fold = F.aggregate("rs", empty, lambda acc, r: F.concat(acc, F.when(r["article"].isNotNull() & (r["article"] != ""), F.array(r["article"])).otherwise(empty), F.filter(r["found"], lambda c: ~F.array_contains(acc, c))))
    return rows.select(by, F.slice(fold, 1, most).alias("concepts"))

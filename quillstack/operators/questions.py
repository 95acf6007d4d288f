"""Understanding of questions: routing, expansion, decomposition and search variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import taxonomy as T
from ..functions import text as X
from ..functions.names import unused


def routing(question: Column) -> Column:
    """struct(focus, treaty_matches, judgment_matches, treaty_priority, judgment_priority, strategy, reasoning)."""
    q = F.lower(question)
    treaty, judgment = X.hits(q, T.TREATY_TOPICS), X.hits(q, T.JUDGMENT_TOPICS)
    a, b = treaty / float(len(T.TREATY_TOPICS)), judgment / float(len(T.JUDGMENT_TOPICS))
    ladder = [(X.any_hit(q, terms), strategy, reason) for terms, strategy, reason in T.ROUTES]
    ladder += [(share > least, strategy, reason) for share, (least, strategy, reason) in ((a, T.TREATY_ROUTE), (b, T.JUDGMENT_ROUTE))]
    pick = lambda k, rest: F.coalesce(*[F.when(c, x[k]) for c, *x in ladder], F.lit(rest))
    focus = F.when(judgment > treaty, "judgment").when(treaty > judgment, "geneva").otherwise("both")
    return F.struct(
        focus.alias("focus"), treaty.cast("long").alias("treaty_matches"), judgment.cast("long").alias("judgment_matches"), a.alias("treaty_priority"), b.alias("judgment_priority"),
        pick(0, T.BALANCED_ROUTE[0]).alias("strategy"), pick(1, T.BALANCED_ROUTE[1]).alias("reasoning"),
    )


def _when_array(condition: Column, words: list[str]) -> Column:
    return F.when(condition, F.array(*[F.lit(w) for w in words])).otherwise(F.array().cast("array<string>"))


def expansion_terms(question: Column, most: int = 8) -> Column:
    """Expansions of the terms found, then of the kinds of question; distinct in order, at most ``most``."""
    q = F.lower(question)
    found = [_when_array(q.contains(k), v) for k, v in T.EXPANSIONS.items()] + [_when_array(X.any_hit(q, k), v) for k, v in T.CONTEXT_EXPANSIONS]
    return F.slice(F.array_distinct(F.flatten(F.array(*found))), 1, most)


def expand(question: Column) -> Column:
    terms = expansion_terms(question)
    return F.when(F.size(terms) > 0, F.concat_ws(" ", question, F.array_join(terms, " "))).otherwise(question)


def decompose(question: Column, most: int = 3) -> Column:
    """The question, its parts between conjunctions, and its framework and case words; distinct in order, at most ``most``."""
    q = F.lower(question)
    none = F.array().cast("array<string>")
    parts = F.filter(F.transform(F.split(F.replace(q, F.lit("&"), F.lit("and")), " and "), X.strip), lambda p: p != "")
    tidy = F.array_join(X.words(question), " ")
    of = lambda terms: F.array_join(F.filter(X.words(question), lambda w: X.any_hit(F.lower(w), terms)), " ")
    both = X.any_hit(q, T.FRAMEWORK_WORDS) & X.any_hit(q, T.CASE_WORDS) & (of(T.FRAMEWORK_FILTER) != "") & (of(T.CASE_FILTER) != "")
    found = F.concat(
        F.array(question),
        F.when(X.any_hit(q, ["and", "&"]) & (F.size(parts) > 1), parts).otherwise(none),
        F.when(q.contains("what") & q.contains("how") & (tidy != ""), F.array(tidy, tidy)).otherwise(none),
        F.when(both, F.array(of(T.FRAMEWORK_FILTER), of(T.CASE_FILTER))).otherwise(none),
    )
    return F.slice(F.array_distinct(F.filter(F.transform(found, X.strip), lambda p: p != "")), 1, most)


def variants(question: Column, k: Column | int, kind: str) -> Column:
    """array<struct(variant_ord, query, k)> of a hybrid search: original, sub-questions (judgments only), expanded, and themed ones."""
    k = F.lit(k) if isinstance(k, int) else k
    q, wide = F.lower(question), expand(question)
    part = lambda n: F.floor(k / n).cast("int")
    empty = F.array().cast("array<struct<query:string,k:int>>")
    one = lambda text, n: F.array(F.struct(text.alias("query"), n.cast("int").alias("k")))
    if kind == "judgment":
        tail = F.transform(F.slice(decompose(question), 2, 2), lambda s: F.struct(s.alias("query"), part(2).alias("k")))
        themes = T.JUDGMENT_THEMES
    else:
        tail = empty
        themes = T.TREATY_THEMES
    found = F.concat(one(question, k), tail, F.when(wide != question, one(wide, part(2))).otherwise(empty), *[F.when(X.any_hit(q, terms), one(F.concat(F.lit(prefix), question), part(3))).otherwise(empty) for terms, prefix in themes])
    return F.transform(found, lambda v, i: F.struct(i.alias("variant_ord"), v["query"].alias("query"), v["k"].alias("k")))


def route(questions: DataFrame) -> DataFrame:
    """Adds the routing of ``question``."""
    r = unused(questions, "routing")
    return questions.withColumn(r, routing(F.col("question"))).select("*", f"{r}.*").drop(r)

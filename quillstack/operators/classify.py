"""Section labels: patterns, then keywords, then context, then length and words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import taxonomy as T
from ..functions import text as X
from ..functions.names import unused

RESULT = "struct<section_type:string,confidence:double,evidence:array<string>,hierarchical_level:int>"


def _result(label: Column | str, confidence: Column | float, evidence: Column | None = None) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(as_col(label).alias("section_type"), as_col(confidence).cast("double").alias("confidence"), (evidence if evidence is not None else F.array().cast("array<string>")).alias("evidence"), F.lit(1).alias("hierarchical_level")).cast(RESULT)


def by_patterns(text: Column, *dictionaries: dict[str, list[str]]) -> Column:
    """The first pattern in dictionary order that is found, at the start of any line and in any case; null if none is."""
    every = [(label, p) for d in dictionaries for label, patterns in d.items() for p in patterns]
    which = F.coalesce(*[F.when(text.rlike(X.rx(p, True, lines=True)), k) for k, (_, p) in enumerate(every)])
    of = lambda values: lambda k: F.get(F.lit(values), k)
    label, evidence = of([label for label, _ in every]), of([f"Pattern match: {p}" for _, p in every])
    return X.let(which, lambda k: F.when(k.isNotNull(), _result(label(k), 0.9, F.array(evidence(k)))))


def keyword_scores(text: Column, *dictionaries: dict[str, list[str]]) -> Column:
    """array<struct(score, rank, label)>; rank is minus the dictionary order, so the largest struct is the first best label."""
    labels = [(label, words) for d in dictionaries for label, words in d.items()]
    one = lambda lower, k, label, words: F.struct(X.hits(lower, words).alias("score"), F.lit(-k).alias("rank"), F.lit(label).alias("label"))
    return X.let(F.lower(text), lambda lower: F.array(*[one(lower, k, *x) for k, x in enumerate(labels)]))


def by_keywords(text: Column, *dictionaries: dict[str, list[str]]) -> Column:
    """The first label with the most keywords; confidence min(0.8, n / 3)."""
    found = lambda best: F.when(best["score"] > 0, _result(best["label"], F.least(F.lit(0.8), best["score"] / 3.0), F.array(F.concat(F.lit("Keyword matches: "), best["score"].cast("string")))))
    return X.let(F.array_max(keyword_scores(text, *dictionaries)), found)


def by_context(previous: Column, rules: dict[str, list[str]]) -> Column:
    """The first candidate of the rule that the label before names."""
    return F.coalesce(*[F.when(previous == k, _result(v[0], 0.5, F.array(F.lit(f"Context: {k}")))) for k, v in rules.items()])


def generic(text: Column) -> Column:
    return (
        F.when(F.length(text) < 50, _result("metadata", 0.3))
        .when(X.any_hit(F.lower(text), ["article", "section", "paragraph"]), _result("legal_provision", 0.4))
        .otherwise(_result("facts_background", 0.3))
    )


def classify(text: Column, family: str = "judgment", previous: Column | None = None, patterns: list[dict] | None = None, keywords: list[dict] | None = None) -> Column:
    """The cascade: pattern over 0.8, keyword over 0.6, context over 0.4, else generic. Evaluated in that order and lazily."""
    own_patterns, own_keywords = T.FAMILIES[family]
    first = by_patterns(text, *(patterns if patterns is not None else [own_patterns, T.SHARED_PATTERNS]))
    second = by_keywords(text, *(keywords if keywords is not None else [own_keywords, T.SHARED_KEYWORDS]))
    third = [F.when(previous.isNotNull(), by_context(previous, T.CONTEXT_RULES[family]))] if previous is not None else []
    return F.coalesce(first, X.let(second, lambda s: F.when(s["confidence"] > 0.6, s)), *third, generic(text))


def classify_sections(df: DataFrame, family: str = "judgment", **dictionaries) -> DataFrame:
    """Adds section_type, confidence and evidence of ``text``; a map without shuffle."""
    c = unused(df, "found")
    return df.withColumn(c, classify(F.col("text"), family, **dictionaries)).select("*", f"{c}.section_type", f"{c}.confidence", f"{c}.evidence").drop(c)


def level(label: Column, levels: dict[str, int] = T.LEVELS) -> Column:
    """Hierarchy level 1 to 5 of a label; 3 if it has none."""
    table = F.create_map(*[F.lit(x) for kv in levels.items() for x in kv])
    return F.coalesce(F.try_element_at(table, label), F.lit(T.DEFAULT_LEVEL))


def is_judgment_section(label: Column) -> Column:
    return label.isin(T.JUDGMENT_LABELS)


def is_treaty_section(label: Column) -> Column:
    return label.isin(T.TREATY_LABELS)

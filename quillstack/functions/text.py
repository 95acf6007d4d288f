"""Text expressions with the semantics of Python strings and patterns.

``rx`` gives Java patterns Python's meaning: Unicode classes, Unicode case folding and line ends at \\n only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dictionary


def rx(pattern: str, any_case: bool = False, lines: bool = False, dotall: bool = False) -> str:
    # Nothing follows a group repeated at the end, so it never gives back; Java would take a stack frame a repetition.
    return f"(?dU{'iu' if any_case else ''}{'m' if lines else ''}{'s' if dotall else ''})" + pattern + ("+" if pattern.endswith(")*") else "")


def let(value: Column, body) -> Column:
    """body(value) with the value computed once per row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """str.strip(): white space of any kind from both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def words(c: Column) -> Column:
    """str.split()."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")


def token_count(c: Column) -> Column:
    return F.size(words(c)).cast("long")


def matches(c: Column, patterns: list[str], any_case: bool = False) -> Column:
    """Whether one of the patterns is found."""
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(rx(p, any_case))
    return out


def first_match(c: Column, patterns: list[str], any_case: bool = True, group: int = 0) -> Column:
    """First match of the first pattern that is found; '' if none is."""
    return F.coalesce(*[F.nullif(F.regexp_extract(c, rx(p, any_case), group), F.lit("")) for p in patterns], F.lit(""))


def all_matches(c: Column, pattern: str, group: int = 0, any_case: bool = False, dotall: bool = False) -> Column:
    return F.regexp_extract_all(c, F.lit(rx(pattern, any_case, dotall=dotall)), F.lit(group))


#: Terms beyond which a dictionary is searched by one automaton instead of one search each.
MANY_TERMS = 64


def hits(c: Column, terms: list[str]) -> Column:
    """How many of the terms are substrings (repeated terms count again)."""
    if len(terms) > MANY_TERMS:
        return F.size(dictionary.terms_in(c, list(terms)))
    return let(c, lambda v: F.size(F.filter(F.lit(list(terms)), lambda t: v.contains(t))))


def any_hit(c: Column, terms: list[str]) -> Column:
    if len(terms) > MANY_TERMS:
        return hits(c, terms) > 0
    return let(c, lambda v: F.exists(F.lit(list(terms)), lambda t: v.contains(t)))


def page_range(pages: Column) -> Column:
    """No pages: null; one: "p"; more: "first-last"."""
    n = F.size(pages)
    return F.when(n == 1, F.element_at(pages, 1).cast("string")).when(n > 1, F.concat_ws("-", F.element_at(pages, 1).cast("string"), F.element_at(pages, -1).cast("string")))


def needs_ocr(c: Column) -> Column:
    """Extraction is taken as failed under 100 characters of collapsed text or under 50 Latin letters."""
    collapsed = strip(F.regexp_replace(c, r"(?U)\s+", " "))
    return (F.length(collapsed) < 100) | (F.regexp_count(c, F.lit("[a-zA-Z]")) < 50)


def remove_literals(c: Column, literals: Column) -> Column:
    """Deletes every occurrence of the literals, whatever their case."""
    quoted = lambda t: F.concat(F.lit(r"(?iu)\Q"), F.replace(t, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return F.aggregate(F.filter(literals, lambda t: t != ""), c, lambda text, t: F.regexp_replace(text, quoted(t), F.lit("")))


def tidy(c: Column) -> Column:
    """Blank lines and runs of spaces become one; ends are stripped."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"(?U)\n\s*\n", "\n\n"), " +", " "))

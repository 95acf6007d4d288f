"""URL allow and block lists as a trie over reversed host labels and path segments."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The production rules: verdict, host and path.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
#: Characters of all rules that may be broadcast; longer lists must be split by their last host label.
MOST_CHARACTERS = 64_000_000
#: Verdict without a rule.
DEFAULT = "allow"


class Trie:
    """Rules by reversed host label, then by whole path segment, then by what a rule has of the next segment.

    A rule fits its host and all subdomains if the url's path starts with the rule's path. Of those
    that fit, the rule with the most characters wins; of equals, the one with the longer host, and then block.
    """

    def __init__(self, rules: Iterable[tuple[str, str]]):
        self.root: dict = {}
        self.size = 0
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            host, path = host.lower(), slash + path
            self.size += len(rule)
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node.setdefault("hosts", {}).setdefault(label, {})
            *whole, rest = path.split("/")
            for segment in whole:
                node = node.setdefault("paths", {}).setdefault(segment, {})
            rank = (len(rule), len(host), verdict == "block")
            kept = node.setdefault("ends", {})
            if rest not in kept or rank > kept[rest][0]:
                kept[rest] = (rank, rule, verdict)

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the winning rule."""
        best, segments = None, path.split("/")
        node, labels = self.root, host.split(".") if host else []
        while node is not None:
            inner, k = node, 0
            while inner is not None:
                ends = inner.get("ends")
                if ends:
                    rest = "/".join(segments[k:])
                    for n in {len(e) for e in ends}:
                        found = ends.get(rest[:n]) if n <= len(rest) else None
                        if found and (best is None or found[0] > best[0]):
                            best = found
                if k >= len(segments) - 1:
                    break
                inner = inner.get("paths", {}).get(segments[k])
                k += 1
            node = node.get("hosts", {}).get(labels.pop()) if labels else None
        return best[1:] if best else None


def _judge(trie):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = trie.value
        for batch in batches:
            found = [rules.match(h, p) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            named = [pa.array([f[i] if f else None for f in found], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *named], names=["page_id", "host", "path", "rule", "verdict"])

    return run


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str]] = RULES, default: str = DEFAULT) -> DataFrame:
    """(page_id, url) -> page_id, host, path, rule, verdict, one row per input row.

    The host follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; the path
    goes on to ``?``, ``#`` or the end. A null url or one without ``://`` has an empty host and path, which
    only a rule with an empty host can fit. Without a rule the verdict is ``default`` and the rule null.
    Null and repeated page_ids stay row by row; other columns are not read.
    """
    trie = Trie(rules)
    if trie.size > MOST_CHARACTERS:
        raise ValueError(f"the rules have {trie.size} characters; at most {MOST_CHARACTERS} are broadcast")
    spark = pages.sparkSession
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    rest = F.when(F.locate("://", url) > 0, F.substring_index(F.expr("substring(coalesce(cast(url as string), ''), locate('://', coalesce(cast(url as string), '')) + 3)"), "#", 1)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)
    plain = pages.select(F.col("page_id"), F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"), path.alias("path"))
    kind = plain.schema["page_id"].dataType.simpleString()
    out = plain.mapInArrow(_judge(spark.sparkContext.broadcast(trie)), f"page_id {kind}, host string, path string, rule string, verdict string")
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(default)))

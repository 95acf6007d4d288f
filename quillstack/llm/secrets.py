"""Secrets in texts: known patterns and sliding-window Shannon entropy per character class."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base patterns: kind, pattern, group that is measured, least characters of it.
BASE = (
    ("assign", re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]{32,}"), 0, 32),
)
BASE_KINDS = tuple(k for k, *_ in BASE)
#: Character classes: kind, candidate runs, what a window must hold, least bits a character.
CLASSES = (
    ("entropy_hex", re.compile(r"[0-9A-Fa-f]{24,}"), (re.compile("[0-9]"), re.compile("[A-Fa-f]")), 3.0),
    ("entropy_base64", re.compile(r"[A-Za-z0-9+/_-]{24,}={0,2}"), (re.compile("[0-9]"), re.compile("[a-z]"), re.compile("[A-Z]")), 3.9),
)
#: Characters of an entropy window.
WINDOW = 24
#: The part of a candidate that holds one of these is never reported by entropy (it stays if a base pattern finds it).
ALLOWED = (
    re.compile(r"(?i)example|placeholder|changeme|dummy"),
    re.compile(r"(?<![0-9a-fA-F])[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}(?![0-9a-fA-F])"),
)
#: Stretches of which only the overlapping windows are not reported: filler, and three words in a row, each begun by a
#: capital or after something that is no letter (paths and identifiers that can be read), of ``READABLE_LEAST`` characters.
FILLER = re.compile(r"(?i)xxxx|0{8}|1234567|abcdefg")
READABLE = re.compile(r"(?:(?:[A-Z][a-z]{3,}|(?<![A-Za-z])[a-z]{3,})(?:[A-Z][a-z]{1,2}(?=[A-Z]))?[0-9]{0,3}[/_-]?){3,}")
READABLE_LEAST = 12
#: What ends the part around an allowed match, which reaches ``WINDOW`` characters to each side at most.
_HEAD, _TAIL = re.compile(r"[^+/_=-]*$"), re.compile(r"[^+/_=-]*")
KINDS = (*BASE_KINDS, *(k for k, *_ in CLASSES))
SPANS = "array<struct<kind:string,start:long,end:long>>"
_C_LOG_C = [0.0] + [c * math.log2(c) for c in range(1, 4096)]


def window_runs(text: str, window: int, least: float) -> Iterator[tuple[int, int]]:
    """Maximal runs covered by windows whose entropy is at least ``least`` bits a character.

    Entropy is log2(w) - sum(c log2 c) / w; moving the window by a character changes two counts.
    """
    counts: dict[str, int] = {}
    total, start, end = 0.0, -1, -1
    for i, ch in enumerate(text):
        c = counts.get(ch, 0)
        counts[ch] = c + 1
        total += _C_LOG_C[c + 1] - _C_LOG_C[c]
        if i >= window:
            old = text[i - window]
            c = counts[old]
            counts[old] = c - 1
            total += _C_LOG_C[c - 1] - _C_LOG_C[c]
        if i >= window - 1 and math.log2(window) - total / window >= least - 1e-9:
            first = i - window + 1
            if first > end:
                if start >= 0:
                    yield start, end
                start = first
            end = i + 1
    if start >= 0:
        yield start, end


def searched(run: str) -> Iterator[tuple[int, int]]:
    """The stretches of a candidate run outside the parts that the allow list suppresses, filler and what can be read."""
    parts = [m.span() for m in FILLER.finditer(run)] + [m.span() for m in READABLE.finditer(run) if m.end() - m.start() >= READABLE_LEAST]
    for allowed in ALLOWED:
        for m in allowed.finditer(run):
            low, high = max(0, m.start() - WINDOW), min(len(run), m.end() + WINDOW)
            parts.append((_HEAD.search(run[low : m.start()]).start() + low, _TAIL.match(run, m.end(), high).end()))
    at = 0
    for start, end in sorted(parts):
        if at < start:
            yield at, start
        at = max(at, end)
    if at < len(run):
        yield at, len(run)


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every span, in code points, by start and then kind."""
    spans = []
    for kind, pattern, group, least in BASE:
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                spans.append((m.start(), KINDS.index(kind), m.end()))
    for rank, (kind, pattern, needs, least) in enumerate(CLASSES, len(BASE)):
        for m in pattern.finditer(text):
            run = m.group()
            if not all(n.search(run) for n in needs):
                continue
            for low, high in searched(run):
                for start, end in window_runs(run[low:high], WINDOW, least):
                    if all(n.search(run, low + start, low + end) for n in needs):
                        spans.append((m.start() + low + start, rank, m.start() + low + end))
    return [(KINDS[k], s, e) for s, k, e in sorted(spans)]


def redact(text: str, spans: list[tuple[str, int, int]], mark: str = "[REDACTED]") -> str:
    """The text with every run of overlapping spans replaced by ``mark``."""
    parts, at, k = [], 0, 0
    ordered = sorted((s, e) for _, s, e in spans)
    while k < len(ordered):
        start, end = ordered[k]
        while k < len(ordered) and ordered[k][0] <= end:
            end = max(end, ordered[k][1])
            k += 1
        parts += [text[at:start], mark]
        at = end
    return "".join([*parts, text[at:]])


_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _scan(names: list[str], text_at: int, clean: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, texts = [], []
            for value in batch.column(text_at):
                text = value.as_py()
                spans = find(text) if text else []
                found.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
                if clean:
                    texts.append(redact(text, spans) if spans else text)
            columns = list(batch.columns)
            if clean:
                columns[text_at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=names)
            else:
                columns.pop(text_at)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found, _TYPE)], names=[n for i, n in enumerate(names) if i != text_at] + ["spans"])

    return run


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, spans (kind, start, end in code points, end exclusive), one row per input row.

    A map over whole texts, without shuffle. Base patterns are matched leftmost and non-overlapping
    per kind and failing matches are dropped; entropy spans come from the stretches of candidate runs
    outside the parts that hold an allow-listed match and outside filler and readable words in a row. Null and empty texts have no spans; null and repeated doc_ids stay row by row.
    """
    plain = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(_scan(["doc_id", "text"], 1, False), f"doc_id {kind}, spans {SPANS}")


def redacted(docs: DataFrame) -> DataFrame:
    """The same rows and columns with the secrets in ``text`` replaced by a mark; null and empty texts stay as they are."""
    return docs.mapInArrow(_scan(docs.columns, docs.columns.index("text"), True), docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """Counts, the base spans' SHA-256 and all spans as text, from ``find_secrets``."""
    kept = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(kept), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))

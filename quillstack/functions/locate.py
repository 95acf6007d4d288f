"""Places of many needles in one text, and the pages of places, by Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

_BASE = 0x9E3779B97F4A7C15 | 1


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def first_places(text: str, needles: list[str]) -> list[int]:
    """Code point at which each needle first stands in the text; -1 if nowhere, 0 for the empty one.

    Needles of one length are found together: a rolling hash of that length over the whole text, bisected in
    the sorted hashes of the needles. Equal hashes are compared by character.
    """
    out = [-1] * len(needles)
    by: dict[int, dict[str, list[int]]] = {}
    for i, n in enumerate(needles):
        by.setdefault(len(n), {}).setdefault(n, []).append(i)
    points = _points(text)
    longest = max([0, *(size for size in by if size <= len(points))])
    power = np.full(len(points) + 1, _BASE, np.uint64)
    power[:1] = 1
    power = np.cumprod(power, dtype=np.uint64)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * power[1:], dtype=np.uint64, out=sums[1:])
    for size, group in by.items():
        if size == 0:
            for i in group[""]:
                out[i] = 0
            continue
        if size > longest:
            continue
        # A window's sum times the power that its end lacks of the text's end: equal windows, equal numbers.
        windows = (sums[size:] - sums[:-size]) * power[: len(points) - size + 1][::-1]
        own = {}
        for n in group:
            p = _points(n).astype(np.uint64) + np.uint64(1)
            total = np.add.reduce(p * power[1 : size + 1], dtype=np.uint64)
            own.setdefault(int(total) * int(power[len(points) - size]) & 0xFFFFFFFFFFFFFFFF, []).append(n)
        wanted = np.array(sorted(own), np.uint64)
        at = np.minimum(np.searchsorted(wanted, windows), len(wanted) - 1)
        for place in np.flatnonzero(wanted[at] == windows).tolist():
            same = own.get(int(windows[place]))
            found = [n for n in same or () if text[place : place + size] == n]
            for n in found:
                for i in group[n]:
                    out[i] = place
                same.remove(n)
    return out


def pages_of(text: str | None, sizes: np.ndarray, pages: np.ndarray, heads: list[str], lengths: list[int]) -> list[list[int]]:
    """[first, last] page of each chunk: that of the first word at or after its first and last place; 1 beyond the last word."""
    places = first_places(text, [h or "" for h in heads]) if text is not None else [-1] * len(heads)
    starts = np.cumsum(sizes + 1) - sizes - 1
    padded = np.append(pages, 1)
    out = []
    for place, size in zip(places, lengths, strict=True):
        out.append([1, 1] if place < 0 or size is None else padded[np.searchsorted(starts, [place, place + size])].tolist())
    return out


def pages():
    """(text, word sizes, word pages, heads, chunk sizes) -> array<array<bigint>>, as a function of columns."""

    @F.arrow_udf("array<array<bigint>>")
    def run(text: pa.Array, sizes: pa.Array, of: pa.Array, heads: pa.Array, lengths: pa.Array) -> pa.Array:
        numbers = lambda v: v.values.to_numpy(zero_copy_only=False).astype(np.int64) if v.is_valid else np.zeros(0, np.int64)
        rows = [pages_of(t.as_py(), numbers(s), numbers(p), h.as_py() or [], n.as_py() or []) for t, s, p, h, n in zip(text, sizes, of, heads, lengths, strict=True)]
        return pa.array(rows, pa.list_(pa.list_(pa.int64())))

    return run

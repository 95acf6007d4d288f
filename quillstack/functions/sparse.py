"""Sparse TF-IDF vectors of the parts of a row, by Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F


#: Terms of the rows that are handled together; bounds the temporaries of a worker.
STEP_TERMS = 1 << 19


def _inner(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Elements of a list column, and their number in each row (0 for null)."""
    return column.flatten(), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def cosines(rows: pa.Array, features: int | None) -> pa.Array:
    """Lists of parts, which are lists of terms -> lists of the cosine of each part with the next one.

    A part is a run of (part, term, count) sorted by both, for all rows at once; neighbours meet by bisection.
    Weights are divided by their part's length before they are multiplied, and logarithms are the C library's:
    a similarity at a threshold falls to the side where SQL's ``w / sqrt(sum(w * w))`` has it while sums have two terms at most.
    """
    parts, n_parts = _inner(rows)
    terms, n_terms = _inner(parts)
    row = np.repeat(np.arange(len(rows)), n_parts)
    first = np.cumsum(n_parts) - n_parts
    part = np.repeat(np.arange(len(row)), n_terms)
    coded = terms.dictionary_encode()
    words = coded.dictionary
    rank = np.empty(len(words), np.int64)
    rank[pc.sort_indices(words).to_numpy()] = np.arange(len(words))
    code = rank[coded.indices.to_numpy()] if len(terms) else np.zeros(0, np.int64)
    base = max(1, len(words))
    key, tf = np.unique(part * base + code, return_counts=True)
    part, code = key // base, key % base
    # Sums of a row's terms: total count and number of parts.
    of_row, back = np.unique(row[part] * base + code, return_inverse=True)
    total, df = np.bincount(back, tf, len(of_row)), np.bincount(back, minlength=len(of_row))
    if features is not None:
        order = np.lexsort((of_row % base, -total, of_row // base))
        starts = np.searchsorted(of_row // base, of_row // base)
        place = np.empty(len(of_row), np.int64)
        place[order] = np.arange(len(of_row)) - starts  # rows stay together, so their starts do
        keep = (place < features)[back]
        key, part, tf, back = key[keep], part[keep], tf[keep], back[keep]
    ratios, which = np.unique((1.0 + n_parts[row[part]]) / (1.0 + df[back]), return_inverse=True)
    logs = np.fromiter(map(math.log, ratios), np.float64, len(ratios))
    weight = tf * (logs[which] + 1)
    weight /= np.sqrt(np.bincount(part, weight * weight, len(row)))[part]
    at = np.searchsorted(key, key + base)
    meets = np.flatnonzero((at < len(key)) & (key[np.minimum(at, len(key) - 1)] == key + base)) if len(key) else np.zeros(0, np.int64)
    # Where no neighbours meet, bincount gives integers, whatever the weights.
    value = np.bincount(part[meets], weight[meets] * weight[at[meets]], len(row)).astype(np.float64) if len(row) else np.zeros(0)
    last = np.zeros(len(row), bool)
    last[(first + n_parts - 1)[n_parts > 0]] = True
    offsets = np.concatenate([[0], np.cumsum(np.maximum(n_parts - 1, 0))]).astype(np.int32)
    out = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(value[~last]))
    return pc.if_else(pc.is_valid(rows), out, pa.scalar(None, out.type)) if rows.null_count else out


def steps(rows: pa.Array) -> Iterator[pa.Array]:
    """Slices of at most ``STEP_TERMS`` terms; a row with more comes alone."""
    parts, n_parts = _inner(rows)
    ends = np.cumsum(_inner(parts)[1])
    ends = np.r_[0, ends][np.cumsum(n_parts)]
    first = 0
    while first < len(rows):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + STEP_TERMS, "right")))
        yield rows.slice(first, last - first)
        first = last


def _by_steps(rows: pa.Array, features: int | None) -> pa.Array:
    return pa.concat_arrays([pa.array([], pa.list_(pa.float64())), *(cosines(r, features) for r in steps(rows))])


def neighbour_cosines(features: int | None):
    """array<array<string>> -> array<double>, as a function of a column."""

    @F.arrow_udf("array<double>")
    def run(rows: pa.Array) -> pa.Array:
        return _by_steps(rows, features)

    return run


def neighbour_cosines_of_each(features: int | None):
    """array<array<array<string>>> -> array<array<double>>: ``neighbour_cosines`` of each element."""

    @F.arrow_udf("array<array<double>>")
    def run(rows: pa.Array) -> pa.Array:
        inner, sizes = _inner(rows)
        out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), _by_steps(inner, features))
        return pc.if_else(pc.is_valid(rows), out, pa.scalar(None, out.type)) if rows.null_count else out

    return run

"""Periodic runs of words: suffix automaton, neighbour distances of end positions, extension."""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import steps

#: Least length of a run in words, and in periods.
LEAST, EXPONENT = 6, 4
#: End positions of a piece of an ordered set.
PIECE = 512


def automaton(word: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix automaton of a sequence: longest length, suffix link and end position (-1 for clones) of every state."""
    length, link, end, moves = [0], [-1], [-1], [{}]
    last = 0
    for i, c in enumerate(word):
        state = len(length)
        length.append(length[last] + 1), link.append(0), end.append(i), moves.append({})
        p, last = last, state
        while p >= 0 and c not in moves[p]:
            moves[p][c] = state
            p = link[p]
        if p < 0:
            continue
        q = moves[p][c]
        if length[q] != length[p] + 1:
            clone = len(length)
            length.append(length[p] + 1), link.append(link[q]), end.append(-1), moves.append(dict(moves[q]))
            link[q] = clone
            while p >= 0 and moves[p].get(c) == q:
                moves[p][c] = clone
                p = link[p]
            q = clone
        link[state] = q
    return length, link, end


class Ends:
    """An ordered set of end positions in pieces of bounded size; ``add`` gives the neighbours of the new one."""

    def __init__(self, first: int):
        self.pieces, self.heads, self.size = [[first]], [first], 1

    def add(self, x: int) -> tuple[int, int]:
        k = max(0, bisect_right(self.heads, x) - 1)
        piece = self.pieces[k]
        at = bisect_left(piece, x)
        before = piece[at - 1] if at else -1
        after = piece[at] if at < len(piece) else self.heads[k + 1] if k + 1 < len(self.heads) else -1
        piece.insert(at, x)
        self.heads[k] = piece[0]
        self.size += 1
        if len(piece) > PIECE:
            self.pieces.insert(k + 1, piece[PIECE // 2 :])
            self.heads.insert(k + 1, piece[PIECE // 2])
            del piece[PIECE // 2 :]
        return before, after

    def __iter__(self) -> Iterator[int]:
        return (x for piece in self.pieces for x in piece)


def seeds(word: Sequence[int], exponent: int = EXPONENT) -> Iterator[tuple[int, int, int]]:
    """(start, end, distance): equal occurrences of a state's longest string that end ``distance`` apart.

    States are merged into their suffix links from the longest on, the smaller set of end positions into
    the larger. A new neighbour distance d of a state of length l with d <= l makes the stretch of l + d
    words periodic, a square; only those with (exponent - 1) d <= l are of use, as the two occurrences
    that a run is made of are neighbours: a nearer one between them would give the run a smaller period.
    """
    length, link, end = automaton(word)
    sets: list[Ends | None] = [Ends(e) if e >= 0 else None for e in end]
    for v in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
        u, own = link[v], sets[v]
        sets[v] = None
        if u == 0:
            continue
        into = sets[u]
        if into is None or into.size < own.size:
            into, own = own, into
        sets[u] = into
        size = length[u]
        for x in own or ():
            before, after = into.add(x)
            if before >= 0 and (exponent - 1) * (x - before) <= size:
                yield before - size + 1, x, x - before
            if after >= 0 and (exponent - 1) * (after - x) <= size:
                yield x - size + 1, after, after - x


def runs(word: Sequence[int], least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run of at least ``least`` words and ``exponent`` periods, by start and period.

    Seeds are extended to both sides as long as words a distance apart are equal; a seed inside a stretch
    already found for its distance is skipped. Of one stretch the smallest distance is the period.
    """
    found: dict[int, list[tuple[int, int]]] = {}
    periods: dict[tuple[int, int], int] = {}
    n = len(word)
    for start, end, d in seeds(word, exponent):
        known = found.setdefault(d, [])
        k = bisect_right(known, (start, n)) - 1
        if k >= 0 and known[k][1] >= end:
            continue
        while start and word[start - 1] == word[start - 1 + d]:
            start -= 1
        while end + 1 < n and word[end + 1] == word[end + 1 - d]:
            end += 1
        insort(known, (start, end))
        periods[start, end] = min(d, periods.get((start, end), d))
    return sorted((s, e - s + 1, d) for (s, e), d in periods.items() if e - s + 1 >= max(least, exponent * d))


def stretches(codes: np.ndarray, rows: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int]]:
    """Stretches (start, end) of one row outside which no run can lie.

    A run of n words holds each of its words again at most n / exponent words away, so a word whose
    nearest copy inside its stretch is further off than that cuts the stretch; this goes on until
    nothing is cut, and stretches that are too short go.
    """
    at = np.arange(len(codes))
    while len(at):
        cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(rows[at]) != 0)) + 1
        first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(at)]])
        part = np.repeat(np.arange(len(first)), last - first)
        size = (last - first)[part]
        order = np.lexsort((at, codes[at], part))
        same = (np.diff(codes[at][order]) == 0) & (np.diff(part[order]) == 0)
        gap = np.where(same, np.diff(at[order]), len(codes) + 1)
        near = np.empty(len(at), np.int64)
        near[order] = np.minimum(np.concatenate([gap, [len(codes) + 1]]), np.concatenate([[len(codes) + 1], gap]))
        keep = (near * exponent <= size) & (size >= least)
        if keep.all():
            return list(zip(at[first].tolist(), (at[last - 1] + 1).tolist(), strict=True))
        at = at[keep]
    return []


def _coded(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Code of every word, row boundaries, and the words as lists."""
    lists = pc.ascii_split_whitespace(column.cast(pa.large_string()).fill_null(""))
    flat = lists.flatten()
    kept = pc.not_equal(flat, "")
    sizes = lists.value_lengths().to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)[kept.to_numpy(zero_copy_only=False)]
    words = flat.filter(kept)
    edges = np.searchsorted(row, np.arange(len(sizes) + 1))
    return words.dictionary_encode().indices.to_numpy(), edges, words


def _collapsed(words: pa.Array, low: int, high: int, found: list[tuple[int, int, int]]) -> str:
    """The text without the words that any run holds after its first period."""
    keep = np.ones(high - low, bool)
    for start, length, period in found:
        keep[start + period : start + length] = False
    return " ".join(words.slice(low, high - low).filter(pa.array(keep)).to_pylist())


def _scan(names: list[str], text_at: int, least: int, exponent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole, names[text_at]):
                codes, edges, words = _coded(batch.column(text_at))
                rows = np.repeat(np.arange(batch.num_rows), np.diff(edges))
                found: list[list[tuple[int, int, int]]] = [[] for _ in range(batch.num_rows)]
                for start, end in stretches(codes, rows, least, exponent):
                    row = int(rows[start])
                    found[row] += [(s + start - int(edges[row]), n, p) for s, n, p in runs(codes[start:end].tolist(), least, exponent)]
                lists = [[{"start": s, "length": n, "period": p} for s, n, p in f] for f in found]
                texts = [_collapsed(words, int(a), int(b), f) for a, b, f in zip(edges[:-1], edges[1:], found, strict=True)]
                columns = [c for k, c in enumerate(batch.columns) if k != text_at]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(lists, _RUNS), pa.array(texts, pa.string())], names=[n for k, n in enumerate(names) if k != text_at] + ["runs", "collapsed"])

    return run


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def periodic_runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """(doc_id, text) -> doc_id, runs (start, length, period), collapsed text; one row per input row, without shuffle.

    Words are stretches outside [\\x20\\x09-\\x0D], numbered from 0. A run is a maximal stretch with smallest
    period p of at least max(``least``, ``exponent`` * p) words; runs come by start, then period. ``collapsed``
    has the words that no run holds after its first period, joined by single spaces. Null and empty texts have
    no runs and collapse to the empty text; null and repeated doc_ids stay row by row. Other columns are ignored.
    """
    if exponent < 2 or least < 1:
        raise ValueError("a run has two periods and one word at least")
    plain = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(_scan(["doc_id", "text"], 1, least, exponent), f"doc_id {kind}, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """The documents with a periodic end in those whose crc32 of doc_id is divisible by 10; a null doc_id is left as it is."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("w"), F.floor(h / 10).alias("g"))
    rows = rows.withColumn("n", F.size("w").cast("long"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", F.lit(1) + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    end = F.expr("concat(slice(w, 1, int(a)), transform(sequence(a, n - 1), i -> w[int(a + (i - a) % p)]))")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(end, " ")).otherwise(F.col("text")).alias("text"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc, found, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            best = max(found, key=lambda r: (Fraction(r["length"], r["period"]), -r["start"], -r["period"]), default={"start": None, "length": None, "period": None})
            lines = "".join(f"{r['start']},{r['length']},{r['period']}\n" for r in found)
            out.append({"doc_id": doc, "n_runs": len(found), **best, "exponent_milli": 1000 * best["length"] // best["period"] if found else None, "runs_sha256": hashlib.sha256(lines.encode()).hexdigest(), "collapsed_sha256": hashlib.sha256(text.encode()).hexdigest()})
        yield pa.RecordBatch.from_pylist(out, _DIGEST)


_DIGEST = pa.schema([("doc_id", pa.int64()), *((k, pa.int64()) for k in ("n_runs", "start", "length", "period", "exponent_milli")), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])


def digest(found: DataFrame) -> DataFrame:
    """Number of runs, the run of the greatest exponent (ties: smallest start, then period) and SHA-256 of runs and text."""
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "runs", "collapsed").mapInArrow(_digests, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")

"""All terms of a dictionary that stand in a text: an automaton over bytes, run by Arrow batches.

Failure links are resolved into a table of moves, so a byte is one look-up whatever the number of terms. Texts are
cut into pieces that overlap by the longest term less one byte, and all pieces of a batch advance in step. A term
without a blank lies within what stands between two blanks, so those terms are sought once in each distinct word of a
step's texts; only terms with a blank are sought in the texts themselves.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a piece of text, and pieces that advance together.
PIECE, TOGETHER = 2048, 8192
#: Bytes of text whose words are looked up in one step; bounds the temporaries of a worker.
STEP_BYTES = 1 << 22


def _repeated(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the runs of ``sizes`` that begin at ``starts``, one after another."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted and once each; by sorting, which takes a fifth of the time of NumPy's hashing here."""
    keys = np.sort(keys)
    return keys[np.r_[True, keys[1:] != keys[:-1]][: len(keys)]]


class Automaton:
    """Moves and outputs of the distinct terms; bytes that no term holds share one column of the table."""

    def __init__(self, terms: list[str]):
        self.terms = [t.encode() for t in terms]
        used = sorted({b for t in self.terms for b in t})
        self.classes = np.zeros(256, np.int64)
        self.classes[used] = np.arange(1, len(used) + 1)
        children: list[dict[int, int]] = [{}]
        ends: list[list[int]] = [[]]
        for k, term in enumerate(self.terms):
            state = 0
            for b in term:
                c = int(self.classes[b])
                if c not in children[state]:
                    children[state][c] = len(children)
                    children.append({}), ends.append([])
                state = children[state][c]
            ends[state].append(k)
        self.moves = np.zeros((len(children), len(used) + 1), np.int32)
        fail, queue = [0] * len(children), deque([0])
        while queue:
            state = queue.popleft()
            self.moves[state] = self.moves[fail[state]] if state else 0
            for c, child in children[state].items():
                fail[child] = int(self.moves[fail[state], c]) if state else 0
                self.moves[state, c] = child
                ends[child] = ends[child] + ends[fail[child]]
                queue.append(child)
        self.many = np.array([len(e) for e in ends], np.int64)
        self.first = np.cumsum(self.many) - self.many
        self.ends = np.array([k for e in ends for k in e], np.int64)
        self.has = np.array([bool(e) for e in ends])
        self.longest = max(map(len, self.terms), default=0)

    def found(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs of row and term; null texts hold nothing. The empty term stands in every text."""
        column = texts.cast(pa.large_string())
        valid = column.is_valid().to_numpy(zero_copy_only=False)
        column = column.fill_null("")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        # Pieces: where each starts to be read, and where it ends; the bytes before its own only bring the state up.
        sizes = np.diff(offsets)
        count = -(-sizes // PIECE)
        row = np.repeat(np.arange(len(sizes)), count)
        start = offsets[:-1][row] + (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * PIECE
        end = np.minimum(start + PIECE, offsets[1:][row])
        start = np.maximum(offsets[:-1][row], start - max(0, self.longest - 1))
        rows, states = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        order = np.argsort(start - end, kind="stable")  # longest first, so those still running are the first
        base = len(self.has)
        for first in range(0, len(order), TOGETHER):
            own = order[first : first + TOGETHER]
            at, length, of = start[own], end[own] - start[own], row[own]
            state, seen = np.zeros(len(own), np.int64), np.zeros(0, np.int64)
            for i in range(int(length[0])):
                n = int(np.searchsorted(-length, -i, "left"))
                state = self.moves[state[:n], self.classes[data[at[:n] + i]]].astype(np.int64)
                hit = np.flatnonzero(self.has[state])
                if len(hit):
                    seen = np.concatenate([seen, of[hit] * base + state[hit]])
                    if len(seen) > 1 << 18:
                        seen = _distinct(seen)
            seen = _distinct(seen)
            rows.append(seen // base), states.append(seen % base)
        r, s = np.concatenate(rows), np.concatenate(states)
        many = self.many[s]
        terms = self.ends[_repeated(self.first[s], many)]
        empty = [k for k, t in enumerate(self.terms) if not t]
        everywhere = np.flatnonzero(valid)
        r = np.concatenate([np.repeat(r, many), np.tile(everywhere, len(empty))])
        terms = np.concatenate([terms, np.repeat(np.array(empty, np.int64), len(everywhere))])
        pairs = _distinct(r * max(1, len(self.terms)) + terms)
        return pairs // max(1, len(self.terms)), pairs % max(1, len(self.terms))


class Dictionary:
    """The automata of the distinct terms with and without a blank."""

    def __init__(self, terms: list[str]):
        own = [[k for k, t in enumerate(terms) if (" " in t or not t) == blank] for blank in (True, False)]
        (self.wide, self.of_wide), (self.plain, self.of_plain) = ((Automaton([terms[k] for k in ks]) if ks else None, np.array(ks, np.int64)) for ks in own)
        self.size = max(1, len(terms))

    def found(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs of row and term, by row and then by term; null texts hold nothing."""
        keys = [np.zeros(0, np.int64)]
        if self.wide:
            rows, terms = self.wide.found(texts)
            keys.append(rows * self.size + self.of_wide[terms])
        if self.plain:
            parts = pc.split_pattern(texts.cast(pa.large_string()).fill_null(""), " ")
            coded = parts.flatten().dictionary_encode()
            words, base = coded.dictionary, max(1, len(coded.dictionary))
            row = np.repeat(np.arange(len(texts)), parts.value_lengths().to_numpy(zero_copy_only=False))
            held = _distinct(row * base + coded.indices.to_numpy(zero_copy_only=False).astype(np.int64))
            word, terms = self.plain.found(words)
            many = np.bincount(word, minlength=base)
            of = held % base
            own = terms[_repeated((np.cumsum(many) - many)[of], many[of])]
            keys.append(_distinct(np.repeat(held // base, many[of]) * self.size + self.of_plain[own]))
        pairs = np.concatenate(keys) if self.wide is None or self.plain is None else np.sort(np.concatenate(keys))
        return pairs // self.size, pairs % self.size


def _steps(texts: pa.Array):
    """Slices of at most ``STEP_BYTES`` bytes of text; a longer text comes alone."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + STEP_BYTES, "right")))
        yield texts.slice(first, last - first)
        first = last


def terms_in(text: Column, terms: list[str]) -> Column:
    """Indices of the terms that are substrings of the text, in order; null for a null text."""
    distinct = sorted(set(terms))
    places: dict[str, list[int]] = {}
    for k, t in enumerate(terms):
        places.setdefault(t, []).append(k)
    many = np.array([len(places[t]) for t in distinct], np.int64)
    of = np.array([k for t in distinct for k in places[t]], np.int64)
    made: list[Dictionary] = []

    def indices(texts: pa.Array) -> pa.Array:
        rows, found = made[0].found(texts)
        at = of[_repeated((np.cumsum(many) - many)[found], many[found])]
        rows = np.repeat(rows, many[found])
        order = np.lexsort((at, rows))
        offsets = np.searchsorted(rows, np.arange(len(texts) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(at[order].astype(np.int32)), mask=pc.is_null(texts))

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        if not made:  # once a worker
            made.append(Dictionary(distinct))
        return pa.concat_arrays([pa.array([], pa.list_(pa.int32())), *map(indices, _steps(texts))])

    return run(text)

"""Interpolated modified Kneser-Ney trigram model: counted in Spark, kept as sorted hash arrays, mapped by workers.

A trigram u v w is counted in the shard of its middle token v, which so knows how often u v is a history and how many
different u stand before v w. Tokens v that are very frequent are dealt out by (v, u) instead, and what their shards know
of v w is summed in the shard of w. A token is 64 bits of hash; beside v, u is its upper 32 bits and w its upper 40.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, counted, flat, mixed, steps, word_hashes

_U8 = np.uint64
#: Hashes of the end of a text and of what stands before its first word.
END, BEGIN = (mixed(np.array([k], _U8))[0] for k in (0x6A09E667F3BCC909, 0xBB67AE8584CAA73B))
#: Bytes of text scored in one step, and tokens of a task that are held before they are dealt out.
STEP, HELD = 2 << 20, 3 << 19
#: One document in so many is read for the frequent tokens; a token is frequent with this share of a shard's tokens; their number.
SAMPLED, SHARE, FREQUENT = 64, 0.25, 1024


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, previous and last but one hash, and row of every token; each row ends with ``END``."""
    data, offsets = flat(column)
    words, rows = word_hashes(data, offsets, lower=True)
    n = len(offsets) - 1
    counts = np.bincount(rows, minlength=n)
    ends = np.cumsum(counts + 1) - 1
    out = np.empty(len(words) + n, _U8)
    here = np.ones(len(out), bool)
    here[ends] = False
    out[here], out[ends] = words, END
    before = np.r_[BEGIN, out[:-1]].astype(_U8) if len(out) else out
    before[(ends - counts)] = BEGIN
    two = np.r_[BEGIN, before[:-1]].astype(_U8) if len(out) else out
    two[(ends - counts)] = BEGIN
    return out, before, two, np.repeat(np.arange(n), counts + 1)


def _pair(v: np.ndarray, other: np.ndarray, side: int) -> np.ndarray:
    """A hash of v with the bits of a token before (side 1) or after it (side 2)."""
    return mixed(v * _U8(0x9E3779B97F4A7C15) + mixed(other + _U8(side << 60)))


def _upper(token: np.ndarray, bits: int) -> np.ndarray:
    return token >> _U8(64 - bits)


def histories(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return _pair(v, _upper(u, 32), 1)


def bigrams(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return _pair(v, _upper(w, 40), 2)


def homes(v: np.ndarray, shards: int, frequent: np.ndarray, split: np.ndarray) -> np.ndarray:
    """The shard of v; of a frequent v that of ``split``."""
    common = frequent[np.minimum(np.searchsorted(frequent, v), len(frequent) - 1)] == v
    return (np.where(common, split, _upper(v, 40)) % _U8(shards)).astype(np.int64)


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts the keys, and where each distinct one begins in it."""
    order = np.argsort(keys, kind="stable")
    own = keys[order]
    return order, np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else order[:0]


def _small(x: np.ndarray) -> bytes:
    """Numbers in one, four or eight bytes each."""
    top = int(x.max()) if len(x) else 0
    return x.astype("<u1" if top < 1 << 8 else "<u4" if top < 1 << 32 else "<i8").tobytes()


def _wide(body: bytes, n: int) -> np.ndarray:
    return np.frombuffer(body, {1: "<u1", 4: "<u4", 8: "<i8"}[len(body) // n] if n else "<u1").astype(np.int64)


CHUNKS = "bucket int, v binary, per_v binary, u binary, per_u binary, w binary, low binary, n binary"
PARTS = "bucket int, kind int, a binary, b binary, n binary"
STATS, WORDS, PAIRS, FREQ = range(4)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [c.split() for c in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if t == "int" else pa.binary()) for (_, t), c in zip(names, columns, strict=True)], names=[n for n, _ in names])


def _count(shards: int, frequent: np.ndarray):
    """(text) -> trigram counts in chunks by shard, as v, the u before it and the w after those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> Iterator[pa.RecordBatch]:
            w, v, u = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order, first = grouped(_pair(histories(u, v), _upper(w, 40), 2))
            n = np.diff(np.r_[first, len(order)])
            at = order[first]
            w, v, u = w[at], v[at], u[at]
            own = histories(u, v)
            bucket = homes(v, shards, frequent, own)
            order = np.lexsort((own, v, bucket))
            w, v, own, u, n, bucket = w[order], v[order], own[order], u[order], n[order], bucket[order]
            edges = np.searchsorted(bucket, np.arange(shards + 1))
            rows = []
            for k in np.flatnonzero(np.diff(edges)).tolist():
                x = slice(edges[k], edges[k + 1])
                new_u = np.flatnonzero(np.r_[True, own[x][1:] != own[x][:-1]])
                per_u = np.diff(np.r_[new_u, edges[k + 1] - edges[k]])
                heads = v[x][new_u]
                new_v = np.flatnonzero(np.r_[True, heads[1:] != heads[:-1]])
                rows.append((k, heads[new_v].tobytes(), _small(np.diff(np.r_[new_v, len(heads)])), _upper(u[x][new_u], 32).astype("<u4").tobytes(), _small(per_u), _upper(w[x], 32).astype("<u4").tobytes(), (_upper(w[x], 40) & _U8(255)).astype("<u1").tobytes(), _small(n[x])))
            for i in range(0, len(rows), 64):
                yield _batch(rows[i : i + 64], CHUNKS)

        size = 0
        for batch in batches:
            for part in steps(batch, most=STEP):
                held.append(tokens(part.column(0))[:3])
                size += len(held[-1][0])
                if size > HELD:
                    yield from out()
                    size = 0
        if held:
            yield from out()

    return run


def _save(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """Arrays as one file in the shared store: their names, kinds and places, then their bytes; a repeated task leaves the same file."""
    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part, at, heads = f"{path}-{uuid.uuid4().hex}", 4096, []
    for name, x in arrays.items():
        heads.append(f"{name} {x.dtype.str} {len(x)} {at}")
        at += -(-x.nbytes // 64) * 64
    with system.open_output_stream(part) as f:
        f.write("\n".join(heads).encode().ljust(4096))
        for x in arrays.values():
            f.write(np.ascontiguousarray(x).tobytes().ljust(-(-x.nbytes // 64) * 64, b"\0"))
    system.move(part, path)


_mapped: dict[str, dict[str, np.ndarray]] = {}


def mapped(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file as read-only maps; a store that is not mounted gives them from memory. No file: no arrays."""
    if uri not in _mapped:
        system, path = fs.FileSystem.from_uri(uri)
        if isinstance(system, fs.LocalFileSystem):
            whole = np.memmap(path, np.uint8, "r") if os.path.exists(path) else None
        else:
            whole = np.frombuffer(system.open_input_file(path).read_buffer(), np.uint8) if system.get_file_info(path).is_file else None
        found = {}
        for line in bytes(whole[:4096]).decode().split("\n") if whole is not None else ():
            name, kind, n, at = line.split()
            kind = np.dtype(kind)
            found[name] = np.asarray(whole[int(at) : int(at) + int(n) * kind.itemsize]).view(kind)
        _mapped[uri] = found
    return _mapped[uri]


def _keys(name: str, keys: np.ndarray) -> dict[str, np.ndarray]:
    """Sorted 64-bit keys as the 32 bits below a prefix, and where each prefix starts; about 64 keys share one."""
    bits = max(0, len(keys).bit_length() - 6)
    starts = np.searchsorted(_upper(keys, bits) if bits else keys * _U8(0), np.arange((1 << bits) + 1, dtype=_U8))
    return {name: (keys << _U8(bits) >> _U8(32)).astype("<u4"), f"{name}_at": starts.astype("<i8")}


def _find(arrays: dict[str, np.ndarray], name: str, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of every key in a table, and whether it is there; by bisection inside its prefix."""
    own, starts = arrays.get(name), arrays.get(f"{name}_at")
    if own is None or not len(own):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    bits = (len(starts) - 1).bit_length() - 1
    prefix = (_upper(keys, bits) if bits else keys * _U8(0)).astype(np.int64)
    low, end, want = starts[prefix], starts[prefix + 1], (keys << _U8(bits) >> _U8(32)).astype(np.uint32)
    high = end.copy()
    for _ in range(int((high - low).max(initial=0)).bit_length()):
        mid = (low + high) >> 1
        less = (own[np.minimum(mid, len(own) - 1)] < want) & (mid < high)
        low, high = np.where(less, mid + 1, low), np.where(less, high, mid)
    return np.minimum(low, len(own) - 1), (low < end) & (own[np.minimum(low, len(own) - 1)] == want)


def _numbers(name: str, x: np.ndarray) -> dict[str, np.ndarray]:
    """Numbers in a byte each, and those over 254 beside."""
    large = np.flatnonzero(x > 254)
    return {name: np.minimum(x, 255).astype("<u1"), f"{name}_large": large.astype("<i8"), f"{name}_many": x[large].astype("<i8")}


def _number(arrays: dict[str, np.ndarray], name: str, at: np.ndarray, there: np.ndarray) -> np.ndarray:
    if not there.any():
        return np.zeros(len(at), np.int64)
    n = np.where(there, arrays[name][at], 0).astype(np.int64)
    big = np.flatnonzero(n == 255)
    if len(big):
        n[big] = arrays[f"{name}_many"][np.searchsorted(arrays[f"{name}_large"], at[big])]
    return n


def _table(name: str, keys: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """Sorted keys with their counts; those of 1, most of them, as keys only."""
    more = n > 1
    return {**_keys(f"{name}_once", keys[~more]), **_keys(f"{name}_more", keys[more]), **_numbers(f"{name}_n", n[more])}


def _counts(arrays: dict[str, np.ndarray], name: str, keys: np.ndarray) -> np.ndarray:
    at, there = _find(arrays, f"{name}_more", keys)
    return _number(arrays, f"{name}_n", at, there) + (_find(arrays, f"{name}_once", keys)[1] & ~there)


def _levels(n: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3 and 4, how many are 3 or more, and how many there are."""
    c = np.bincount(np.minimum(n, 5), minlength=6)
    return [*c[1:5], c[3:].sum(), c[1:].sum()]


def _kinds(n: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Per group: sum of the counts, and how many are 1, 2 and more."""
    return [np.add.reduceat(x, first) if len(first) else n[:0] for x in (n, (n == 1) * 1, (n == 2) * 1, (n > 2) * 1)]


def _deal(out: list, kind: int, shards: int, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> None:
    """Rows of (a, w, n) as chunks by the shard of w (its upper 40 bits)."""
    home = (b % _U8(shards)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    edges = np.searchsorted(home[order], np.arange(shards + 1))
    for k in np.flatnonzero(np.diff(edges)).tolist():
        x = order[edges[k] : edges[k + 1]]
        out.append((k, kind, a[x].astype("<u2").tobytes() if len(a) else b"", b[x].tobytes(), _small(n[x])))


def _shard(root: str, shards: int, frequent: np.ndarray):
    """A shard's chunks -> its arrays as a file; statistics, and what it knows of the tokens w in chunks by their shard."""

    def run(table: pa.Table) -> pa.Table:
        shard = table["bucket"][0].as_py()
        parts = []
        for vs, per_v, us, per_u, ws, low, n in zip(*(table[c] for c in ("v", "per_v", "u", "per_u", "w", "low", "n")), strict=True):
            v, u, w = (np.frombuffer(x.as_buffer(), t) for x, t in ((vs, "<u8"), (us, "<u4"), (ws, "<u4")))
            per_u, per_v = _wide(per_u.as_py(), len(u)), _wide(per_v.as_py(), len(v))
            w = w.astype(_U8) << _U8(8) | np.frombuffer(low.as_buffer(), "<u1")
            parts.append((np.repeat(np.repeat(v, per_v), per_u), np.repeat(u, per_u), w, _wide(n.as_py(), len(w))))
        v, u, w, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        key = _pair(_pair(v, u.astype(_U8), 1), w, 2)
        order, first = grouped(key)
        n = np.add.reduceat(n[order], first)
        at = order[first]
        key, v, u, w = key[at], v[at], u[at], w[at]
        arrays, out = _table("three", key, n), []
        stats = _levels(n)
        del key
        order, first = grouped(own := _pair(v, u.astype(_U8), 1))
        own, sums = own[order[first]], _kinds(n[order], first)
        # A history that occurs once has one successor, once; it is known as a bigram.
        keep = (sums[0] > 1) | (v[order[first]] == BEGIN) & (u[order[first]] == _upper(BEGIN, 32))
        arrays |= _keys("history", own[keep])
        for name, x in zip(("h_total", "h1", "h2", "h3"), sums, strict=True):
            arrays |= _numbers(name, x[keep])
        del own, u
        order, first = grouped(v)
        token, count = v[order[first]], np.add.reduceat(n[order], first)
        order, first = grouped(two := _pair(v, w, 2))
        kinds = np.diff(np.r_[first, len(order)])
        at = order[first]
        two, v, w = two[at], v[at], w[at]
        common = np.isin(v, frequent)
        # Frequent tokens: their bigrams and counts are summed elsewhere.
        _deal(out, PAIRS, shards, np.searchsorted(frequent, v[common]), w[common], kinds[common])
        mine = np.isin(token, frequent)
        out.append((-1, FREQ, (np.searchsorted(frequent, token[mine]) + 14).astype("<i8").tobytes(), count[mine].astype("<i8").tobytes(), b""))
        token, count = token[~mine], count[~mine]
        two, v, w, kinds = two[~common], v[~common], w[~common], kinds[~common]
        arrays |= _table("two", two, kinds)
        order, first = grouped(v)
        arrays |= {"token": token, **_numbers("count", count)}
        for name, x in zip(("c_total", "c1", "c2", "c3"), _kinds(kinds[order], first), strict=True):
            arrays |= _numbers(name, x)
        w, before = counted(w)
        _deal(out, WORDS, shards, before[:0], w, before)
        stats += [*_levels(kinds), len(token), count.sum()]
        out.append((-1, STATS, *_placed(np.array(stats, np.int64)), b""))
        _save(f"{root}/{shard}", arrays)
        return pa.Table.from_batches([_batch(out, PARTS)])

    return run


def _words(root: str, shards: int, frequent: np.ndarray):
    """What all shards know of a shard's tokens w -> how many tokens stand before each, the bigrams of frequent tokens, and statistics."""

    def run(table: pa.Table) -> pa.Table:
        shard = table["bucket"][0].as_py()
        rows: dict[int, list] = {WORDS: [], PAIRS: []}
        for kind, a, b, n in zip(*(table[c].to_pylist() for c in ("kind", "a", "b", "n")), strict=True):
            b = np.frombuffer(b, "<u8")
            rows[kind].append((np.frombuffer(a, "<u2").astype(_U8) if kind == PAIRS else b[:0], b, _wide(n, len(b))))
        none = np.zeros(0, _U8)
        a, b, n = (np.concatenate(x) for x in zip((none, none, none.astype(np.int64)), *rows[PAIRS], strict=True))
        order, first = grouped(_pair(frequent[a.astype(np.int64)], b, 2))
        kinds = np.add.reduceat(n[order], first) if len(first) else n
        at = order[first]
        a, b = a[at], b[at]
        arrays = _table("two", _pair(frequent[a.astype(np.int64)], b, 2), kinds)
        sums = np.zeros((5, len(frequent)), "<i8")
        for k, x in enumerate((kinds, kinds == 1, kinds == 2, kinds > 2)):
            np.add.at(sums[k], a.astype(np.int64), x)
        _, w, m = (np.concatenate(x) for x in zip((none, none, none.astype(np.int64)), *rows[WORDS], (none, b, np.ones(len(b), np.int64)), strict=True))
        order, first = grouped(w)
        before = np.add.reduceat(m[order], first) if len(first) else m
        arrays |= {"word": w[order[first]], **_numbers("before", before)}
        _save(f"{root}/w{shard}", arrays)
        stats = np.array([*_levels(kinds), *_levels(before)], "<i8")
        return pa.Table.from_batches([_batch([(-1, STATS, *_placed(np.concatenate([stats, sums.ravel()])), b"")], PARTS)])

    return run


def discounts(n: np.ndarray) -> list[float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and more, from the numbers of n-grams counted 1 to 4 times."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    found = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.05), k - 0.05) for k, d in enumerate(found, 1)]


def _less(n: np.ndarray, d: list[float]) -> np.ndarray:
    """Counts less their discounts."""
    return n - np.array([0.0, *d])[np.minimum(n, 3)]


@dataclass
class Model:
    """Where the arrays are, and the numbers of the whole corpus; per frequent token its count and the kinds of its bigrams."""

    root: str
    shards: int
    frequent: np.ndarray
    often: np.ndarray
    sums: np.ndarray
    tokens: int
    types: int
    bigrams: int
    ends: int
    three: list
    two: list
    one: list
    rest: float

    def _by_shard(self, home: np.ndarray, prefix: str = ""):
        order = np.argsort(home, kind="stable")
        edges = np.searchsorted(home[order], np.arange(self.shards + 1))
        for k in np.flatnonzero(np.diff(edges)).tolist():
            yield order[edges[k] : edges[k + 1]], mapped(f"{self.root}/{prefix}{k}")

    def lookup(self, w: np.ndarray, v: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Training count and model probability of every token after the two before it."""
        unit, turn = np.unique(np.r_[w, v], return_inverse=True)
        count, before, sums = np.zeros(len(unit), np.int64), np.zeros(len(unit), np.int64), np.zeros((4, len(unit)), np.int64)
        for at, arrays in self._by_shard((_upper(unit, 40) % _U8(self.shards)).astype(np.int64)):
            if len(known := arrays.get("token", unit[:0])):
                i = np.minimum(np.searchsorted(known, unit[at]), len(known) - 1)
                there = known[i] == unit[at]
                count[at] = _number(arrays, "count", i, there)
                for k, name in enumerate(("c_total", "c1", "c2", "c3")):
                    sums[k, at] = _number(arrays, name, i, there)
        for at, arrays in self._by_shard((_upper(unit, 40) % _U8(self.shards)).astype(np.int64), "w"):
            if len(known := arrays.get("word", unit[:0])):
                i = np.minimum(np.searchsorted(known, _upper(unit[at], 40)), len(known) - 1)
                before[at] = _number(arrays, "before", i, known[i] == _upper(unit[at], 40))
        i = np.minimum(np.searchsorted(self.frequent, unit), len(self.frequent) - 1)
        at = np.flatnonzero(self.frequent[i] == unit)
        count[at], sums[:, at] = self.often[i[at]], self.sums[:4, i[at]]
        count[unit == END], count[unit == BEGIN] = self.ends, 0
        n = len(w)
        one = _less(before[turn[:n]], self.one) / max(self.bigrams, 1) + self.rest / (self.types + 1)

        # Bigrams: in the shard of v, or in that of w for a frequent v.
        key, back = np.unique(bigrams(v, w), return_inverse=True)
        some = np.zeros(len(key), np.int64)
        some[back] = np.arange(n)
        kinds = np.zeros(len(key), np.int64)
        common = np.isin(v[some], self.frequent)
        home = homes(v[some], self.shards, self.frequent, _upper(w[some], 40))
        for part, prefix in ((np.flatnonzero(~common), ""), (np.flatnonzero(common), "w")):
            for at, arrays in self._by_shard(home[part], prefix):
                kinds[part[at]] = _counts(arrays, "two", key[part[at]])
        kinds = kinds[back]
        own = sums[:, turn[n:]]
        two = np.where(own[0] > 0, (_less(kinds, self.two) + (self.two @ own[1:]) * one) / np.maximum(own[0], 1), one)

        # Histories: one that is no entry but was a bigram just before occurred once.
        key, back = np.unique(histories(u, v), return_inverse=True)
        some = np.zeros(len(key), np.int64)
        some[back] = np.arange(n)
        stats = np.zeros((4, len(key)), np.int64)
        home = homes(v[some], self.shards, self.frequent, key)
        for at, arrays in self._by_shard(home):
            i, there = _find(arrays, "history", key[at])
            for k, name in enumerate(("h_total", "h1", "h2", "h3")):
                stats[k, at] = _number(arrays, name, i, there)
        stats = stats[:, back]
        once = np.r_[False, kinds[:-1] > 0] & (v != BEGIN) & (stats[0] == 0)
        stats[:2, once] = 1

        key, turn = np.unique(_pair(histories(u, v), _upper(w, 40), 2), return_inverse=True)
        some = np.zeros(len(key), np.int64)
        some[turn] = np.arange(n)
        seen = np.zeros(len(key), np.int64)
        for at, arrays in self._by_shard(home[back[some]]):
            seen[at] = _counts(arrays, "three", key[at])
        three = np.where(stats[0] > 0, (_less(seen[turn], self.three) + (self.three @ stats[1:]) * two) / np.maximum(stats[0], 1), two)
        return count[np.searchsorted(unit, w)], three


def _often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> (token, n), and the number of all tokens as token 0; tokens that are rare in the task are left out."""
    held, total = [], 0
    for batch in batches:
        for part in steps(batch, most=STEP):
            held.append(counted(tokens(part.column(0))[1]))
            total += int(held[-1][1].sum())
    keys, n = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, _U8), np.zeros(0, np.int64))
    order, first = grouped(keys)
    n = np.add.reduceat(n[order], first) if len(first) else n
    top = np.sort(np.argsort(-n, kind="stable")[: 4 * FREQUENT])
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[_U8(0), keys[order[first]][top]].astype(_U8).view(np.int64)), pa.array(np.r_[total, n[top]].astype(np.int64))], names=["token", "n"])


def _frequent(plain: DataFrame, shards: int) -> np.ndarray:
    """Tokens that would fill a good part of a shard, found in a sample: it decides where counts are summed, never what they are."""
    found = plain.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0).mapInArrow(_often, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    rows = found.orderBy(F.col("token") != 0, F.desc("n"), "token").limit(FREQUENT + 1).collect()
    total = sum(r.n for r in rows if r.token == 0)
    often = [r.token & (1 << 64) - 1 for r in rows if r.token != 0 and r.n * shards > SHARE * total and r.n > 100]
    return np.unique(np.array([*often, int(BEGIN)], _U8))


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(at, n: arrays as bytes) -> the sums by place of all rows of the task, as rows slot, n."""
    total = np.zeros(0, np.int64)
    for batch in batches:
        for at, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            at, n = np.frombuffer(at, "<i8"), np.frombuffer(n, "<i8")
            if len(at) and at.max() >= len(total):
                total = np.concatenate([total, np.zeros(int(at.max()) + 1 - len(total), np.int64)])
            np.add.at(total, at, n)
    slot = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(total[slot])], names=["slot", "n"])


def summed(arrays: DataFrame, size: int) -> np.ndarray:
    """(at, n: places below ``size`` and numbers, as bytes) -> their sums. Spark adds them up, so the driver gets ``size`` rows at most."""
    out = np.zeros(size, np.int64)
    for r in arrays.mapInArrow(_slots, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        out[r.slot] = r.n
    return out


def _placed(n: np.ndarray, first: int = 0) -> tuple[bytes, bytes]:
    """Places and numbers of what is not zero, as bytes."""
    at = np.flatnonzero(n)
    return (at + first).astype("<i8").tobytes(), n[at].astype("<i8").tobytes()


def train(docs: DataFrame, shards: int | None = None) -> Model:
    """(text) -> model. Counts of all rows; null texts count as empty.

    Every task counts its trigrams and deals them out by their middle token (frequent ones by the two first);
    a shard sums them, writes its sorted arrays to the shared folder and deals out what it knows of the
    last tokens. Arrays per shard are a part of the distinct trigrams. Statistics, and sums of the frequent tokens, are
    added up in Spark: a few thousand numbers reach the driver, however many shards (two a partition, 20,000 at most) there are.
    """
    scratch = Scratch(docs.sparkSession, "kneserney")
    root = scratch.path("arrays")
    if root.startswith(("/", "file:/")) and "://" not in root:
        root = "file://" + root.removeprefix("file:")
    plain = docs.select(F.col("text").cast("string").alias("text"))
    shards = shards or max(8, min(20_000, 2 * plain.rdd.getNumPartitions()))
    frequent = _frequent(plain, shards)
    counted_ = plain.mapInArrow(_count(shards, frequent), CHUNKS)
    parts = scratch.save(counted_.groupBy("bucket").applyInArrow(_shard(root, shards, frequent), PARTS), "parts")
    known = summed(parts.filter("bucket = -1").select("a", "b"), 14 + len(frequent))
    stats, often = known[:14], known[14:]
    done = scratch.save(parts.filter("bucket >= 0").groupBy("bucket").applyInArrow(_words(root, shards, frequent), PARTS), "done")
    more = summed(done.select("a", "b"), 12 + 5 * len(frequent))
    scratch.drop("parts", "done")
    levels, sums = more[:12], more[12:].reshape(5, -1)
    two = stats[6:12] + levels[:6]
    ends = int(often[np.searchsorted(frequent, BEGIN)])
    types = int(stats[12] + (often > 0).sum())  # the begin stands for the end here
    one = discounts(levels[6:10])
    rest = (one[0] * levels[6] + one[1] * levels[7] + one[2] * levels[10]) / two[5] if two[5] else 1.0
    return Model(root, shards, frequent, often, sums, int(stats[13] + often.sum()), types, int(two[5]), ends, discounts(stats[:4]), discounts(two[:4]), one, float(rest))


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = model.tokens + 0.1 * (model.types + 1)
        for batch in batches:
            for part in steps(batch, most=STEP):
                *grams, rows = tokens(part.column(1))
                count, p = model.lookup(*grams)
                n = part.num_rows
                sums = [np.bincount(rows, w, n) for w in (None, count > 0, np.log10((count + 0.1) / floor), np.log10(p))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(s.astype(np.int64)) for s in sums[:2]), pa.array(np.full(n, model.tokens)), *(pa.array(s) for s in sums[2:])],
                    names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text) -> doc_id, n_tokens, n_known, train_tokens, base_score, score, one row per input row.

    Tokens are words, with A-Z lower-cased, and one end. ``base_score`` is the add-0.1 unigram log10
    probability, ``score`` the model's; perplexity is 10 ** (-score / n_tokens). Null and empty texts
    are the end alone. Null and repeated doc_ids stay row by row.
    """
    plain = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(_score(model), f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_held_out(docs: DataFrame, folds: int = 10) -> DataFrame:
    """Scores of all rows by a model of those whose crc32(doc_id as text) mod ``folds`` is not 0; null ids are scored only."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    out = score(docs, train(docs.filter(fold != 0)))
    return out.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")

"""Benchmark decontamination: latent semantic candidates, then longest common subsequences and answer checks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Scratch, flat, hashes, steps, tree_sum, word_bounds

#: Words of a block; a passage is two blocks, and every block starts one.
BLOCK = 32
#: Items of a group at most. Each group has its own latent space, of at most twice as many dimensions, in which all its items lie.
RANK = 256
#: Terms of the groups that one pass over the texts takes together; a group with more has a pass of its own.
PASS_TERMS = 32_768
#: Terms in more than this share of the passages are left out, but for the rarest ``TERMS`` of every item.
COMMON, TERMS = 0.003, 8
#: Least latent cosine of a candidate, least common subsequence of a leak as a share of the item, and of one whose answer is found.
COSINE, LEAK, LEAK_WITH_ANSWER, ANSWER = 0.5, 0.6, 0.45, 0.8
#: A passage is also a candidate if its part along an item's vector is this share of that vector, whatever else it holds.
HELD = 0.5
#: Share of an item's words, at its end, that count as its answer.
ANSWER_SHARE = 0.25
#: Words of all items at most: they are broadcast.
MOST_WORDS = 4_000_000

_ALNUM = np.ones(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of letters and digits (A-Z lower-cased, all bytes above 127 are letters)."""
    data, offsets = flat(column)
    starts, ends, rows = word_bounds(data, offsets, _ALNUM)
    return hashes(LOWER[data], starts, ends), rows


def common_subsequence(item: dict[int, int], size: int, window: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel: ``item`` maps a word to the bits of its places."""
    full = (1 << size) - 1
    v = full
    for m in map(item.get, window.tolist()):
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def _masks(item: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        out[w] = out.get(w, 0) | 1 << i
    return out


@dataclass
class Index:
    """What the workers get of a group: terms and their weights, the latent basis, and the items with their vectors' lengths."""

    terms: np.ndarray
    idf: np.ndarray
    items: list
    ids: list
    basis: np.ndarray | None = None
    vectors: np.ndarray | None = None
    lengths: np.ndarray | None = None

    def lookup(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and term numbers of the tokens that are terms, by a direct-address table of hash bits."""
        if not hasattr(self, "_slots"):
            slots = np.full(1 << 20, -1, np.int32)
            at = (self.terms >> np.uint64(44)).astype(np.int64)
            slots[at[::-1]] = np.arange(len(at), dtype=np.int32)[::-1]
            self._slots, self._rest = slots, np.flatnonzero(slots[at] != np.arange(len(at)))
            self._shared = np.zeros(1 << 20, bool)
            self._shared[at[self._rest]] = True
        at = (tokens >> np.uint64(44)).astype(np.int64)
        slot = self._slots[at]
        place = np.flatnonzero(slot >= 0)
        term = slot[place]
        same = self.terms[term] == tokens[place]
        place, term = place[same], term[same].astype(np.int64)
        if len(self._rest):  # terms whose slot another term holds
            more = np.flatnonzero(self._shared[at])
            k = self._rest[np.minimum(np.searchsorted(self.terms[self._rest], tokens[more]), len(self._rest) - 1)]
            same = self.terms[k] == tokens[more]
            place, term = np.concatenate([place, more[same]]), np.concatenate([term, k[same]])
            order = np.argsort(place, kind="stable")
            place, term = place[order], term[order]
        return place, term

    def sums(self, term: np.ndarray, block: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Blocks that hold terms, and the sums of their terms' rows of ``table``; ``block`` must be sorted."""
        first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        out = np.empty((len(first), table.shape[1]), table.dtype)
        for i in range(0, len(first), 2048):
            end = first[i + 2048] if i + 2048 < len(first) else len(block)
            out[i : i + 2048] = np.add.reduceat(table[term[first[i] : end]], first[i : i + 2048] - first[i], axis=0)
        return block[first], out


def places(tokens: np.ndarray, rows: np.ndarray, index: Index):
    """Term and block of every token that is a term; first token, row and end of the row of each block. Blocks never cross rows."""
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, np.int64)
    counts = np.diff(np.r_[first, len(rows)])
    blocks = -(-counts // BLOCK)
    base = np.cumsum(blocks) - blocks
    hit, term = index.lookup(tokens)
    owner = np.searchsorted(first, hit, "right") - 1
    block = base[owner] + (hit - first[owner]) // BLOCK
    start = np.repeat(first, blocks) + (np.arange(blocks.sum()) - np.repeat(base, blocks)) * BLOCK
    return term, block, start, np.repeat(rows[first], blocks), np.repeat(first + counts, blocks)


def passages(block: np.ndarray, sums: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First blocks and vectors of the passages (a block and the next one of its row) that hold terms."""
    before = block[(block > 0) & (rows[block] == rows[np.maximum(block - 1, 0)])] - 1
    live = np.union1d(block, before)
    out = np.zeros((len(live), sums.shape[1]), sums.dtype)
    out[np.searchsorted(live, block)] = sums
    second = np.searchsorted(live, before)
    out[second] += sums[np.searchsorted(block, before + 1)]
    return live, out


def _frequencies(terms):
    """(text) -> (term, number of blocks that hold it); term -1 counts the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = terms.value
        total, blocks = np.zeros(len(known.terms), np.int64), 0
        for batch in batches:
            for part in steps(batch):
                term, block, start, _, _ = places(*words(part.column(0)), known)
                pairs = np.sort(block * len(total) + term)
                total += np.bincount(pairs[np.r_[True, pairs[1:] != pairs[:-1]]] % len(total) if len(pairs) else pairs, minlength=len(total))
                blocks += len(start)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at]), pa.array(np.r_[blocks, total[at]])], names=["term", "n"])

    return run


_PART = 256


def _parts(groups: list[Index]) -> np.ndarray:
    """Number of the first part of each group, and of all parts."""
    return np.cumsum([0, *(-(-len(x.terms) // _PART) for x in groups)])


def _sketch(groups, omegas):
    """(text) -> the task's part of C Omega for C = A'A over its passages, of each group in parts of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [(omega * x.idf[:, None]).astype(np.float32) for x, omega in zip(groups.value, omegas.value, strict=True)]
        totals = [np.zeros((-(-len(w) // _PART) * _PART, w.shape[1])) for w in tables]
        for batch in batches:
            for part in steps(batch):
                tokens, token_rows = words(part.column(0))
                for x, w, total in zip(groups.value, tables, totals, strict=True):
                    term, block, _, rows, _ = places(tokens, token_rows, x)
                    if not len(term):
                        continue
                    held, sums = x.sums(term, block, w)
                    live, y = passages(held, sums, rows)
                    # A token stands in the passage of its block and in that of the block before.
                    own = y[np.searchsorted(live, held)]
                    inner = np.flatnonzero((held > 0) & (rows[held] == rows[np.maximum(held - 1, 0)]))
                    own[inner] += y[np.searchsorted(live, held[inner] - 1)]
                    order = np.argsort(term, kind="stable")
                    t, at = term[order], np.searchsorted(held, block[order])
                    first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
                    for i in range(0, len(first), 256):
                        end = first[i + 256] if i + 256 < len(first) else len(t)
                        k = first[i : i + 256]
                        total[t[k]] += np.add.reduceat(own[at[k[0] : end]], k - k[0], axis=0) * x.idf[t[k], None]
        for base, total in zip(_parts(groups.value), totals, strict=False):
            parts = total.reshape(-1, _PART * total.shape[1]).astype("<f8")
            keep = np.flatnonzero(parts.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(base + keep), pa.array([parts[k].tobytes() for k in keep], pa.binary())], names=["part", "body"])

    return run


def _add(table: pa.Table) -> pa.Table:
    return pa.table({"part": table["part"].slice(0, 1), "body": pa.array([np.sum([np.frombuffer(b.as_buffer(), "<f8") for b in table["body"]], axis=0).tobytes()], pa.binary())})


def _search(groups):
    """(doc_id, text) -> (doc_id, item, cosine, subsequence, answer) of the best passage of each leaked item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = []
        for x in groups.value:
            answers = [t[-max(1, round(len(t) * ANSWER_SHARE)) :] for t in x.items]
            known.append((x, [_masks(t) for t in x.items], answers, [_masks(a) for a in answers]))
        for batch in batches:
            for part in steps(batch):
                tokens, token_rows = words(part.column(1))
                for x, masks, answers, answer_masks in known:
                    term, block, start, rows, stop = places(tokens, token_rows, x)
                    best: dict[tuple[int, int], tuple] = {}
                    if len(term):
                        live, z = passages(*x.sums(term, block, x.basis), rows)
                        norm = np.linalg.norm(z, axis=1)
                        for i in range(0, len(live), 2048):
                            along = z[i : i + 2048] @ x.vectors
                            cos = along / np.maximum(norm[i : i + 2048, None], 1e-30)
                            for p, k in zip(*np.nonzero((cos >= COSINE) | (along >= HELD * x.lengths)), strict=True):
                                at = live[i + p]
                                # The window reaches as far as an item of that length can that lies in the passage by half.
                                reach = len(x.items[k])
                                a = max(start[at] - reach, int(np.searchsorted(token_rows, rows[at])))
                                window = tokens[a : min(start[at] + 2 * BLOCK + reach, stop[at])]
                                size = len(x.items[k])
                                found = common_subsequence(masks[k], size, window) / size
                                if found < LEAK_WITH_ANSWER:
                                    continue
                                found = max(common_subsequence(masks[k], size, window[s : s + size + size // 2]) for s in range(0, max(1, len(window) - size // 2), max(1, size // 4))) / size
                                answer = common_subsequence(answer_masks[k], len(answers[k]), window) / len(answers[k])
                                if found >= LEAK or (found >= LEAK_WITH_ANSWER and answer >= ANSWER):
                                    key = (int(rows[at]), int(k))
                                    best[key] = max(best.get(key, (0.0,)), (found, float(cos[p, k]), answer))
                    keys = sorted(best)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array([r for r, _ in keys], pa.int64())), pa.array([x.ids[k] for _, k in keys], pa.int64()), *(pa.array([best[k][j] for k in keys], pa.float64()) for j in (1, 0, 2))],
                        names=["doc_id", "item_id", "cosine", "subsequence", "answer"],
                    )

    return run


def _groups(docs: DataFrame, benchmark: DataFrame, rank: int) -> list[Index]:
    """The items in groups of at most ``rank`` and of like size, with the terms of each group and their weights."""
    spark = docs.sparkSession
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null").distinct()
    n_words = rows.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    if n_words > MOST_WORDS:
        raise ValueError(f"the benchmark has {n_words} words; at most {MOST_WORDS} are broadcast, so give it in parts")
    rows = rows.orderBy("item_id", "text").collect()
    tokens, owner = words(pa.array([r.text for r in rows], pa.string()))
    items = np.split(tokens, np.searchsorted(owner, np.arange(1, len(rows))))
    kept = [k for k, t in enumerate(items) if len(t)]
    if not kept:
        return []
    # Document frequencies of the benchmark's words over all passages.
    terms = np.unique(tokens)
    every = spark.sparkContext.broadcast(Index(terms, np.zeros(0), [], []))
    found = docs.select("text").mapInArrow(_frequencies(every), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df, total = np.zeros(len(terms)), 1
    for r in found:
        if r.term < 0:
            total += r.n
        else:
            df[r.term] = r.n
    out = []
    for part in np.array_split(kept, -(-len(kept) // rank)):
        at = [np.unique(np.searchsorted(terms, items[k])) for k in part]
        keep = np.unique(np.concatenate(at))
        keep = keep[df[keep] <= COMMON * total]
        keep = np.unique(np.concatenate([keep, *(t[np.argsort(df[t], kind="stable")[:TERMS]] for t in at)]))
        out.append(Index(terms[keep], np.log((1 + total) / (1 + df[keep])), [items[k] for k in part], [rows[k].item_id for k in part]))
    return out


def _fit(docs: DataFrame, groups: list[Index]) -> None:
    """Gives every group its latent basis and the vectors of its items, by one pass over the texts."""
    spark = docs.sparkSession
    tables, omegas = [], []
    # Randomised range finder for C = A'A over the passages and the items, from the items.
    for index in groups:
        x = np.zeros((len(index.items), len(index.terms)))
        for k, t in enumerate(index.items):
            i = np.minimum(np.searchsorted(index.terms, t), len(index.terms) - 1)
            i = i[index.terms[i] == t]
            np.add.at(x[k], i, index.idf[i])
        # More items than terms: as many mixtures span what they do.
        omega = x.T if len(x) <= len(index.terms) else x.T @ np.random.default_rng(5).standard_normal((len(x), len(index.terms)))
        tables.append(x)
        omegas.append(np.linalg.qr(omega)[0])
    shared = spark.sparkContext.broadcast(groups), spark.sparkContext.broadcast(omegas)
    sketched = docs.select("text").mapInArrow(_sketch(*shared), "part long, body binary")
    parts = tree_sum(sketched, "part", _add, "part long, body binary").collect()
    bases = _parts(groups)
    ys = [np.zeros((-(-len(w) // _PART) * _PART, w.shape[1])) for w in omegas]
    for r in parts:
        g = int(np.searchsorted(bases, r.part, "right")) - 1
        ys[g].reshape(-1, _PART * ys[g].shape[1])[r.part - bases[g]] = np.frombuffer(bytes(r.body), "<f8")
    for b in shared:
        b.destroy()
    for index, x, omega, y in zip(groups, tables, omegas, ys, strict=True):
        y = y[: len(index.terms)] + x.T @ (x @ omega)
        # One pass: C is about Q B Q' with B from B (Q' Omega) = Q' Y; its eigenvectors are the right singular vectors of A.
        q = np.linalg.qr(np.c_[y, omega])[0]
        b = np.linalg.lstsq((q.T @ omega).T, (q.T @ y).T, rcond=None)[0].T
        value, vector = np.linalg.eigh((b + b.T) / 2)
        index.basis = q @ vector[:, ::-1]
        z = x @ index.basis
        lengths = np.maximum(np.linalg.norm(z, axis=1), 1e-300)
        index.vectors = np.ascontiguousarray((z / lengths[:, None]).T, np.float32)
        index.lengths = lengths.astype(np.float32)
        index.basis = (index.basis * index.idf[:, None]).astype(np.float32)  # what a worker sums per token


def _passes(groups: list[Index]) -> Iterator[list[Index]]:
    """The groups that one pass takes together."""
    taken: list[Index] = []
    for x in groups:
        if taken and sum(len(y.terms) for y in taken) + len(x.terms) > PASS_TERMS:
            yield taken
            taken = []
        taken.append(x)
    yield taken


def leaks(docs: DataFrame, benchmark: DataFrame, rank: int = RANK) -> DataFrame:
    """(doc_id, text), (item_id, text) -> one row per document and item that it leaks: doc_id, item_id, cosine, subsequence, answer.

    Passages of 64 words, one every 32, are weighted by TF-IDF over the benchmark's rarer words, with
    frequencies of all passages. The items go in groups of at most ``rank``. A randomised SVD of a
    group's matrix, by a distributed pass over the texts that groups of ``PASS_TERMS`` terms share, gives a
    latent space that holds the group's items; passages whose cosine with an item is at least ``COSINE``,
    or whose part along it is ``HELD`` of it, are candidates. So an item of up to 97 words that stands
    verbatim in a text always is: two passages hold it, and one of them half of it. A candidate is a
    leak if the longest common subsequence of item and passage is ``LEAK`` of the item, or
    ``LEAK_WITH_ANSWER`` if also ``ANSWER`` of its last quarter is found. Words are runs of letters and digits.

    Null, empty and wordless texts and items match nothing; an empty benchmark gives no rows. Repeated rows
    of a document or item give their leaks once. Other columns are ignored.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    groups = _groups(plain, benchmark, rank)
    schema = "doc_id long, item_id long, cosine double, subsequence double, answer double"
    if not groups:
        return spark.createDataFrame([], schema)
    found, scratch, passes = None, Scratch(spark, "leaks"), list(_passes(groups))
    for n, taken in enumerate(passes):
        _fit(plain, taken)
        shared = spark.sparkContext.broadcast(taken)
        part = plain.mapInArrow(_search(shared), schema)
        if len(passes) > 1:  # the memory of a pass is free before the next one
            part = scratch.save(part, f"pass{n}")
            shared.destroy()
            for x in taken:
                x.basis = x.vectors = None
        found = part if found is None else found.unionByName(part)
    return found.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("cosine", "subsequence", "answer")))

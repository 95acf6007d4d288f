"""Repeated substrings of documents by a logarithmic family of sparse suffix arrays.

Suffixes are ordered by their first 64 bytes. Those that share all of them are told apart by the bytes around: a
BLAKE2b digest of 128 bits says whether all windows of two sampled places are equal, and windows that differ
in part are compared byte by byte. Plain hashes only choose what is sampled and where it goes.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, STEP_BYTES, Scratch, flat, mixed, powers, release, steps

#: Bytes of a repeated string, and of the string by which a suffix is sampled.
LENGTH, GRAM = 200, 64
#: Distinct contexts of one sampled suffix from which its windows are dealt out one by one.
HOT = 4096
#: Bytes of text for each bucket of suffixes, and bytes of suffixes that a task holds before it deals them out.
BUCKET_BYTES, HELD_BYTES = 8 << 20, 32 << 20
#: Row ids (digests of doc_id and text) are broadcast up to this count (16 bytes each) and joined by shuffle beyond it.
BROADCAST_IDS = 500_000
_POS = np.uint64((1 << 32) - 1)
_U8 = np.uint64


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` bytes, doubling the length of the hashed runs."""
    step, n = mixed(data.astype(_U8) + _U8(1)), 1
    found, done = None, 0
    while True:
        if size & n:
            if found is None:
                found, done = step, n
            else:
                keep = max(0, min(len(found), len(step) - done))
                found = found[:keep] * _U8(pow(BASE, n, 1 << 64)) + step[done : done + keep]
                done += n
        if 2 * n > size:
            return mixed(found[: max(0, len(data) - size + 1)])
        step = step[: max(0, len(step) - n)] * _U8(pow(BASE, n, 1 << 64)) + step[n:]
        n *= 2


def sampled(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Sampled suffixes: row, position, first and last window start they stand for, and the hash of their ``gram`` bytes.

    Of the runs of ``gram`` bytes in a window of ``length`` bytes the one with the least hash is
    sampled (the leftmost of equals), so equal windows sample equal runs at equal places. The
    context is all bytes of the windows that sample one position.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none.view(_U8)
    keys = gram_hashes(data, gram)
    wide = length - gram + 1
    least, span = (keys & ~_POS) | np.arange(len(keys), dtype=_U8), 1
    while span * 2 <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < wide:
        least = np.minimum(least[: len(least) - (wide - span)], least[wide - span :])
    starts = np.arange(len(data) - length + 1)
    rows = np.searchsorted(offsets, starts, "right") - 1
    inside = starts + length <= offsets[rows + 1]
    starts, rows = starts[inside], rows[inside]
    if not len(starts):
        return none, none, none, none, none.view(_U8)
    at = (least[starts] & _POS).astype(np.int64)
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)])
    last = np.r_[first[1:], len(at)] - 1
    a, b, at = starts[first], starts[last], at[first]
    return rows[first], at, a, b, keys[at]


def suffixes(data: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Per sampled suffix its first ``gram`` bytes and the digest of its context (with its place in it)."""
    raw, out = data.tobytes(), np.empty((len(at), gram + 16), np.uint8)
    out[:, :gram] = np.lib.stride_tricks.sliding_window_view(data, gram)[at] if len(at) else 0
    digests = (blake2b(raw[i : j + length], digest_size=16, salt=(k - i).to_bytes(8, "little")).digest() for k, i, j in zip(at.tolist(), a.tolist(), b.tolist(), strict=True))
    out[:, gram:] = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 16)
    return out.reshape(-1).view(f"S{gram + 16}")


def _first(entries: np.ndarray) -> np.ndarray:
    """The bytes by which suffixes are ordered, without the digest."""
    x = np.ascontiguousarray(entries["suffix"])
    size = x.dtype.itemsize
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, size)[:, : size - 16]).reshape(-1).view(f"S{size - 16}")


class Family:
    """Suffix arrays whose sizes double: a new one is scanned against every level for suffixes that share their first bytes, then equal levels merge.

    An entry is one distinct context of a suffix; ``many`` tells that it occurs more than once and
    ``ref`` is one occurrence of it.
    """

    def __init__(self):
        self.levels: list[np.ndarray] = []

    @staticmethod
    def sort(run: np.ndarray) -> np.ndarray:
        return run[np.argsort(run["suffix"], kind="stable")]

    @staticmethod
    def merge(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both arrays as one, equal contexts joined; and the entries that this made repeated."""
        both = Family.sort(np.concatenate([x, y]))
        if not len(both):
            return both, both
        same = both["suffix"][1:] == both["suffix"][:-1]
        twin = np.r_[same, False] | np.r_[False, same]
        fresh = both[twin & ~both["many"]]
        both["many"][twin] = True
        return both[np.r_[True, ~same]], fresh

    def add(self, run: np.ndarray) -> np.ndarray:
        """Entries, of the array or of the levels, that are now known to occur more than once."""
        found, run = [], self.sort(run)
        for level in self.levels:
            i = np.minimum(np.searchsorted(level["suffix"], run["suffix"]), len(level) - 1)
            here = np.flatnonzero(level["suffix"][i] == run["suffix"])
            i = i[here]
            found += [level[i[~level["many"][i]]], run[here[~run["many"][here]]]]
            level["many"][i] = run["many"][here] = True
        self.levels.append(run)
        while len(self.levels) > 1 and len(self.levels[-1]) * 2 > len(self.levels[-2]):
            y, x = self.levels.pop(), self.levels.pop()
            self.levels.append(self.merge(x, y)[0])
        return np.concatenate(found) if found else run[:0]

    def close(self) -> np.ndarray | None:
        """All levels as one array."""
        while len(self.levels) > 1:
            y, x = self.levels.pop(), self.levels.pop()
            self.levels.append(self.merge(x, y)[0])
        return self.levels[0] if self.levels else None


def entry(gram: int) -> np.dtype:
    return np.dtype([("suffix", f"S{gram + 16}"), ("rid", "S16"), ("at", "<i4"), ("before", "<u1"), ("after", "<u1"), ("many", "?")])


SPAN = np.dtype([("rid", "S16"), ("start", "<i4"), ("end", "<i4")])
WINDOWED = np.dtype([("window", "S16"), ("rid", "S16"), ("start", "<i4"), ("many", "?")])
REF = np.dtype([("rid", "S16"), ("bucket", "<i4"), ("at", "<i4"), ("before", "<u1"), ("after", "<u1")])
CHUNKS = "bucket int, kind int, body binary, bytes binary"
SPANS, RUNS, CONTEXTS, WINDOWS = range(4)


def _chunk(bucket: int, kind: int, body: np.ndarray, more: bytes = b"") -> tuple:
    return bucket, kind, body.tobytes(), more


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["bucket", "kind", "body", "bytes"])


def _by_bucket(body: np.ndarray, bucket: np.ndarray, kind: int) -> list[tuple]:
    order = np.argsort(bucket, kind="stable")
    body, bucket = body[order], bucket[order]
    ends = np.flatnonzero(np.r_[bucket[1:] != bucket[:-1], True]) + 1 if len(body) else []
    out, first = [], 0
    for end in ends:
        out.append(_chunk(int(bucket[first]), kind, body[first:end]))
        first = end
    return out


def _spans(entries: np.ndarray, length: int) -> np.ndarray:
    out = np.zeros(len(entries), SPAN)
    out["rid"] = entries["rid"]
    out["start"] = entries["at"] - entries["before"]
    out["end"] = out["start"] + entries["after"] + length
    return out


def _ids(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "S16")


def _arrays(buckets: int, length: int, gram: int):
    """(rid, text) -> suffix arrays of at most ``HELD_BYTES`` and a step in chunks by key, and the spans of contexts that repeat within one."""

    def dealt(own: list[np.ndarray], homes: list[np.ndarray]) -> pa.RecordBatch:
        run_, home = np.concatenate(own), np.concatenate(homes)
        order = np.argsort(run_["suffix"], kind="stable")
        run_, home = run_[order], home[order]
        same = run_["suffix"][1:] == run_["suffix"][:-1]
        twin = np.r_[same, False] | np.r_[False, same] if len(run_) else np.zeros(0, bool)
        spans = _spans(run_[twin], length)
        run_["many"] = twin
        keep = np.r_[True, ~same][: len(run_)]
        return _rows(_by_bucket(run_[keep], home[keep], RUNS) + _by_bucket(spans, home[twin], SPANS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, homes, held = [], [], 0
        for batch in batches:
            for part in steps(batch):
                data, offsets = flat(part.column(1))
                rows, at, a, b, keys = sampled(data, offsets, length, gram)
                e = np.zeros(len(rows), entry(gram))
                e["rid"], e["suffix"] = _ids(part.column(0))[rows], suffixes(data, at, a, b, length, gram)
                e["at"], e["before"], e["after"] = at - offsets[rows], at - a, b - a
                own.append(e)
                homes.append((keys % _U8(buckets)).astype(np.int32))
                held += e.nbytes
                if held > HELD_BYTES:
                    yield dealt(own, homes)
                    own, homes, held = [], [], 0
                    release()
        if own:
            yield dealt(own, homes)

    return run


def _scan(length: int, gram: int, hot: int):
    """A bucket's arrays through a family of levels -> spans of repeated contexts, and the contexts of suffixes that have several."""

    def run(table: pa.Table) -> pa.Table:
        out, family, found, bucket = [], Family(), [], table["bucket"][0].as_py()
        for kind, body in zip(table["kind"].to_pylist(), table["body"], strict=True):
            if kind == SPANS:
                out.append((bucket, kind, body.as_py(), b""))
            else:
                found.append(family.add(np.frombuffer(body.as_buffer(), entry(gram)).copy()))
        entries = family.close()
        if entries is not None and len(entries):
            out.append(_chunk(0, SPANS, _spans(np.concatenate(found), length)))
            own = _first(entries)
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            several = np.repeat(np.diff(np.r_[first, len(entries)]), np.diff(np.r_[first, len(entries)]))
            for kind, keep in ((CONTEXTS, (several > 1) & (several <= hot)), (WINDOWS, several > hot)):
                if keep.any():
                    refs = np.zeros(int(keep.sum()), REF)
                    refs["bucket"] = bucket
                    for name in ("rid", "at", "before", "after"):
                        refs[name] = entries[name][keep]
                    out.append(_chunk(0, kind, refs))
        return pa.Table.from_batches([_rows(out)])

    return run


def _explode(kind: int, dtype: np.dtype):
    """Chunks -> rows."""

    def column(x: np.ndarray) -> pa.Array:
        if x.dtype.kind == "S":
            return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(x), [None, pa.py_buffer(np.ascontiguousarray(x).tobytes())]).cast(pa.binary())
        return pa.array(x.astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, body in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                if k == kind:
                    e = np.frombuffer(body.as_buffer(), dtype)
                    yield pa.RecordBatch.from_arrays([column(e[n]) for n in dtype.names], names=list(dtype.names))

    return run


def _contexts(buckets: int, length: int):
    """(rid, text, refs) -> contexts in chunks by bucket; of hot suffixes the windows in chunks by their digest.

    Windows that repeat among those that a task holds give their spans here, and only one of them goes on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bodies: dict[int, list] = {}
        windows, held = [], 0

        def out() -> pa.RecordBatch:
            rows = [_chunk(k, CONTEXTS, np.array([x for x, _ in own], REF), b"".join(t for _, t in own)) for k, own in bodies.items()]
            if windows:
                w = np.concatenate(windows)
                w = w[np.argsort(w["window"], kind="stable")]
                same = w["window"][1:] == w["window"][:-1]
                w["many"] = np.r_[same, False] | np.r_[False, same]
                rows += _chunks_of(_runs(w[w["many"]], length))
                w = w[np.r_[True, ~same]]
                rows += _by_bucket(w, np.ascontiguousarray(w["window"]).view("<u8")[::2] % _U8(buckets), WINDOWS)
            bodies.clear()
            windows.clear()
            return _rows(rows)

        for batch in batches:
            for rid, text, refs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = text.encode()
                for r in refs:
                    start = r["at"] - r["before"]
                    part = data[start : start + r["after"] + length]
                    held += len(part)
                    if r["hot"]:
                        w = np.zeros(r["after"] + 1, WINDOWED)
                        w["window"] = np.frombuffer(b"".join(blake2b(part[i : i + length], digest_size=16).digest() for i in range(len(w))), "S16")
                        w["rid"], w["start"] = rid, np.arange(start, start + len(w))
                        windows.append(w)
                    else:
                        bodies.setdefault(r["bucket"], []).append(((rid, r["bucket"], r["at"], r["before"], r["after"]), part))
                if held > 16 << 20:
                    held = 0
                    yield out()
        yield out()

    return run


def _windows(data: np.ndarray, length: int) -> np.ndarray:
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, _U8)
    np.cumsum((data.astype(_U8) + _U8(1)) * up[:-1], out=sums[1:])
    return mixed((sums[length:] - sums[: len(data) - length + 1]) * down[: len(data) - length + 1])


def equal_windows(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Which of the windows of ``data`` that start at ``at`` have the bytes of another one.

    Windows of one hash are compared with the first of them byte by byte; should a hash have several strings,
    its windows are told apart by their bytes.
    """
    out = np.zeros(len(at), bool)
    h = np.concatenate([_windows(data[i : i + STEP_BYTES + length - 1], length) for i in range(0, len(data) - length + 1, STEP_BYTES)])[at]
    order = np.argsort(h, kind="stable")
    h = h[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    sizes = np.diff(np.r_[first, len(h)])
    lead = np.repeat(at[order[first]], sizes)
    live = np.flatnonzero(np.repeat(sizes, sizes) > 1)
    view = np.lib.stride_tricks.sliding_window_view(data, length)
    differs = np.zeros(len(h), bool)
    for i in range(0, len(live), 16_384):
        k = live[i : i + 16_384]
        differs[k] = (view[at[order[k]]] != view[lead[k]]).any(axis=1)
    mixed_ = np.zeros(len(first), bool)
    if differs.any():
        mixed_ = np.add.reduceat(differs, first) > 0
        for g in np.flatnonzero(mixed_):
            own = order[first[g] : first[g] + sizes[g]]
            strings = [view[at[k]].tobytes() for k in own]
            n = Counter(strings)
            out[own] = [n[x] > 1 for x in strings]
    plain = np.repeat((sizes > 1) & ~mixed_, sizes)
    out[order[plain]] = True
    return out


def _runs(w: np.ndarray, length: int) -> np.ndarray:
    """Windows (rid, start) -> the spans that they cover, neighbours joined."""
    w = w[np.lexsort((w["start"], w["rid"]))]
    new = np.flatnonzero(np.r_[True, (w["rid"][1:] != w["rid"][:-1]) | (w["start"][1:] > w["start"][:-1] + 1)]) if len(w) else np.zeros(0, np.int64)
    spans = np.zeros(len(new), SPAN)
    if len(w):
        spans["rid"], spans["start"], spans["end"] = w["rid"][new], w["start"][new], w["start"][np.r_[new[1:], len(w)] - 1] + length
    return spans


def _chunks_of(spans: np.ndarray) -> list[tuple]:
    return [_chunk(int(spans["start"][0]) & 1023, SPANS, spans)] if len(spans) else []


def _compare(length: int):
    """A bucket's contexts and windows -> spans of the windows that occur in more than one place."""

    def run(table: pa.Table) -> pa.Table:
        texts, refs, dealt, out = [], [], [], []
        for kind, body, text in zip(*(table[c].to_pylist() for c in ("kind", "body", "bytes")), strict=True):
            if kind == WINDOWS:
                dealt.append(np.frombuffer(body, WINDOWED))
            elif kind == CONTEXTS:
                refs.append(np.frombuffer(body, REF))
                texts.append(text)
            else:
                out.append(_chunk(0, SPANS, np.frombuffer(body, SPAN)))
        if refs:
            e, data = np.concatenate(refs), np.frombuffer(b"".join(texts), np.uint8)
            count = e["after"].astype(np.int64) + 1
            sizes = count - 1 + length
            step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            at = np.repeat(np.cumsum(sizes) - sizes, count) + step
            keep = np.flatnonzero(equal_windows(data, at, length))
            w = np.zeros(len(keep), WINDOWED)
            own = np.repeat(np.arange(len(e)), count)[keep]
            w["rid"], w["start"] = e["rid"][own], e["at"][own] - e["before"][own].astype(np.int64) + step[keep]
            out += _chunks_of(_runs(w, length))
        if dealt:
            w = np.concatenate(dealt)
            w = w[np.argsort(w["window"], kind="stable")]
            same = w["window"][1:] == w["window"][:-1]
            out += _chunks_of(_runs(w[w["many"] | np.r_[same, False] | np.r_[False, same]], length))
        return pa.Table.from_batches([_rows(out)])

    return run


def union_of(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of a list of (start, end)."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    ends = np.maximum.accumulate(spans[:, 1])
    new = np.flatnonzero(np.r_[True, spans[1:, 0] > ends[:-1]])
    return np.c_[spans[new, 0], ends[np.r_[new[1:], len(spans)] - 1]]


def remove(data: bytes, spans: np.ndarray) -> tuple[bytes, int, int]:
    """What is left, bytes removed, runs removed."""
    runs = union_of(spans)
    left, at = [], 0
    for s, e in runs:
        left.append(data[at:s])
        at = e
    left.append(data[at:])
    return b"".join(left), int((runs[:, 1] - runs[:, 0]).sum()), len(runs)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            data = (text or "").encode()
            s = spans.values if spans.is_valid else None
            left, cut, runs = remove(data, np.c_[s.field(0).to_numpy(), s.field(1).to_numpy()].astype(np.int64)) if s is not None and len(s) else (data, 0, 0)
            rows.append((len(data), cut, runs, hashlib.sha256(left).hexdigest()))
        columns = zip(*rows, strict=True) if rows else ([], [], [], [])
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text) -> the rows with their id ``rid``, and (rid, spans) of those with bytes covered by a repeated string.

    Every task sorts the sampled suffixes of its documents into arrays of bounded size, joins equal contexts and
    deals them out by the sampled bytes, to as many buckets as the texts' bytes ask for; each bucket scans the arrays one after another against a family of levels
    that merge geometrically. Contexts that occur twice are covered whole. Where several contexts share
    their sampled bytes, the texts travel and are compared window by window; with more than ``hot`` contexts the windows
    are dealt out by their own digests, those that repeat within a task as one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffixes")
    rid = F.unhex(F.md5(F.concat_ws("\0", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit("")))))
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")).withColumn("rid", rid)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, min(20_000, -(-size // BUCKET_BYTES)))
    arrays = rows.select("rid", "text").mapInArrow(_arrays(buckets, length, gram), CHUNKS)
    scanned = scratch.save(arrays.groupBy("bucket").applyInArrow(_scan(length, gram, hot), CHUNKS), "scanned")
    schema = "rid binary, bucket int, at int, before int, after int"
    refs = None
    for kind in (CONTEXTS, WINDOWS):
        part = scanned.filter(F.col("kind") == kind).mapInArrow(_explode(kind, REF), schema).withColumn("hot", F.lit(kind == WINDOWS))
        refs = part if refs is None else refs.unionByName(part)
    refs = refs.groupBy("rid").agg(F.collect_list(F.struct("bucket", "at", "before", "after", "hot")).alias("refs"))
    refs = scratch.save(refs, "refs")
    texts = _with_text(rows, refs)
    compared = texts.select("rid", "text", "refs").mapInArrow(_contexts(buckets, length), CHUNKS)
    compared = scratch.save(compared.groupBy("bucket").applyInArrow(_compare(length), CHUNKS), "compared")
    spans = scanned.filter(F.col("kind") == SPANS).unionByName(compared.filter(F.col("kind") == SPANS)).mapInArrow(_explode(SPANS, SPAN), "rid binary, start int, end int")
    return rows, scratch.save(spans.groupBy("rid").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")


def _with_text(rows: DataFrame, by_rid: DataFrame) -> DataFrame:
    """Rows joined to a table by rid; only texts that are wanted are shuffled while the ids are few enough to broadcast."""
    ids = by_rid.select("rid")
    if ids.count() <= BROADCAST_IDS:
        rows = rows.join(F.broadcast(ids), "rid", "left_semi")
    return rows.join(by_rid.hint("merge"), "rid")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, one row per input row.

    Texts are UTF-8 bytes. A byte goes if a string of ``length`` bytes that covers it also starts anywhere
    else in the same or another text. Null and short texts lose nothing; repeated rows, also of one
    doc_id, repeat each other's strings. A null doc_id is a document like any other and comes back as null.
    """
    rows, spans = repeated_spans(docs, length)
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    touched = _with_text(rows, spans).select("doc_id", "text", "spans").mapInArrow(_remove, schema)
    ids = spans.select("rid")
    rest = rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "rid", "left_anti")
    text = F.coalesce("text", F.lit(""))
    return touched.unionByName(rest.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(text, 256).alias("kept_sha256")))

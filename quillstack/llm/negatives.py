"""Hard negatives by bit-sliced integer inner products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Rows and anchors of a block; a task holds the products of some of its anchors with all its rows.
BLOCK, ANCHORS, AT_ONCE = 4096, 1024, 128
#: Products go pair by pair once fewer than this share of a block is left.
SPARSE = 0.05
#: Parts of a block whose maxima bound the k-th greatest score.
PARTS = 128
#: Positives of an anchor, negatives of a positive, and the percentages of its score between which they lie.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
_FAR = np.iinfo(np.int64).max // 4


class Planes:
    """Rows of integers as bit planes, most significant first; the first plane is the sign's."""

    def __init__(self, x: np.ndarray):
        self.bits = max(1, int(max(x.max(initial=0), -x.min(initial=0) - 1)).bit_length() + 1)
        self.x = x

    def plane(self, k: int) -> np.ndarray:
        """Bit k of every component, with its weight: -2**k for the sign, else 2**k."""
        bit = (self.x >> k) & 1
        return bit * (-(1 << k) if k == self.bits - 1 else 1 << k)


def products(q: np.ndarray, planes: Planes, alive: np.ndarray, wanted: "First | Between") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact scores of the pairs that stay candidates: anchor, row, score.

    Planes are added from the sign down. After each, a score lies between the sum so far and what the
    lower planes can add: (2**k - 1) times the sum of the anchor's negative, or positive, components.
    ``wanted`` says which pairs can still qualify by their intervals. While many pairs are left, a plane
    is one matrix product; then it goes pair by pair.
    """
    exact = float(np.abs(q).sum(axis=1).max(initial=0)) * 2.0**planes.bits
    if exact >= 2.0**63:
        raise ValueError("scores of these components do not fit in 64 bits")
    # Sums and bounds of floating point numbers are exact below 2**24 and 2**53.
    kind = np.float32 if exact < 2.0**24 else np.float64 if exact < 2.0**53 else np.int64
    down, up = np.minimum(q, 0).sum(axis=1), np.maximum(q, 0).sum(axis=1)
    left, sums, k = q.astype(kind), np.zeros(alive.shape, kind), planes.bits
    while k and alive.mean() >= SPARSE:
        k -= 1
        sums += left @ planes.plane(k).astype(kind).T
        rest = (1 << k) - 1
        alive = alive & wanted.table(sums, (rest * down).astype(kind)[:, None], (rest * up).astype(kind)[:, None], alive)
    i, j = np.nonzero(alive)
    score = sums[i, j].astype(np.int64)
    while len(i):
        rest = (1 << k) - 1
        keep = wanted.listed(i, score + rest * down[i], score + rest * up[i])
        i, j, score = i[keep], j[keep], score[keep]
        if not k:
            break
        k -= 1
        plane = planes.plane(k)
        for first in range(0, len(i), 1 << 16):
            part = slice(first, first + (1 << 16))
            score[part] += np.einsum("ij,ij->i", q[i[part]], plane[j[part]])
    return i, j, score


def _reached(i: np.ndarray, low: np.ndarray, k: int) -> np.ndarray:
    """For each pair the k-th greatest lower bound of its anchor (far below where there are fewer); pairs come by anchor."""
    order = np.lexsort((-low, i))
    first, after = np.searchsorted(i, i), np.searchsorted(i, i, "right")
    return np.where(after - first >= k, low[order][np.minimum(first + k - 1, len(i) - 1)], -_FAR)


class First:
    """Pairs among the k greatest scores of their anchor; ties stay."""

    def __init__(self, k: int):
        self.k = k

    def table(self, sums, down, up, alive):
        held = np.where(alive, sums + down, sums.dtype.type(-np.inf if sums.dtype.kind == "f" else -_FAR))
        if held.shape[1] > 2 * PARTS:  # k parts whose maxima reach a number hold k pairs that do
            held = np.maximum.reduceat(held, np.linspace(0, held.shape[1], PARTS, endpoint=False).astype(int), axis=1)
        if held.shape[1] < self.k:
            return alive
        return sums + up >= np.partition(held, held.shape[1] - self.k, axis=1)[:, [held.shape[1] - self.k]]

    def listed(self, i, low, high):
        return high >= _reached(i, low, self.k)


class Between:
    """Pairs among the k greatest scores of any window (columns of ``floor``, ``ceiling``) of their anchor; ties stay."""

    def __init__(self, floor: np.ndarray, ceiling: np.ndarray, k: int):
        self.floor, self.ceiling, self.k = floor, ceiling, k

    def table(self, sums, down, up, alive):
        least, most = (f(x, axis=1)[:, None].astype(sums.dtype) for f, x in ((np.min, self.floor), (np.max, self.ceiling)))
        return (sums <= most - down) & (sums >= least - up)

    def listed(self, i, low, high):
        out = np.zeros(len(i), bool)
        for f, c in zip(self.floor.T, self.ceiling.T, strict=True):
            f, c = f[i], c[i]
            least = _reached(i, np.where((low >= f) & (high <= c), low, -_FAR), self.k)
            out |= (low <= c) & (high >= np.maximum(f, least))
        return out


def _matrix(column, rows: np.ndarray, size: int) -> np.ndarray:
    return np.array([column[int(k)].as_py() for k in rows], np.int64).reshape(len(rows), size)


def _lengths(table: pa.Table) -> np.ndarray:
    return np.array([len(v) for v in table["x"].to_pylist()])


def _blocks(table: pa.Table) -> Iterator[tuple]:
    """Of a block pair: some anchors and all rows of their number of components."""
    table = table.combine_chunks()
    size, anchor = _lengths(table), table["as_anchor"].to_numpy(zero_copy_only=False)
    row = table["as_row"].to_numpy(zero_copy_only=False)
    for n in np.unique(size[anchor]):
        own, rows = np.flatnonzero(anchor & (size == n)), np.flatnonzero(row & (size == n))
        if not len(rows):
            continue
        planes = Planes(_matrix(table["x"], rows, int(n)))
        for first in range(0, len(own), AT_ONCE):
            some = own[first : first + AT_ONCE]
            yield table, some, rows, _matrix(table["x"], some, int(n)), planes


def _positives(k: int):
    def run(table: pa.Table) -> pa.Table:
        out = [[], [], []]
        for table, own, rows, q, planes in _blocks(table):
            ids, labels = table["vec_id"].to_numpy(), table["label"].to_numpy()
            alive = (labels[own][:, None] == labels[rows][None, :]) & (ids[own][:, None] != ids[rows][None, :])
            i, j, score = products(q, planes, alive, First(k))
            order = np.lexsort((ids[rows[j]], -score, i))
            i, j, score = i[order], j[order], score[order]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < k
            for a, b in zip(out, (ids[own[i]], ids[rows[j]], score), strict=True):
                a.append(b[keep])
        return _table(("anchor_id", "positive_id", "positive_score"), out)

    return run


def _negatives(k: int, low: int, high: int):
    def run(table: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        for table, own, rows, q, planes in _blocks(table):
            ids, labels = table["vec_id"].to_numpy(), table["label"].to_numpy()
            scores = [table["scores"][int(a)].as_py() for a in own]
            most = max(map(len, scores))
            floor, ceiling = np.full((len(own), most), 2, np.int64), np.ones((len(own), most), np.int64)  # 2 to 1: nothing
            for n, s in enumerate(scores):
                floor[n, : len(s)], ceiling[n, : len(s)] = [-(-low * v // 100) for v in s], [high * v // 100 for v in s]
            i, j, score = products(q, planes, labels[own][:, None] != labels[rows][None, :], Between(floor, ceiling, k))
            order = np.lexsort((ids[rows[j]], -score, i))
            i, j, score = i[order], j[order], score[order]
            for w in range(most):
                inside = np.flatnonzero((score >= floor[i, w]) & (score <= ceiling[i, w]))
                inside = inside[np.arange(len(inside)) - np.searchsorted(i[inside], i[inside]) < k]
                positive = np.array([s[w] if w < len(s) else 0 for s in scores], np.int64)
                for a, b in zip(out, (ids[own[i[inside]]], positive[i[inside]], ids[rows[j[inside]]], score[inside]), strict=True):
                    a.append(b)
        return _table(("anchor_id", "positive_score", "negative_id", "negative_score"), out)

    return run


def _table(names: tuple[str, ...], columns: list[list[np.ndarray]]) -> pa.Table:
    return pa.table({n: pa.array(np.concatenate([np.zeros(0, np.int64), *c]), pa.int64()) for n, c in zip(names, columns, strict=True)})


def _met(anchors: DataFrame, rows: DataFrame, na: int, nr: int, scores: bool) -> DataFrame:
    """Each block of anchors with each block of rows: an anchor goes to every row block, a row to every anchor block."""
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = F.col("scores") if scores else F.lit(None).cast("array<long>")
    left = anchors.select(block(na).cast("int").alias("pa"), every(nr).alias("pr"), "vec_id", "label", "x", own.alias("scores"), F.lit(True).alias("as_anchor"), F.lit(False).alias("as_row"))
    right = rows.select(every(na).alias("pa"), block(nr).cast("int").alias("pr"), "vec_id", "label", "x", F.lit(None).cast("array<long>").alias("scores"), F.lit(False).alias("as_anchor"), F.lit(True).alias("as_row"))
    return left.unionByName(right).groupBy("pa", "pr")


def hard_negatives(vectors: DataFrame, anchor, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = 256, block: int = BLOCK, anchors: int = ANCHORS) -> DataFrame:
    """(vec_id, label, embedding) -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(``scale`` * x); a score is the integer inner product with an anchor, a row for which
    the expression ``anchor`` holds. An anchor's positives are its first ``positives`` other rows of the same label,
    and each positive's negatives the first ``negatives`` rows of other labels with low * positive_score <= 100 *
    negative_score <= high * positive_score, by score (greatest first) and then vec_id. Anchors in blocks meet rows in blocks, so a task's
    work is bounded and no label or repeated vector gathers in one task; each block pair keeps its first few.

    Rows with a null vec_id, label or vector, or with a null, infinite or NaN component take no part; of
    repeated rows of one vec_id that with the least hash of label and vector counts. Vectors of different
    lengths never meet; empty vectors have the score 0. Scores beyond 64 bits are an error. Other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "negatives")
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    finite = F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))  # NaN is above all numbers
    valid = plain.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite)
    valid = valid.withColumn("x", F.transform("v", lambda x: F.floor(x * float(scale)))).withColumn("h", F.xxhash64("label", "x"))
    rows = valid.groupBy("vec_id").agg(F.min_by(F.struct("label", "x", "anchor"), "h").alias("r")).select("vec_id", "r.*")
    rows = scratch.save(rows, "rows")
    picked = rows.filter("anchor")
    n, n_anchors = rows.count(), picked.count()
    nr, na = max(1, -(-n // block)), max(1, -(-n_anchors // anchors))
    best = lambda *by: F.row_number().over(Window.partitionBy(*by[:-1]).orderBy(F.desc(by[-1][0]), by[-1][1]))
    found = scratch.save(_met(picked, rows, na, nr, False).applyInArrow(_positives(positives), "anchor_id long, positive_id long, positive_score long"), "near")
    found = scratch.save(found.withColumn("k", best("anchor_id", ("positive_score", "positive_id"))).filter(F.col("k") <= positives).drop("k"), "positives")
    # A window of a score that is not positive is empty, but for that of 0.
    scores = found.filter("positive_score >= 0").groupBy("anchor_id").agg(F.collect_set("positive_score").alias("scores"))  # at most ``positives`` values
    asked = scratch.save(picked.join(scores.withColumnRenamed("anchor_id", "vec_id"), "vec_id"), "asked")
    far = scratch.save(_met(asked, rows, na, nr, True).applyInArrow(_negatives(negatives, low, high), "anchor_id long, positive_score long, negative_id long, negative_score long"), "far")
    far = far.withColumn("rank", best("anchor_id", "positive_score", ("negative_score", "negative_id"))).filter(F.col("rank") <= negatives)
    return found.join(far, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def shifted(vectors: DataFrame) -> DataFrame:
    """The rows with label (label + 1) % 10 where vec_id is divisible by 7."""
    label = F.col("label").cast("long")
    return vectors.select("vec_id", F.when(F.col("vec_id") % 7 == 0, F.pmod(label + 1, F.lit(10))).otherwise(label).alias("label"), "embedding")

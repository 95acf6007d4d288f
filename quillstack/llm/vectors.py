"""Near-duplicate vectors: spherical k-means cells and blocked cosine products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import components

#: Least cosine of a link.
COSINE = 0.98
#: Vectors a cell is planned for, cells at most, vectors that k-means is fitted on at most, its rounds.
CELL, CELLS, SAMPLE, ROUNDS = 4096, 1024, 20_000, 12
#: Rows of a block of cosine products.
BLOCK = 2048


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Unit centroids of unit rows, by alternating assignment to the largest cosine and normalised sums."""
    k = max(1, min(k, len(x)))
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), centres)
    return centres


def visits(x: np.ndarray, centres: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of every unit row, and which other cells it must visit.

    Two vectors at angle t of which one lies in cell c are both within t of the bisector between c
    and the other's home h, so a vector visits c if x . (c_h - c) <= sin(t) |c_h - c|. No pair with
    at least the given cosine is lost.
    """
    dots = x @ centres.T
    home = np.argmax(dots, axis=1)
    gap = np.sqrt(np.maximum(0.0, 2 - 2 * centres @ centres.T))
    sine = np.sqrt(max(0.0, 1 - cosine * cosine)) + 1e-9
    other = dots[np.arange(len(x)), home][:, None] - dots <= sine * gap[home] + 1e-12
    other[np.arange(len(x)), home] = False
    return home, other


def _vector(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Little-endian doubles of every list, and which lists can be compared."""
    values, n = column.flatten(), len(column)
    flat = np.ascontiguousarray(values.fill_null(np.nan).to_numpy(zero_copy_only=False), "<f8") if len(values) else np.zeros(0)
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    row = np.repeat(np.arange(n), sizes)
    # By the largest component first, so that no square leaves the range of doubles.
    top = np.zeros(n)
    np.maximum.at(top, row, np.where(np.isfinite(flat), np.abs(flat), np.inf))
    ok = (top > 0) & np.isfinite(top)
    scaled = np.divide(flat, top[row], out=np.zeros_like(flat), where=ok[row])
    norm = np.sqrt(np.bincount(row, scaled * scaled, n))
    unit = np.divide(scaled, norm[row], out=np.zeros_like(flat), where=ok[row])
    return np.array([unit[e - k : e].tobytes() for e, k in zip(ends, sizes, strict=True)] + [b""], object)[:-1], ok


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, label, embedding) -> vec_id, label, unit vector as bytes (null if it links with nothing)."""
    for batch in batches:
        vectors, ok = _vector(batch.column(2))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([v if k else None for v, k in zip(vectors, ok, strict=True)], pa.binary())], names=["vec_id", "label", "unit"])


def _cells(centres, cosine: float):
    """(rep, label, copies, unit) -> one row for the home cell and one for each visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centres.value
        for whole in batches:
            for first in range(0, whole.num_rows, 4096):
                batch = whole.slice(first, 4096)
                sizes = np.array([len(v.as_py()) // 8 for v in batch.column(3)])
                rows, cells, homes = [], [], []
                for size in np.unique(sizes):
                    at = np.flatnonzero(sizes == size)
                    if size != c.shape[1]:  # other dimensions have a cell of their own
                        rows.append(at), cells.append(np.full(len(at), -int(size))), homes.append(np.ones(len(at), bool))
                        continue
                    x = np.frombuffer(b"".join(batch.column(3)[int(i)].as_py() for i in at), "<f8").reshape(len(at), -1)
                    home, other = visits(x, c, cosine)
                    i, j = np.nonzero(other)
                    rows.append(np.r_[at, at[i]]), cells.append(np.r_[home, j]), homes.append(np.r_[np.ones(len(at), bool), np.zeros(len(i), bool)])
                if rows:
                    taken = batch.take(pa.array(np.concatenate(rows), pa.int64()))
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(np.concatenate(cells), pa.int64()), pa.array(np.concatenate(homes))], names=["rep", "label", "copies", "unit", "cell", "home"])

    return run


def _products(cosine: float):
    """One block of home rows against one block of a cell -> per home row: links, counted with copies, and local roots."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        x = np.frombuffer(b"".join(v.as_py() for v in table["unit"]), "<f8").reshape(table.num_rows, -1)
        rep, copies = table["rep"].to_numpy(), table["copies"].to_numpy()
        left, right = (np.flatnonzero(table[s].to_numpy(zero_copy_only=False)) for s in ("as_home", "as_all"))
        links = np.zeros(len(left), np.int64)
        root = {}

        def find(k):
            while root.setdefault(k, k) != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        for i in range(0, len(left), 512):
            own = left[i : i + 512]
            near = x[own] @ x[right].T >= cosine
            near &= rep[own][:, None] != rep[right][None, :]
            links[i : i + 512] = near @ copies[right]
            # Rows with the same neighbours join at once; a union per row and distinct root suffices.
            for k in np.flatnonzero(near.any(axis=1)):
                a = find(rep[own[k]])
                for b in {find(v) for v in rep[right[near[k]]]}:
                    a, b = find(a), find(b)
                    root[max(a, b)] = min(a, b)
                    a = min(a, b)
        found = {k: find(k) for k in root}
        linked = [(k, r) for k, r in found.items() if k != r]
        keep = links > 0
        a = np.r_[rep[left][keep], np.array([k for k, _ in linked], np.int64)]
        b = np.r_[np.full(keep.sum(), -1), np.array([r for _, r in linked], np.int64)]
        n = np.r_[links[keep], np.zeros(len(linked), np.int64)]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64(), mask=np.r_[np.ones(keep.sum(), bool), np.zeros(len(linked), bool)]), "n": pa.array(n, pa.int64())})

    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """(vec_id, label, embedding) -> one row per distinct vec_id: vec_id, n_links, component_id, kept.

    Vectors of one label are linked if their cosine in double precision is at least ``cosine``. Equal
    directions are one vector with copies first. Spherical k-means, fitted on at most ``SAMPLE``
    vectors, gives cells; every vector has a home cell and visits those where a link may lie, so no
    link is lost. Cells are dealt out in blocks; each block pair counts the links of its home rows
    and gives a local root for each linked row, and the components of those are the groups.

    Null labels, and null, zero, empty or not finite vectors link with nothing and are kept. Of
    repeated rows of one vec_id that with the least hash of label and direction counts. A null vec_id comes back unlinked with a null
    component, kept. Vectors of different lengths never link. Other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    units = plain.filter("vec_id is not null").mapInArrow(_units, "vec_id long, label string, unit binary")
    units = scratch.save(units.withColumn("unit", F.when(F.col("label").isNotNull(), F.col("unit"))).withColumns({"g1": F.xxhash64("label", "unit"), "g2": F.xxhash64("unit", "label", F.lit(1))}), "units")
    # Ids that come twice with different vectors keep the one with the smallest hash.
    ids = units.groupBy("vec_id").agg(F.count("*").alias("n"), F.min("g1").alias("g")).filter("n > 1").select("vec_id", F.col("g").alias("only"))
    if not ids.isEmpty():
        units = scratch.save(units.join(ids, "vec_id", "left").filter("only is null or only = g1").drop("only").dropDuplicates(["vec_id"]), "single")
    valid = units.filter("unit is not null")
    copies = valid.groupBy("g1", "g2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    copies = scratch.save(copies, "copies")
    reps = copies.select("rep", "copies").join(valid.select(F.col("vec_id").alias("rep"), "label", "unit"), "rep").select("rep", "label", "copies", "unit")
    reps = scratch.save(reps, "reps")
    n = reps.count()
    out = units.select("vec_id", "g1", "g2", F.col("unit").isNotNull().alias("valid"))
    links = spark.createDataFrame([], "a long, b long, n long")
    if n:
        share = min(1.0, SAMPLE / n)
        size = F.octet_length("unit") / 8
        common = reps.groupBy(size.alias("d")).count().orderBy(F.desc("count"), "d").first().d
        picked = reps.filter((size == common) & (F.pmod(F.xxhash64("rep"), F.lit(1_000_000)) < int(1_000_000 * share) + 1)).orderBy(F.xxhash64("rep")).limit(SAMPLE).select("unit").toPandas()["unit"]
        fitted = np.frombuffer(b"".join(bytes(v) for v in picked), "<f8").reshape(-1, int(common)) if len(picked) else np.eye(1, int(common))
        centres = spark.sparkContext.broadcast(spherical_kmeans(fitted, min(CELLS, -(-n // cell))))
        placed = scratch.save(reps.mapInArrow(_cells(centres, cosine), "rep long, label string, copies long, unit binary, cell long, home boolean"), "placed")
        sizes = placed.groupBy("label", "cell").agg(F.count("*").alias("rows"), F.count_if("home").alias("homes")).filter("homes > 0 and rows > 1")
        spread = placed.join(sizes, ["label", "cell"]).withColumns({"nl": F.ceil(F.col("homes") / block), "nr": F.ceil(F.col("rows") / block), "h": F.xxhash64("rep")})
        spread = spread.withColumns({"l": F.when(F.col("home"), F.pmod("h", "nl")), "r": F.pmod("h", "nr")})
        # Block pair (l, r): home rows of block l against all rows of block r; a row in both comes once.
        pairs = F.array_distinct(
            F.concat(
                F.when(F.col("home"), F.transform(F.sequence(F.lit(0).cast("long"), F.col("nr") - 1), lambda k: F.struct(F.col("l").alias("l"), k.alias("r")))).otherwise(F.array().cast("array<struct<l:long,r:long>>")),
                F.transform(F.sequence(F.lit(0).cast("long"), F.col("nl") - 1), lambda k: F.struct(k.alias("l"), F.col("r").alias("r"))),
            )
        )
        dealt = spread.withColumn("p", F.explode(pairs)).select("label", "cell", F.col("p.l").alias("pl"), F.col("p.r").alias("pr"), "rep", "copies", "unit", (F.col("home") & (F.col("p.l") == F.col("l"))).alias("as_home"), (F.col("p.r") == F.col("r")).alias("as_all"))
        links = scratch.save(dealt.groupBy("label", "cell", "pl", "pr").applyInArrow(_products(cosine), "a long, b long, n long"), "links")
    counts = links.filter("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    roots = components(links.filter("b is not null").select("a", "b"), scratch)
    known = copies.join(counts, copies.rep == counts.a, "left").join(roots, copies.rep == roots.node, "left")
    known = known.select("g1", "g2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("component"))
    out = out.join(known, ["g1", "g2"], "left").select(
        "vec_id",
        F.when(F.col("valid"), F.col("n")).otherwise(0).cast("long").alias("n_links"),
        F.when(F.col("valid"), F.col("component")).otherwise(F.col("vec_id")).alias("component_id"),
    )
    lost = plain.filter("vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(lost).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))

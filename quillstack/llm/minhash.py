"""Near-duplicate documents by probability MinHash, banding and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, counted, flat, mixed, shingle_hashes, steps, word_hashes
from .components import components, with_least

#: Words of a shingle, least similarity of a link, bands and registers of a band.
WORDS, SIMILARITY, BANDS, ROWS = 5, 0.8, 36, 7
#: Ids of candidate documents are broadcast up to this count (8 bytes each) and joined by shuffle beyond it.
BROADCAST_IDS = 500_000
#: Rows of a block of a candidate group.
BLOCK = 512
#: Pairs whose estimated similarity is lower than the least one by more than this (4 standard errors) are not compared.
MARGIN = 0.12
_MASK = np.uint64((1 << 44) - 1)


def profiles(column: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, element and weight of every distinct shingle; the weight is how often the row has it."""
    data, offsets = flat(column)
    shingles, rows = shingle_hashes(*word_hashes(data, offsets), words)
    keys, weights = counted((rows.astype(np.uint64) << np.uint64(44)) | (shingles & _MASK))
    return (keys >> np.uint64(44)).astype(np.int64), keys & _MASK, weights


def signatures(rows: np.ndarray, elements: np.ndarray, weights: np.ndarray, n: int, registers: int) -> np.ndarray:
    """ProbMinHash signatures of ``n`` rows.

    Every element is a Poisson process whose rate is its weight; each arrival goes to a random
    register, which keeps the element of its earliest arrival. An element stops once its next
    arrival is later than the latest register of its row. Two registers agree with the
    probability Jaccard similarity of their weighted sets.
    """
    best = np.full(n * registers, np.inf)
    who = np.zeros(n * registers, np.uint64)
    at = np.zeros(len(rows))
    latest = np.full(n, np.inf)
    r = 0
    while len(rows):
        seed = mixed(elements * np.uint64(0x9E3779B97F4A7C15) + np.uint64(mixed(np.array([r + 1], np.uint64))[0]))
        at = at - np.log(((seed >> np.uint64(20)) + np.uint64(1)).astype(np.float64) * 2.0**-44) / weights
        slot = rows * registers + ((seed & np.uint64(0xFFFFF)) * np.uint64(registers) >> np.uint64(20)).astype(np.int64)
        early = np.flatnonzero(at < best[slot])
        np.minimum.at(best, slot[early], at[early])
        won = early[best[slot[early]] == at[early]]
        who[slot[won]] = elements[won]
        live = np.flatnonzero(np.bincount(rows, minlength=n))
        latest[live] = best.reshape(n, registers)[live].max(axis=1)
        keep = at < latest[rows]
        rows, elements, weights, at = rows[keep], elements[keep], weights[keep], at[keep]
        r += 1
    return who.reshape(n, registers)


def _sketch(bands: int, per: int, words: int):
    """(doc_id, text) -> (doc_id, f1, f2, keys, bits): a fingerprint of the weighted shingles, the band keys, two bits a register."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                n = part.num_rows
                rows, elements, weights = profiles(part.column(1), words)
                one = mixed(elements + mixed(weights.astype(np.uint64)))
                two = mixed(one + np.uint64(0x632BE59BD9B4E019))
                prints = []
                for x in (one, two):
                    sums = np.r_[np.uint64(0), np.cumsum(x, dtype=np.uint64)]
                    ends = np.searchsorted(rows, np.arange(n + 1))
                    prints.append(mixed(sums[ends[1:]] - sums[ends[:-1]]))
                empty = np.bincount(rows, minlength=n) == 0
                won = signatures(rows, elements, weights, n, bands * per).reshape(n, bands, per)
                keys = np.zeros((n, bands), np.uint64)
                for i in range(per):
                    keys = mixed(keys * np.uint64(0xD6E8FEB86659FD93) + won[:, :, i] + np.uint64(1))
                keys = mixed(keys + np.arange(bands, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands + 1, bands), pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
                codes = np.zeros((n, -(-bands * per // 32) * 32), np.uint64)
                codes[:, : bands * per] = mixed(won.reshape(n, -1)) & np.uint64(3)
                bits = (codes.reshape(n, -1, 32) << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(axis=2, dtype=np.uint64)
                words_of = pa.ListArray.from_arrays(pa.array(np.arange(0, bits.size + 1, bits.shape[1]), pa.int32()), pa.array(bits.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x.view(np.int64), mask=empty) for x in prints), lists, words_of], names=["doc_id", "f1", "f2", "keys", "bits"])

    return run


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard of two (sorted elements, weights): sum over shared i of 1 / sum_j max(a_j/a_i, b_j/b_i)."""
    shared, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(shared):
        return 0.0
    x, y = a[1][i].astype(float), b[1][j].astype(float)
    only_a, only_b = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    ratio = x / y
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    above = only_a + np.r_[np.cumsum(x[::-1])[::-1], 0.0]  # a's weight where a_j/b_j is at least the ratio
    below = only_b + np.r_[0.0, np.cumsum(y)]
    at = np.searchsorted(ratio, ratio, "left")
    return float((1.0 / (above[at] / x + below[at] / y)).sum())


def _each(column: pa.Array, words: int):
    rows, elements, weights = profiles(column, words)
    ends = np.searchsorted(rows, np.arange(len(column) + 1))
    for k in range(len(column)):
        yield elements[ends[k] : ends[k + 1]], weights[ends[k] : ends[k + 1]]


_PAIRS = np.uint64(0x5555555555555555)


def _sets(table: pa.Table, words: int) -> list:
    batch = table.select(["text"]).combine_chunks().to_batches()
    return [x for b in batch for part in steps(b) for x in _each(part.column(0), words)]


def _verify(words: int, least: float):
    """Leaders and the texts that share a band with them -> links (a, b) of those that are alike."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("lead", "ascending"), ("is_lead", "descending")])
        ids, leads, is_lead = (table[c].to_numpy(zero_copy_only=False) for c in ("doc_id", "lead", "is_lead"))
        sets, own = _sets(table, words), None
        keep = np.zeros(len(ids), bool)
        for k in range(len(ids)):
            if is_lead[k]:
                own = k
            else:
                keep[k] = probability_jaccard(sets[own], sets[k]) >= least - 1e-12
        return pa.table({"a": pa.array(ids[keep], pa.int64()), "b": pa.array(leads[keep], pa.int64())})

    return run


def _near(table: pa.Table, differing: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each left row of a block pair, and the right ones of its group and of another root whose sketches are near."""
    group, root = table["component"].to_numpy(), table["root"].to_numpy()
    left, right = (table[c].to_numpy(zero_copy_only=False) for c in ("as_left", "as_right"))
    bits = np.array(table["bits"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(group), -1))
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    for start, end in zip(first, np.r_[first[1:], len(group)], strict=True):
        rights = start + np.flatnonzero(right[start:end])
        for i in start + np.flatnonzero(left[start:end]):
            x = bits[i] ^ bits[rights]
            near = rights[(np.bitwise_count((x | x >> np.uint64(1)) & _PAIRS).sum(axis=1) <= differing) & (root[rights] != root[i])]
            # A pair that stands on both sides counts once.
            yield i, near[~(left[near] & right[i] & (near < i))]


def _ordered(table: pa.Table) -> pa.Table:
    return table.combine_chunks().sort_by([("component", "ascending"), ("doc_id", "ascending")])


def _survivors(differing: int):
    """Block pairs of sketches -> the rows that must be compared with one of another root."""

    def run(table: pa.Table) -> pa.Table:
        table = _ordered(table)
        keep = np.zeros(table.num_rows, bool)
        for i, near in _near(table, differing):
            keep[near] = True
            keep[i] |= len(near) > 0
        return table.select(["doc_id"]).filter(pa.array(keep))

    return run


def _compare(words: int, least: float, differing: int):
    """Block pairs of texts -> links (a, b) that connect all rows of a block pair whose texts are alike.

    Pairs that the links found so far connect already are skipped.
    """

    def run(table: pa.Table) -> pa.Table:
        table = _ordered(table)
        ids, roots = table["doc_id"].to_numpy(), table["root"].to_numpy()
        sets = _sets(table, words)
        known: dict[int, int] = {}
        start = np.array([known.setdefault(r, k) for k, r in enumerate(roots.tolist())], np.int64)
        top = start.copy()

        def find(k: int) -> int:
            while top[k] != k:
                top[k] = top[top[k]]
                k = top[k]
            return k

        links = []
        for i, near in _near(table, differing):
            for j in near:
                a, b = find(i), find(j)
                if a != b and probability_jaccard(sets[i], sets[j]) >= least - 1e-12:
                    top[max(a, b)] = min(a, b)
                    links.append((i, j))
        return pa.table({n: pa.array([ids[x[k]] for x in links], pa.int64()) for k, n in enumerate("ab")})

    return run


def _beside(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """An inner join to a stored table of one row a key, which is broadcast while it is small, so that hot keys stay where they are."""
    return rows.join(F.broadcast(table) if table.count() <= BROADCAST_IDS else table, key)


def _block_pairs(rows: DataFrame, block: int, count: int) -> DataFrame:
    """Rows of groups (component) dealt out as units: pairs of blocks of a large group, or some small groups together."""
    sizes = rows.groupBy("component").agg(F.ceil(F.count("*") / block).alias("n"))
    placed = _beside(rows, sizes, "component").withColumn("own", F.pmod(F.xxhash64("doc_id"), "n")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    unit = F.when(F.col("n") == 1, F.concat(F.lit("s"), F.pmod(F.xxhash64("component"), F.lit(count // block + 1)).cast("string"))).otherwise(F.concat_ws("-", "component", low, high))
    return placed.select(unit.alias("unit"), *rows.columns, (F.col("own") == low).alias("as_left"), (F.col("own") == high).alias("as_right"))


def _wanted(known: DataFrame, ids: DataFrame, count: int) -> DataFrame:
    """The texts of some ids; these are broadcast while they are few."""
    ids = ids.select("doc_id")
    return known.join(F.broadcast(ids) if count <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def _single(known: DataFrame) -> DataFrame:
    """One row per doc_id, that with the least text."""
    again = known.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    if again.isEmpty():
        return known
    least = known.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    return known.join(again, "doc_id", "left_anti").unionByName(least)


def near_duplicates(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """(doc_id, text) -> one row per distinct doc_id: doc_id, class_id, kept.

    Documents are weighted sets of ``words``-word shingles (words end at white space, the weight
    is the count). Equal sets are one class without comparison. The others are banded by their
    ProbMinHash signatures. Every text is compared with the least text of each of its bands, by the exact
    probability Jaccard similarity of whole texts. Texts linked by shared bands are one candidate group; where those
    links leave a group in several pieces, two-bit sketches of the signatures, dealt out in pairs of blocks, tell which
    texts may be like one of another piece, and only those travel and are compared. Only links of forests leave the
    tasks, never pairs. Classes are the connected components; class_id is the smallest doc_id and kept marks that document.

    Null, empty and blank texts have no shingles and are a class each; a text under ``words`` words is
    one shingle. Repeated rows of one doc_id count once (the least text by order); rows with a null doc_id come
    back as they are, class_id null and kept. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = _single(plain.filter("doc_id is not null"))
    sketch = scratch.save(known.mapInArrow(_sketch(bands, rows, words), "doc_id long, f1 long, f2 long, keys array<long>, bits array<long>"), "sketch")
    first = scratch.save(sketch.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).filter("f1 is not null"), "first")
    reps = sketch.join(first.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    # The least text of a band leads it; every text is compared with its leaders, the followers of a leader by blocks.
    stars = with_least(reps.select("doc_id", F.explode("keys").alias("band")), "band", "doc_id", "lead").filter("doc_id <> lead").select("doc_id", "lead").distinct()
    stars = scratch.save(stars, "stars")
    followers = scratch.save(stars.groupBy("lead").agg(F.ceil(F.count("*") / block).alias("n")), "followers")
    labels, count = spark.createDataFrame([], "node long, component long"), stars.count()
    if count:
        differing = int(0.75 * bands * rows * (1 - similarity + MARGIN))
        few = F.concat(F.lit("s"), F.pmod(F.xxhash64("lead"), F.lit(count // block + 1)).cast("string"))
        units = lambda part: F.when(F.col("n") == 1, few).otherwise(F.concat_ws("-", "lead", part)).alias("unit")
        own = _beside(stars, followers, "lead").select("doc_id", "lead", units(F.pmod(F.xxhash64("doc_id"), "n")), F.lit(False).alias("is_lead"))
        led = followers.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).select(F.col("lead").alias("doc_id"), "lead", units(F.col("k")), F.lit(True).alias("is_lead"))
        pairs = own.unionByName(led)
        texts = _wanted(known, pairs.select("doc_id").distinct(), 2 * count)
        verified = scratch.save(pairs.join(texts, "doc_id").groupBy("unit").applyInArrow(_verify(words, similarity), "a long, b long"), "verified")
        labels = components(verified, scratch, "verified-links")
        # Pieces that share bands without a link so far are one group; sketches tell which of its texts need comparing with those of another piece.
        root = lambda name, to: labels.select(F.col("node").alias(name), F.col("component").alias(to))
        apart = stars.join(root("doc_id", "ra"), "doc_id", "left").join(root("lead", "rb"), "lead", "left").select(F.coalesce("ra", "doc_id").alias("a"), F.coalesce("rb", "lead").alias("b")).filter("a <> b").distinct()
        apart = scratch.save(apart, "apart")
        left = 0
        if not apart.isEmpty():
            groups = components(apart, scratch, "groups")
            groups = scratch.save(groups.unionByName(groups.select(F.col("component").alias("node"), "component").distinct()).withColumnRenamed("node", "root"), "open")
            members = pairs.select("doc_id").distinct().join(root("doc_id", "root"), "doc_id", "left").select("doc_id", F.coalesce("root", "doc_id").alias("root"))
            rest = scratch.save(_beside(members, groups, "root").join(sketch.select("doc_id", "bits"), "doc_id"), "rest")
            left = rest.count()
        if left:
            near = _block_pairs(rest, block, left).groupBy("unit").applyInArrow(_survivors(differing), "doc_id long").distinct()
            rest = scratch.save(rest.join(near, "doc_id", "left_semi"), "near")
            left = rest.count()
        if left:
            dealt = _block_pairs(rest, block, left).join(_wanted(known, rest, left), "doc_id")
            edges = scratch.save(dealt.groupBy("unit").applyInArrow(_compare(words, similarity, differing), "a long, b long"), "edges")
            if not edges.isEmpty():
                labels = components(verified.unionByName(edges), scratch, "links")
        labels = scratch.save(labels, "labels")
    classes = first.join(labels, first.rep == labels.node, "left").select("f1", "f2", F.coalesce("component", "rep").alias("class_id"))
    out = sketch.select("doc_id", "f1", "f2").join(classes, ["f1", "f2"], "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    out = out.groupBy("doc_id").agg(F.min("class_id").alias("class_id")).withColumn("kept", F.col("doc_id") == F.col("class_id"))
    lost = plain.filter("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(True).alias("kept"))
    return out.unionByName(lost)

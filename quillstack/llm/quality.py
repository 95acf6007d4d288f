"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, flat, mixed, steps, tree_sum, word_hashes, unused

#: Hash buckets of n-grams (n = 1, 2).
BUCKETS = 1 << 16
#: Labelled rows of good quality that the target model reads at most, chosen by a hash of doc_id.
SAMPLE = 20_000
#: Share of the documents that is sampled.
KEEP = 0.85
#: Cells of keys that are counted at once, and rows of a cell from which it is cut into cells again.
CELLS, CELL_ROWS = 10_000, 100_000
_PART = 4096
_U8 = np.uint64


def grams(column: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and row of every word and word pair (A-Z lower-cased), and the n-grams of each row."""
    data, offsets = flat(column)
    words, rows = word_hashes(data, offsets, lower=True)
    pair = np.flatnonzero(rows[1:] == rows[:-1]) if len(rows) else np.zeros(0, np.int64)
    both = mixed(words[pair] * _U8(0x9E3779B97F4A7C15) + words[pair + 1])
    keys = np.r_[words, both] % _U8(buckets)
    at = np.r_[rows, rows[pair]]
    return keys.astype(np.int64), at, np.bincount(at, minlength=len(offsets) - 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> the task's n-gram counts in parts."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for part in steps(batch):
            total += np.bincount(grams(part.column(0))[0], minlength=BUCKETS)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS // _PART), pa.int64()), pa.array([p.tobytes() for p in total.reshape(-1, _PART)], pa.binary())], names=["part", "counts"])


def _sum(table: pa.Table) -> pa.Table:
    total = np.zeros(_PART, np.int64)
    for c in table["counts"]:
        total += np.frombuffer(c.as_buffer(), np.int64)
    return pa.table({"part": table["part"].slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})


def gram_counts(texts: DataFrame) -> np.ndarray:
    """n-gram counts of all texts; the driver gets BUCKETS numbers, however many texts there are."""
    rows = tree_sum(texts.select("text").mapInArrow(_count, "part long, counts binary"), "part", _sum, "part long, counts binary").collect()
    total = np.zeros((BUCKETS // _PART, _PART), np.int64)
    for r in rows:
        total[r.part] = np.frombuffer(bytes(r.counts), np.int64)
    return total.reshape(-1)


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log p_target / p_raw per bucket; the target is smoothed by the raw model with the weight of four n-grams a bucket."""
    p_raw = (raw + 1.0) / (raw.sum() + len(raw))
    p_target = (target + 4 * len(raw) * p_raw) / (target.sum() + 4 * len(raw))
    return np.log(p_target / p_raw)


def _weigh(ratio):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = ratio.value
        for batch in batches:
            for part in steps(batch):
                keys, rows, n = grams(part.column(1))
                sums = np.bincount(rows, r[keys], len(n))
                mean = np.divide(sums, n, out=np.full(len(n), float(r.min())), where=n > 0)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(mean), pa.array(n.astype(np.int64))], names=["doc_id", "mean_log_ratio", "n_grams"])

    return run


def importance(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text) -> doc_id, held_out, mean_log_ratio, n_grams, log_weight, score, one row per input row.

    The raw model counts all rows; the target model counts rows labelled with quality 1 whose
    crc32(doc_id as text) mod 3 is not 1, at most ``sample`` of them. ``log_weight`` is the log importance
    weight: the sum of the log ratios of all n-grams of the whole text. ``score`` maps their mean to 0..1. Null, empty
    and blank texts get the smallest ratio of all n-grams. Rows with a null or repeated doc_id stay row by row; empty
    tables give no rows, and no labels a model that tells nothing apart.
    """
    spark = docs.sparkSession
    plain = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    good = labels.filter((F.col("quality") == 1) & (fold != 1)).select("doc_id").distinct()
    n = good.count()
    if n > sample:
        good = good.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * sample / n))
    raw = gram_counts(plain)
    ratio = spark.sparkContext.broadcast(log_ratio(gram_counts(plain.join(F.broadcast(good), "doc_id", "left_semi")), raw))
    kind = plain.schema["doc_id"].dataType.simpleString()
    out = plain.mapInArrow(_weigh(ratio), f"doc_id {kind}, mean_log_ratio double, n_grams long")
    return out.select(
        "doc_id",
        F.coalesce(fold == 1, F.lit(False)).alias("held_out"),
        "mean_log_ratio",
        "n_grams",
        (F.col("mean_log_ratio") * F.greatest("n_grams", F.lit(1))).alias("log_weight"),
        (1 / (1 + F.exp(-10 * (F.col("mean_log_ratio"))))).alias("score"),
    )


def gumbel_top_k(weighted: DataFrame, keep: float = KEEP, seed: int = 17) -> DataFrame:
    """Adds ``gumbel_key`` and ``kept``: the k rows with the largest log_weight + Gumbel noise, k = ceil(keep * rows).

    Taking the largest perturbed weights samples without replacement by importance. The noise is a
    hash of doc_id and the seed. The k-th key is found by counting keys in cells; the cell that holds it is cut into
    cells again until it has few rows, and those are ranked (by key, then doc_id; nulls last). More than ``CELL_ROWS`` rows
    of one key, which are copies of one doc_id, are ranked in parts: of each part of the table as many stay as are still wanted after the
    parts before it.
    """
    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keyed = weighted.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform)))
    keyed = Scratch(weighted.sparkSession, "gumbel").save(keyed, "keyed")
    low, high, n = keyed.agg(F.min("gumbel_key"), F.max("gumbel_key"), F.count("*")).first()
    if not n:
        return keyed.withColumn("kept", F.lit(True))
    left, inside, clear = -(-int(n * keep * 1_000_000) // 1_000_000), F.lit(True), F.when(F.lit(False), True)
    while n > CELL_ROWS and low < high:
        width = (high - low) / CELLS
        cell = F.floor((F.col("gumbel_key") - low) / width)
        cells = keyed.filter(inside).groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min("gumbel_key").alias("low"), F.max("gumbel_key").alias("high")).orderBy(F.desc("cell")).collect()  # CELLS + 1 rows at most
        for c in cells:
            if c.n >= left:
                break
            left -= c.n
        clear = clear.when(inside & (cell != c.cell), cell > c.cell)
        inside, low, high, n = inside & (cell == c.cell), c.low, c.high, c.n
    order = (F.desc("gumbel_key"), F.col("doc_id").asc_nulls_last())
    if n <= CELL_ROWS:
        ranked = keyed.filter(inside).withColumn("kept", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) <= left)
    else:
        part, of, wanted = (unused(keyed, name) for name in ("part", "of_part", "wanted"))
        ties = Scratch(weighted.sparkSession, "gumbel").save(keyed.filter(inside).withColumn(part, F.spark_partition_id()), "ties")
        before = F.sum("n").over(Window.orderBy(of).rowsBetween(Window.unboundedPreceding, -1))
        counts = ties.groupBy(F.col(part).alias(of)).agg(F.count("*").alias("n")).select(of, (F.lit(left) - F.coalesce(before, F.lit(0))).alias(wanted))  # one row a part
        rank = F.row_number().over(Window.partitionBy(part).orderBy(*order))
        ranked = ties.join(F.broadcast(counts), F.col(part) == F.col(of)).withColumn("kept", rank <= F.col(wanted)).select(*keyed.columns, "kept")
    return keyed.filter(~inside).withColumn("kept", clear).unionByName(ranked)

"""Shared storage and Arrow helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import shared_dir

#: Bytes of text handled by one vectorised step; bounds the NumPy temporaries of a worker.
STEP_BYTES = 1 << 20


class Scratch:
    """Intermediate tables of one operator call, as Parquet in the shared folder.

    Writing a table cuts the lineage: a lost executor costs the tasks that ran on it and no more.
    ``drop`` removes a table that no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.load(name, df.schema)

    def load(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def release() -> None:
    """Gives freed memory back to the system, so that idle workers stay small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def steps(batch: pa.RecordBatch, column: str = "text", most: int = STEP_BYTES):
    """Slices of a batch with at most ``most`` bytes of text each; a longer text comes alone."""
    _, offsets = flat(batch.column(batch.schema.get_field_index(column)))
    first, rows = 0, batch.num_rows
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield batch.slice(first, min(last, rows) - first)
        first = last
    del offsets
    release()


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser for 64-bit hashes (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers["up"]) < n:
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            grown = np.full(max(n, STEP_BYTES + 4096), base, np.uint64)
            grown[0] = 1
            _powers[name] = np.cumprod(grown, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


WHITE = np.zeros(256, bool)
WHITE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_bounds(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every run of bytes not in ``outside`` ([\\x20\\x09-\\x0D] if not given); runs end with their row."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = ~outside[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[:-1][np.diff(offsets) > 0]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = offsets[1:][np.diff(offsets) > 0] - 1
    last[tails] = inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each pair, from prefix sums of one polynomial."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64, out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word."""
    starts, ends, rows = word_bounds(data, offsets)
    return hashes(LOWER[data] if lower else data, starts, ends), rows


def shingle_hashes(words: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of ``size`` words; a row with fewer words has one, of all of them."""
    if not len(words):
        return words, rows
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    counts = np.diff(np.r_[first, len(rows)])
    padded = np.r_[words, np.zeros(size - 1, np.uint64)]
    left = np.repeat(counts, counts) - (np.arange(len(rows)) - np.repeat(first, counts))
    total = np.zeros(len(words), np.uint64)
    for i in range(size):
        factor = np.uint64(pow(BASE, 2 * i + 1, 1 << 64))
        total += np.where(left > i, padded[i : i + len(words)], np.uint64(0)) * factor
    keep = left >= size
    keep[first] = True
    return mixed(total[keep]), rows[keep]


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and how often each occurs."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    keys = np.sort(keys)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.diff(np.r_[first, len(keys)])


def tree_sum(parts: DataFrame, key: str, add, schema: str) -> DataFrame:
    """Sums the chunks of a key in two steps: those of about sqrt(tasks) tasks first, so no task gets a chunk of every task."""
    tasks = parts.rdd.getNumPartitions()
    salted = parts.withColumn("salt", F.spark_partition_id() % max(1, round(tasks**0.5)))
    return salted.groupBy(key, "salt").applyInArrow(add, schema).groupBy(key).applyInArrow(add, schema)


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have (Spark's names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Ids that ``without`` broadcasts at most (8 bytes each).
BROADCAST_IDS = 500_000


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose doc_id is not in ``ids``; rows with a null doc_id stay.

    The ids are broadcast while they are few enough, so that the texts are not shuffled; beyond
    that it is a shuffled anti join.
    """
    ids = Scratch(docs.sparkSession, "ids").save(ids.select("doc_id").distinct(), "ids")  # what finds them runs once
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_anti").select(docs.columns)

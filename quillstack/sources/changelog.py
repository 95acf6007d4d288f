"""A table kept as an append-only log of changes beside a base that is bucketed by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the log beside the table's own.
VERSION, GONE = "log_version", "log_deleted"


class ChangeLog:
    """Writes append numbered versions; reads take the last value of every field; ``compact`` folds the log into the base.

    One writer at a time. ``schema`` (DDL) must hold ``key``; values of a key come once in each append. The base is an
    external table of the session's catalog with one bucket for each shuffle partition, so joins on the key shuffle the other side only.
    """

    def __init__(self, spark: SparkSession, name: str, root: str, key: str, schema: str, buckets: int | None = None):
        self.spark, self.name, self.root, self.key, self.schema = spark, name, root.rstrip("/"), key, schema
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.columns = [f.name for f in spark.createDataFrame([], schema).schema]
        self.other = [c for c in self.columns if c != key]

    def _numbers(self, part: str) -> list[int]:
        """Numbers of the finished folders of the log or the base: few, as the base takes the log in."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{part}")
        store = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(path):
            return []
        done = [s.getPath() for s in store.listStatus(path) if store.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName().partition("=")[2]) for p in done if "=" in p.getName())

    def append(self, changes: DataFrame, deleted: bool = False) -> int:
        """Adds a version: given (not null) fields replace those of the key's row, or the row is deleted. Its number."""
        number = max([0, *self._numbers("log"), *self._numbers("base")]) + 1
        fields = [(F.col(c) if c in changes.columns else F.lit(None).cast(self.spark.createDataFrame([], self.schema).schema[c].dataType)).alias(c) for c in self.columns]
        changes.select(*fields, F.lit(deleted).alias(GONE)).write.mode("overwrite").parquet(f"{self.root}/log/version={number}")
        return number

    def base(self) -> DataFrame | None:
        """The table as of the last compaction, bucketed by key."""
        found = self._numbers("base")
        if not found:
            return None
        table = f"{self.name}_{found[-1]}"
        if not self.spark.catalog.tableExists(table):
            self.spark.sql(f"CREATE TABLE {table} ({self.schema}) USING parquet CLUSTERED BY ({self.key}) SORTED BY ({self.key}) INTO {self.buckets} BUCKETS LOCATION '{self.root}/base/upto={found[-1]}'")
        return self.spark.table(table)

    def _changes(self) -> DataFrame | None:
        """One row a key of the log since the base: whether it was deleted, whether it is there after that, and fields set after that."""
        base = max([0, *self._numbers("base")])
        parts = [self.spark.read.schema(f"{self.schema}, {GONE} boolean").parquet(f"{self.root}/log/version={n}").withColumn(VERSION, F.lit(n)) for n in self._numbers("log") if n > base]
        if not parts:
            return None
        log = parts[0]
        for p in parts[1:]:
            log = log.unionByName(p)
        version = F.col(VERSION)
        last = lambda c: F.max(F.when(~F.col(GONE) & F.col(c).isNotNull(), F.struct(version.alias("v"), F.col(c).alias("x"))))
        found = log.groupBy(self.key).agg(F.max(F.when(F.col(GONE), version)).alias("gone"), F.max(F.when(~F.col(GONE), version)).alias("set"), *[last(c).alias(c) for c in self.other])
        after = lambda v: F.coalesce(v > F.col("gone"), v.isNotNull())
        fields = [F.when(after(F.col(c)["v"]), F.col(c)["x"]).alias(c) for c in self.other]
        return found.select(self.key, F.col("gone").isNotNull().alias("gone"), after(F.col("set")).alias("there"), *fields)

    def latest(self) -> DataFrame:
        """The table as it stands; where there is a base, only the log's keys are shuffled."""
        base, changes = self.base(), self._changes()
        if changes is None:
            return base if base is not None else self.spark.createDataFrame([], self.schema)
        if base is None:
            return changes.filter("there").select(self.columns)
        new = changes.select(F.col(self.key).alias("log_key"), "gone", "there", *[F.col(c).alias(f"log_{c}") for c in self.other])
        both = base.join(new, F.col(self.key) == F.col("log_key"), "full_outer")
        kept = F.coalesce("there", F.lit(False)) | (F.col(self.key).isNotNull() & ~F.coalesce("gone", F.lit(False)))
        old: dict[str, Column] = {c: F.when(~F.coalesce("gone", F.lit(False)), F.col(c)) for c in self.other}
        return both.filter(kept).select(F.coalesce(self.key, "log_key").alias(self.key), *[F.coalesce(f"log_{c}", old[c]).alias(c) for c in self.other]).select(self.columns)

    def compact(self) -> None:
        """Folds the log into a new base; the old one stays for readers that have opened it."""
        upto = max([0, *self._numbers("log")])
        if upto > max([0, *self._numbers("base")]):
            writer = self.latest().repartition(self.buckets, self.key).write.mode("overwrite").bucketBy(self.buckets, self.key).sortBy(self.key)
            writer.option("path", f"{self.root}/base/upto={upto}").format("parquet").saveAsTable(f"{self.name}_{upto}")

"""Parquet that look-ups can skip: sorted by the looked-up column, with Bloom filters."""

from __future__ import annotations

from pyspark.sql import DataFrame


def save_for_lookup(df: DataFrame, path: str, column: str, files: int | None = None, group_bytes: int = 16 << 20, values: int = 1_000_000) -> None:
    """Writes the rows range-partitioned and sorted by ``column``.

    Each file holds a range of values and each row group a part of it, so their least and greatest values rule most of
    them out; Bloom filters (planned for ``values`` distinct values a group) rule out values between them that aren't there. The column is first in
    the files' sort order, nulls too.
    """
    dealt = df.repartitionByRange(files, column) if files else df.repartitionByRange(column)
    writer = dealt.sortWithinPartitions(column).write.mode("overwrite").option("parquet.block.size", group_bytes)
    writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option(f"parquet.bloom.filter.expected.ndv#{column}", values).parquet(path)

"""Sources and stores that grow: incremental folders, change logs, look-up files and mergeable statistics."""

import os
import random

import pytest
from pyspark.sql import functions as F

from quillstack.operators import sketches, store
from quillstack.sources import changelog, files, incremental, skipping


def _write(folder, names):
    for n in names:
        (folder / f"{n}.txt").write_bytes(b"\xff\xfe\xff" if n == "bad" else f"chunk one of {n}\fchunk two of {n}".encode())


def test_a_killed_ingestion_gives_each_chunk_once(spark, tmp_path):
    folder, sink, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    folder.mkdir()
    _write(folder, ["a", "b", "c", "d", "bad"])
    lines = lambda f: files.readable(f).select("filename", F.explode(F.split("text", "\n")).alias("text")).filter("text <> ''")
    calls = []

    def dies(found):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("killed")
        return lines(found)

    def cut_off(found):
        """Leaves a half-written batch behind, as a lost driver would."""
        if not calls:
            calls.append(1)
            lines(found).limit(1).write.mode("overwrite").parquet(f"{sink}/chunks/batch=0")
            raise RuntimeError("killed")
        return lines(found)

    with pytest.raises(Exception, match="killed"):
        incremental.ingest(spark, str(folder), sink, checkpoint, cut_off, files.plain_text, "*.txt", files_a_batch=2)
    calls.clear()
    with pytest.raises(Exception, match="killed"):
        incremental.ingest(spark, str(folder), sink, checkpoint, dies, files.plain_text, "*.txt", files_a_batch=2)
    incremental.ingest(spark, str(folder), sink, checkpoint, lines, files.plain_text, "*.txt", files_a_batch=2)
    _write(folder, ["e", "f"])
    incremental.ingest(spark, str(folder), sink, checkpoint, lines, files.plain_text, "*.txt", files_a_batch=2)
    incremental.ingest(spark, str(folder), sink, checkpoint, lines, files.plain_text, "*.txt", files_a_batch=2)
    got = sorted((r.filename, r.text) for r in spark.read.parquet(f"{sink}/chunks").collect())
    assert got == sorted((f"{n}.txt", f"chunk {k} of {n}") for n in "abcdef" for k in ("one", "two"))
    failed = spark.read.parquet(f"{sink}/failed").collect()
    assert [r.filename for r in failed] == ["bad.txt"] and "Unicode" in failed[0]._error


def _same(a, b):
    return sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def test_change_log_equals_the_store(spark, tmp_path):
    rng = random.Random(1)
    schema = "id long, uid long, title string, is_active boolean, at long"
    rows = [(i, i % 7, f"t{i}", True, i) for i in range(100)]
    table = spark.createDataFrame(rows, schema)
    log = changelog.ChangeLog(spark, "talks", f"file://{tmp_path}/log", "id", schema, 4)
    assert log.latest().count() == 0
    log.append(table)
    for k in range(3):
        changes = spark.createDataFrame([(i, None if i % 2 else f"new{k}", i + 1000 * k) for i in rng.sample(range(130), 30)], "id long, title string, at long")
        log.append(changes)
        table = store.upsert(table, changes, "id")
        gone = spark.createDataFrame([(i,) for i in rng.sample(range(130), 10)], "id long")
        log.append(gone, deleted=True)
        table = store.delete(table, gone, "id")
        assert _same(log.latest(), table)
        if k == 1:
            log.compact()
            assert _same(log.latest(), table)
            back = spark.createDataFrame([(r.id, "again") for r in gone.collect()], "id long, title string")
            log.append(back)  # a deleted key comes back with what is given only
            table = store.upsert(table, back, "id")
    assert _same(log.latest(), table)
    off = spark.createDataFrame([(5,), (6,)], "id long").join(log.latest(), "id", "left_semi")
    log.append(off.select("id", F.lit(False).alias("is_active")))
    assert _same(log.latest(), store.soft_delete(table.withColumn("deleted_at", F.lit(None).cast("string")), off, "id", F.lit("x")).drop("deleted_at"))
    kept = store.retention(log.latest().filter("uid is not null"), "uid", F.col("at"), "id", 5)
    assert kept.groupBy("uid").count().filter("count > 4").isEmpty()
    # The base is not shuffled, not by a read of changes and not by a join; another session finds it again.
    log.compact()
    log.append(spark.createDataFrame([(1, "x")], "id long, title string"))
    again = changelog.ChangeLog(spark.newSession(), "talks", f"file://{tmp_path}/log", "id", schema, 4)
    for reader in (log, again):
        plan = reader.latest()._jdf.queryExecution().executedPlan().toString()
        lines = plan.split("== Initial Plan ==")[-1].split("\n")
        scan = next(i for i, line in enumerate(lines) if "Bucketed: true" in line)
        depth = lambda line: len(line) - len(line.lstrip(" :+-"))
        above = [line for i, line in enumerate(lines[:scan]) if depth(line) < depth(lines[scan]) and all(depth(x) > depth(line) for x in lines[i + 1 : scan + 1])]
        assert above and not any("Exchange" in line for line in above)
    assert again.latest().filter("id = 1").first().title == "x"


def test_lookups_skip_row_groups(spark, tmp_path):
    rows = spark.range(200_000).select(F.xxhash64("id").alias("key"), (F.col("id") % 1000).alias("user"), F.repeat(F.lit("x"), 20).alias("body"))
    path = str(tmp_path / "sorted")
    skipping.save_for_lookup(rows, path, "user", 4, 64 << 10, 1000)

    def read(df):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        plan = plan.finalPhysicalPlan() if "Adaptive" in plan.getClass().getName() else plan
        leaf = plan.collectLeaves().apply(0)
        return int(leaf.metrics().apply("numOutputRows").value())

    found = store.lookup(spark.read.parquet(path), user=437)
    assert found.count() == 200 and read(store.lookup(spark.read.parquet(path), user=437)) < 20_000
    assert read(store.lookup(spark.read.parquet(path), user=5_000_000)) == 0


def test_sketches_merge(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i % 900, rng.randrange(1, 1000)) for i in range(9000)]
    df = spark.createDataFrame(rows, "doc_id long, tokens long")
    parts = [sketches.sketched(df.filter(F.pmod(F.hash("tokens", "doc_id"), F.lit(3)) == k)) for k in range(3)]
    got = sketches.report(sketches.merged(parts[0].unionByName(parts[1]).unionByName(parts[2]))).first()
    assert got.n_chunks == 9000 and abs(got.n_docs / 900 - 1) <= sketches.DISTINCT_ERROR and got.tokens_per_chunk == pytest.approx(sum(t for _, t in rows) / 9000)
    for rank, value in zip((0.1, 0.5, 0.9), got.quantiles, strict=True):
        assert sum(t < value for _, t in rows) / 9000 - sketches.RANK_ERROR <= rank <= sum(t <= value for _, t in rows) / 9000 + sketches.RANK_ERROR
    seen = sketches.save_observed(df, str(tmp_path / "o"))
    assert seen == {"n_chunks": 9000, "n_tokens": sum(t for _, t in rows), "most_tokens": max(t for _, t in rows)} and os.path.isdir(tmp_path / "o")
    none = sketches.report(sketches.sketched(df.limit(0))).first()
    assert none.n_chunks == 0 and none.quantiles is None and none.tokens_per_chunk is None

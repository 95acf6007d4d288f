"""The pipeline's stages, one after another, on planted documents."""

import os
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as cp

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()
    prose = lambda n: " ".join(f"z{rng.randrange(900)}" for _ in range(n))
    a = prose(80)
    more = [(90001, a), (90002, a + " end"), (90003, "You idiot, you worthless stupid moron. " * 4), (90004, prose(20) + " " + bench.text), (90005, prose(9) + ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'), (90006, None), (90007, "")]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in more], docs.schema)
    now, before = docs.unionByName(extra), None
    for name, stage in cp.STAGES[:-1]:
        stage(spark, now, SF).write.parquet(str(tmp_path / name))
        before, now = now, spark.read.parquet(str(tmp_path / name))
        assert now.columns == docs.columns and now.count() <= before.count()
    left = {r.doc_id: r for r in now.filter("doc_id > 90000").collect()}
    assert set(left) == {90001, 90005, 90006, 90007} and "[REDACTED]" in left[90005].text and left[90005].n_chars == len(left[90005].text)
    packed = cp.STAGES[-1][1](spark, now, SF)
    assert packed.select("doc_id").distinct().count() == now.count()


def test_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "g h i j k l"), (2, "a b c d e f"), (None, "x"), (None, "x")], "doc_id long, text string")
    got = cp.minhash_stage(spark, docs, SF)
    assert got.filter("doc_id is null").count() == 2
    # The two texts of id 1 are two documents: one is a copy of id 2's, the other stays.
    assert sorted(tuple(r) for r in got.filter("doc_id is not null").collect()) == [(1, "g h i j k l"), (2, "a b c d e f")]
    far = spark.createDataFrame([(1, "a b c d e f"), (1, "g h i j k l"), ((1 << 63) - 2, "m n o p q r")], "doc_id long, text string")
    assert cp.minhash_stage(spark, far, SF).count() == 3


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "x", 7), (1, "a b c d e f", "x", 8), (2, "g h i j k l", "y", 9)], "doc_id long, text string, row string, count int")
    got = cp.minhash_stage(spark, docs, SF)
    assert got.columns == docs.columns and sorted((r.doc_id, r.row) for r in got.collect()) == [(1, "x"), (2, "y")]


def test_registered(spark):
    names = entry.queries()
    assert "pipeline" in names and all(sum(k.startswith(f"op{n}_") for k in names) == 1 for n in range(1, 14))
    run = cp.run(spark, SF)
    assert run.agg(F.count("*")).first()[0] > 0


def test_url_oracle(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    want = sorted(con.sql(entry.oracle_sql()["op8_url_filter"]).fetchall(), key=str)
    assert sorted((tuple(r) for r in entry.queries()["op8_url_filter"](spark, SF).collect()), key=str) == want

"""Corpus cleaning from raw documents to packed sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept. All but the
last return the columns of ``docs``. Rows with a null doc_id or text pass the filters; packing
gives them the end id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.llm import decontam, minhash, packing, secrets, toxicity
from quillstack.llm.common import Scratch, unused, without

#: No stage can be put as SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar, learned from ``labels``, rejects go."""
    return toxicity.without_toxic(docs, toxicity.learn(docs, _table(spark, sf_dir, "labels")))


def minhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays; rows that share a doc_id and differ in text are documents of their own."""
    again = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 and doc_id is not null").select("doc_id")
    scratch = Scratch(spark, "repeated-ids")
    again = scratch.save(again, "again")
    if again.isEmpty():
        return without(docs, minhash.near_duplicates(docs).filter("not kept"))
    own = unused(docs, "own_id")
    single = without(docs, again)
    many = docs.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).withColumnRenamed("doc_id", own)
    low, high = docs.agg(F.min("doc_id").cast("long"), F.max("doc_id").cast("long")).first()
    if high < 1 << 62:  # numbers that no document has; rows with an id of their own stay before these
        number = F.monotonically_increasing_id() + F.lit(high + 1)
    elif low > -(1 << 62):
        number = F.lit(low - 1) - F.monotonically_increasing_id()
    else:
        raise ValueError("doc_ids leave no range for the rows that share one")
    many = scratch.save(many.withColumn("doc_id", number), "many")
    gone = minhash.near_duplicates(single.select("doc_id", "text").unionByName(many.select("doc_id", "text"))).filter("not kept").select("doc_id")
    gone = scratch.save(gone, "gone")
    left = without(many, gone).select(*[F.col(own).cast(docs.schema["doc_id"].dataType).alias(c) if c == "doc_id" else F.col(c) for c in docs.columns])
    return without(single, gone).unionByName(left)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak an item of ``benchmark`` go."""
    return without(docs, decontam.leaks(docs, _table(spark, sf_dir, "benchmark")))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; n_chars follows the text."""
    out = secrets.redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts as pieces of sequences of at most 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("minhash_dedup", minhash_stage),
    ("decontamination", decontamination_stage),
    ("secret_scan", secrets_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = _table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

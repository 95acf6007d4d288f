"""Queries opN_<name> of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, kneserney, negatives, packing, periodic, quality, secrets, suffixes, tokenfiles, toxicity, urlfilter, vectors
from .minhash import near_duplicates


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learned from two thirds of the labels."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.learn(docs, _table(spark, sf_dir, "labels")))


def op3_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents, as counts and digests of their spans."""
    return secrets.digest(secrets.find_secrets(_table(spark, sf_dir, "documents")))


def op5_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weights of all documents towards those of good quality, and the Gumbel top-k sample."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return quality.gumbel_top_k(quality.importance(docs, labels))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of near-duplicate vectors of one label."""
    return vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents by a model of nine tenths of them."""
    return kneserney.score_held_out(_table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the urls of all pages."""
    return urlfilter.judge_urls(_table(spark, sf_dir, "pages"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that leak items of the benchmark."""
    return decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents outside strings of 200 bytes that repeat."""
    return suffixes.remove_repeats(_table(spark, sf_dir, "documents"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of all documents, from files of range-coded blocks."""
    return tokenfiles.round_trip(_table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in all documents, with periodic ends planted in a tenth of them."""
    return periodic.digest(periodic.periodic_runs(periodic.planted(_table(spark, sf_dir, "documents"))))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector among all vectors."""
    return negatives.hard_negatives(negatives.shifted(_table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)


QUERIES = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_sum_of_squares_packing": op3_sum_of_squares_packing,
    "op4_secret_scan": op4_secret_scan,
    "op5_importance_resampling": op5_importance_resampling,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_kneser_ney": op7_kneser_ney,
    "op8_url_filter": op8_url_filter,
    "op9_decontamination": op9_decontamination,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_token_files": op11_token_files,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_hard_negatives": op13_hard_negatives,
}


def _url_oracle() -> str:
    fits = [f"""SELECT page_id, url, host, path, {len(r)} AS size, '{r}' AS rule, '{v}' AS verdict FROM p WHERE (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{t}')""" for v, r in urlfilter.RULES for h, _, t in [r.partition("/")]]
    return f"""
WITH u AS (SELECT page_id, url, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
fits AS ({" UNION ALL ".join(fits)}),
best AS (SELECT page_id, url, arg_max(rule, size) AS rule, arg_max(verdict, size) AS verdict FROM fits GROUP BY page_id, url)
SELECT p.page_id, p.host, p.path, best.rule, coalesce(best.verdict, '{urlfilter.DEFAULT}') AS verdict
FROM p LEFT JOIN best ON p.page_id = best.page_id AND p.url = best.url"""


_NEGATIVES_ORACLE = f"""
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {negatives.POSITIVES})
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND {negatives.LOW} * positive_score <= 100 * score AND 100 * score <= {negatives.HIGH} * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= {negatives.NEGATIVES}"""


ORACLE_SQL: dict[str, str] = {
    "op13_hard_negatives": _NEGATIVES_ORACLE,
    "op8_url_filter": _url_oracle(),
}

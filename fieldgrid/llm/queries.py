"""Registered queries of this package and, where SQL can state them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroids, decontamination, extraction, neardup, negatives, packing, quality, records, search, secrets, sharding, substrings, toxicity
from .common import table, vocabulary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


@query
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces(packing.pack_sequences(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")))


@query
def op4_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@query
def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(table(spark, sf_dir, "documents"))


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.report(table(spark, sf_dir, "embeddings"))


ORACLES["op7_top_k"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
    WHERE q.vec_id % 50 = 0
),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op1_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.report(table(spark, sf_dir, "pages"))


@query
def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.report(table(spark, sf_dir, "embeddings"))


def _lloyd(rounds: int = 3) -> str:
    """Rounds of assignment and floored means as chained steps."""
    steps = [
        """v AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
    FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, e) - 1 AS cluster, e FROM v
    QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, e) <= 16
)"""
    ]
    for n in range(rounds + 1):
        steps.append(
            f"""a{n} AS MATERIALIZED (
    SELECT r, vec_id, any_value(e) AS e, arg_min(cluster, d * 64 + cluster) AS cluster, min(d) AS distance FROM (
        SELECT v.r, v.vec_id, v.e, c.cluster, CAST(list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
        FROM v, c{n} c)
    GROUP BY r, vec_id
)"""
        )
        if n < rounds:
            steps.append(
                f"""c{n + 1} AS MATERIALIZED (
    SELECT c.cluster, coalesce(m.e, c.e) AS e FROM c{n} c LEFT JOIN (
        SELECT cluster, list(x ORDER BY i) AS e FROM (
            SELECT cluster, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x
            FROM (SELECT cluster, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM a{n}) GROUP BY cluster, i)
        GROUP BY cluster) m USING (cluster)
)"""
            )
    return f"""WITH {", ".join(steps)}
SELECT a.vec_id, CAST(a.cluster AS INTEGER) AS cluster, a.distance,
    CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
    CAST(sum(a.distance) OVER () AS BIGINT) AS inertia,
    sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c USING (cluster)"""


ORACLES["op11_centroids"] = _lloyd()


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.report(table(spark, sf_dir, "embeddings"))


ORACLES["op12_hard_negatives"] = """
WITH v AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
a AS (SELECT row_number() OVER () AS anchor, * FROM (SELECT DISTINCT vec_id, label, e FROM v WHERE vec_id % 100 = 0)),
s AS MATERIALIZED (
    SELECT a.anchor, a.vec_id AS anchor_id, v.r, v.vec_id, a.label = v.label AS same,
        CAST(list_dot_product(CAST(a.e AS DOUBLE[]), CAST(v.e AS DOUBLE[])) AS BIGINT) AS score
    FROM a JOIN v ON a.vec_id <> v.vec_id AND len(a.e) = len(v.e)
),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, r) <= 5),
n AS (
    SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor, p.r ORDER BY n.score DESC, n.vec_id, n.r) AS rank,
        n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
    FROM p JOIN s n ON n.anchor = p.anchor AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


@query
def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

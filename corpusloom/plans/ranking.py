"""Queries over embeddings: the centroid, scores, cuts, strata."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import vectors
from corpusloom.operators import band
from corpusloom.plans import texts
from corpusloom.session import load, work_folder


def scored(spark, sf):
    e = load(spark, sf, "embeddings").withColumn("candidate", F.col("vec_id") % 3 == 0)
    # scores are rounded, so that the order of a sum can't move a row over a cut
    return band.scores(e, "label", "embedding", F.col("candidate")).select("vec_id", "label", "candidate", F.round("score", 6).alias("score"))


def vector_check(spark, sf):
    return load(spark, sf, "embeddings").select("vec_id", vectors.valid(F.col("embedding"), 64).alias("valid"))


def band_cuts(spark, sf):
    c = band.cuts(scored(spark, sf), "candidate")
    return c.select(*[F.round(x, 6).alias(x) for x in c.columns])


def band_strata(spark, sf):
    return band.strata(scored(spark, sf), "candidate")


def band_by_label(spark, sf):
    return band.by_source(band_strata(spark, sf), "label")


def band_top15(spark, sf):
    return band.top(scored(spark, sf), "candidate", "vec_id")


def band_auc(spark, sf):
    a = band.auc(scored(spark, sf), "candidate")
    return a.select(F.round("auc", 6).alias("auc"), "positives", "negatives")


def lexicon_band_join(spark, sf):
    """Candidates by search terms, scored by their vectors."""
    e = load(spark, sf, "embeddings").select("vec_id", "embedding")
    m = texts.matched(spark, sf, e.select(F.col("vec_id").alias("doc_id"))).select(F.col("doc_id").alias("vec_id"), "source", "candidate")
    # the centroid and the scores both read these rows, so terms are matched before, once
    work_folder(spark)
    rows = e.join(m, "vec_id").checkpoint()
    return band.scores(rows, "source", "embedding", F.col("candidate")).select("vec_id", "source", "candidate", F.round("score", 6).alias("score"))


QUERIES = {"centroid_scores": scored} | {f.__name__: f for f in (vector_check, band_cuts, band_strata, band_by_label, band_top15, band_auc, lexicon_band_join)}


def _scores(rows: str, source: str, cast: str = "") -> str:
    """CTEs for ``rows`` (vec_id, source, candidate, embedding): s has a score for each."""
    return f"""u AS (SELECT vec_id, {source} AS src, candidate, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS d FROM {rows}),
      by_source AS (SELECT src, d, avg(CAST(x AS DOUBLE)) AS x FROM u WHERE candidate GROUP BY src, d), c AS (SELECT d, avg(x) AS x FROM by_source GROUP BY d),
      n AS (SELECT sqrt(sum(x * x)) AS n FROM c), s AS (SELECT vec_id, round(sum(CAST(u.x AS DOUBLE) * (c.x / n)), 6) AS score FROM u JOIN c USING (d), n GROUP BY vec_id)"""


E = "WITH e AS (SELECT *, vec_id % 3 = 0 AS candidate FROM embeddings), " + _scores("e", "label") + ", r AS (SELECT vec_id, label, candidate, score FROM e JOIN s USING (vec_id))"
Q = ", q AS (SELECT quantile_cont(score, CAST(0.9 AS DOUBLE)) AS c1, quantile_cont(score, CAST(0.7 AS DOUBLE)) AS c2, min(score) AS c3 FROM r WHERE NOT candidate)"
S = Q + ", t AS (SELECT r.*, CASE WHEN candidate THEN 'candidate' WHEN score >= c1 THEN 'band-top10' WHEN score >= c2 THEN 'band-next20' ELSE 'rest' END AS stratum FROM r, q)"
ORACLE_SQL = {
    "centroid_scores": E + " SELECT * FROM r",
    "vector_check": "SELECT vec_id, len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AS valid FROM embeddings",
    "band_cuts": E + Q + " SELECT round(c1, 6) AS cut_top10, round(c2, 6) AS cut_next20, round(c3, 6) AS cut_rest FROM q",
    "band_strata": E + S + " SELECT vec_id, label, candidate, score, stratum FROM t",
    "band_by_label": E + S + " SELECT label, stratum, count(*) AS n, round(median(score), 6) AS median_score FROM t GROUP BY label, stratum",
    "band_top15": E + " SELECT * FROM r WHERE NOT candidate ORDER BY score DESC, vec_id LIMIT 15",
    "band_auc": E
    + """, k AS (SELECT candidate, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM r)
      SELECT round((sum(CAST(rk AS DOUBLE)) FILTER (candidate) - count_if(candidate) * (count_if(candidate) + 1) / 2) / (count_if(candidate) * count_if(NOT candidate)), 6) AS auc, CAST(count_if(candidate) AS BIGINT) AS positives, CAST(count_if(NOT candidate) AS BIGINT) AS negatives FROM k""",
    "lexicon_band_join": texts.M + ", e AS (SELECT vec_id, source, candidate, embedding FROM embeddings JOIN m ON vec_id = doc_id), " + _scores("e", "source") + " SELECT vec_id, source, candidate, score FROM e JOIN s USING (vec_id)",
}

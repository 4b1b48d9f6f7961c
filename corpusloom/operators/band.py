"""Ranking of documents by similarity to a centroid in which every source weighs the same."""

from __future__ import annotations

from math import inf, isfinite

from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import vectors
from corpusloom.session import checkpointed

CUTS = {"top10": 0.9, "next20": 0.7}


def centroid(df: DataFrame, source: str, vector: str, mask) -> DataFrame:
    """One row: the mean of the sources' means over the masked rows, of length 1. Null if no row is masked."""
    by_source = df.where(mask).groupBy(source).agg(Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>"))).alias("m"))
    return by_source.agg(Summarizer.mean(F.col("m")).alias("m")).select(vectors.unit(vector_to_array("m")).alias("centroid"))


def scores(df: DataFrame, source: str, vector: str, mask) -> DataFrame:
    """df with ``score``: the dot product with the centroid. The centroid is one row, so it is broadcast."""
    c = centroid(df, source, vector, mask)
    return df.crossJoin(F.broadcast(c)).withColumn("score", vectors.dot(F.col(vector), F.col("centroid"))).drop("centroid")


def _edges(scores_of: DataFrame, column: str, pieces: int = 256) -> list[float]:
    """Scores that cut the rows into pieces of about equal size; equal scores may take more."""
    found = scores_of.agg(F.percentile_approx(column, F.array(*[F.lit(i / pieces) for i in range(1, pieces)]), F.lit(4 * pieces)).alias("q")).first()["q"]
    return sorted(set(found or []))


def _binned(rows: DataFrame, column: str) -> DataFrame:
    """rows with ``bin``, which follows the order of the scores; equal scores are in one."""
    edges = [e for e in _edges(rows, column) if isfinite(e)]
    if not edges:
        return rows.withColumn("bin", F.lit(0))
    found = Bucketizer(splits=[-inf, *edges, inf], inputCol=column, outputCol="bin", handleInvalid="keep").transform(rows)
    return found.withColumn("bin", F.col("bin").cast("int"))


def cuts(scored: DataFrame, candidate: str) -> DataFrame:
    """One row: exact quantiles of the scores of rows that aren't candidates, between neighbours in proportion.

    Equal scores are counted first, the counts are dealt into bins of about equal size, and only bins that hold a wanted
    place are put in order, so no task holds all scores."""
    shares = [*CUTS.values(), 0.0]
    counts = scored.where(~F.col(candidate) & F.col("score").isNotNull()).groupBy(F.col("score").alias("s")).agg(F.count("*").alias("n"))
    binned = _binned(checkpointed(counts), "s")
    before = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # over at most as many rows as there are bins
    bins = binned.groupBy("bin").agg(F.sum("n").alias("size")).select("bin", "size", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("lower"), F.sum("size").over(Window.partitionBy()).alias("total"))
    places = bins.select("bin", "size", "lower", F.posexplode(F.array(*[(F.col("total") - 1) * F.lit(q) for q in shares])).alias("which", "at"))
    wanted = places.select("bin", "lower", "which", "at", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))).alias("k"), "size").where("k >= lower AND k < lower + size").drop("size")
    upto = Window.partitionBy("bin", "which", "k").orderBy("s")
    held = binned.join(F.broadcast(wanted), "bin").withColumn("upto", F.col("lower") + F.sum("n").over(upto))
    ends = held.where((F.col("k") < F.col("upto")) & (F.col("k") >= F.col("upto") - F.col("n"))).groupBy("which", "at").agg(F.min_by("s", "k").alias("a"), F.max_by("s", "k").alias("b"))
    values = ends.select("which", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.floor("at"))).alias("v"))
    return values.agg(*[F.max(F.when(F.col("which") == i, F.col("v"))).alias(f"cut_{n}") for i, n in enumerate([*CUTS, "rest"])])


def strata(scored: DataFrame, candidate: str) -> DataFrame:
    """scored with ``stratum``: candidate, band-top10, band-next20 or rest."""
    kind = F.when(F.col(candidate), "candidate")
    for n in CUTS:
        kind = kind.when(F.col("score") >= F.col(f"cut_{n}"), f"band-{n}")
    c = cuts(scored, candidate)
    return scored.crossJoin(F.broadcast(c)).withColumn("stratum", kind.otherwise("rest")).drop(*c.columns)


def top(scored: DataFrame, candidate: str, key: str, n: int = 15) -> DataFrame:
    """The n best rows that aren't candidates; ties by key."""
    return scored.where(~F.col(candidate)).orderBy(F.desc("score"), key).limit(n)


def auc(scored: DataFrame, positive: str, score: str = "score") -> DataFrame:
    """One row: the chance that a positive row scores higher than another, ties half.

    Exact and without one ordered pass over all rows: equal scores are counted, the counts fall into bins of about equal
    size, whatever the scores' spread, the bins' totals are summed up in order, and within a bin the scores are."""
    p = F.col(positive).cast("bigint")
    counts = scored.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.sum(p).alias("pos"), F.sum(1 - p).alias("neg"))
    binned = _binned(checkpointed(counts), "s")
    before = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = binned.groupBy("bin").agg(F.sum("neg").alias("n")).select("bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lower"))
    inside = Window.partitionBy("bin").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = binned.withColumn("within", F.coalesce(F.sum("neg").over(inside), F.lit(0))).join(F.broadcast(bins), "bin")
    won = F.sum(F.col("pos") * (F.col("lower") + F.col("within") + F.col("neg") / 2))
    return ranked.agg(F.try_divide(won, (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))


def with_outlet(vectors_of: DataFrame, documents: DataFrame, key: str, outlet: str) -> DataFrame:
    """Vectors with the outlet of their document; null where it isn't known. Of a key's several documents the smallest
    outlet is taken."""
    known = documents.groupBy(F.col(key).alias("_key")).agg(F.min(outlet).alias(outlet))
    return vectors_of.join(known, F.col(key) == F.col("_key"), "left").drop("_key")


def by_source(strata_of: DataFrame, source: str) -> DataFrame:
    return strata_of.groupBy(source, "stratum").agg(F.count("*").alias("n"), F.round(F.median("score"), 6).alias("median_score"))

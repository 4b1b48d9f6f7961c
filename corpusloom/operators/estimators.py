"""Agreement, and estimates from weighted samples."""

from __future__ import annotations

from fractions import Fraction
from functools import reduce
from math import exp, factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def alpha(values: DataFrame, unit: str, coder: str, value: str) -> DataFrame:
    """One row: Krippendorff's alpha for nominal values. Null with one value or none, 1 if there is one value only.

    A unit with m values adds count(a) * (count(b) - [a = b]) / (m - 1) to the coincidence of a and b, so counts of
    values do and no pairs of coders are made."""
    counts = values.where(F.col(value).isNotNull()).groupBy(F.col(unit).alias("u"), F.col(value).alias("v")).agg(F.count("*").alias("k"))
    whole = counts.withColumn("m", F.sum("k").over(Window.partitionBy("u"))).where("m > 1")
    by_value = whole.groupBy("v").agg(F.sum("k").alias("n_v"), F.sum(F.col("k") * (F.col("k") - 1) / (F.col("m") - 1)).alias("same"))
    n = F.sum("n_v")
    observed = n - F.sum("same")
    expected = (n * n - F.sum(F.col("n_v") * F.col("n_v"))) / F.nullif(n - 1, F.lit(0))
    return by_value.agg(F.when(n <= 1, F.lit(None)).when(expected == 0, F.lit(1.0)).otherwise(1 - observed / expected).cast("double").alias("alpha"), F.coalesce(n, F.lit(0)).alias("values"))


def precision_recall(df: DataFrame, by: list[str], predicted: str, gold: str, weight: str, overall: bool = False) -> DataFrame:
    """Weighted precision and recall by group; null where nothing is predicted or gold. With ``overall`` also a row for
    all, whose group is null (rows without a group are left out then)."""
    w, p, g = F.col(weight), F.col(predicted), F.col(gold)
    total = lambda c: F.coalesce(F.sum(F.when(c, w)), F.lit(0.0))
    if overall:
        grouped = df.na.drop(subset=by).groupingSets([[F.col(c) for c in by], []], *by)
    else:
        grouped = df.groupBy(*by)
    return grouped.agg(F.count("*").alias("n"), F.try_divide(total(p & g), total(p)).alias("precision"), F.try_divide(total(p & g), total(g)).alias("recall"))


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Ends of Wilson's interval, in [0, 1]; null for n = 0."""
    k = F.when(n > 0, n.cast("double"))
    p = successes / k
    middle, half = (p + z * z / (2 * k)) / (1 + z * z / k), z * F.sqrt(p * (1 - p) / k + z * z / (4 * k * k)) / (1 + z * z / k)
    return F.when(n > 0, F.greatest(F.lit(0.0), middle - half)), F.when(n > 0, F.least(F.lit(1.0), middle + half))


def extension(df: DataFrame, stratum: str, gold: str, weight: str, limit: float = 0.05) -> DataFrame:
    """Per stratum: its share of the weighted gold, and whether that is over the limit."""
    mass = df.groupBy(stratum).agg(F.coalesce(F.sum(F.when(F.col(gold), F.col(weight))), F.lit(0.0)).alias("mass"))
    share = F.coalesce(F.try_divide(F.col("mass"), F.sum("mass").over(Window.partitionBy())), F.lit(0.0))
    return mass.select(stratum, F.round(share, 6).alias("share"), (share > limit).alias("extend"))


def stability(first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """One row: keys in both runs, those that agree, their share with Wilson's interval."""
    both = first.select(key, F.col(value).alias("_a")).join(second.select(key, F.col(value).alias("_b")), key)
    counted = both.agg(F.count("*").alias("n"), F.count_if(F.col("_a") == F.col("_b")).alias("agree"))
    lo, hi = wilson(F.col("agree"), F.col("n"))
    return counted.select("n", "agree", F.try_divide(F.col("agree").cast("double"), F.col("n").cast("double")).alias("share"), lo.alias("low"), hi.alias("high"))


#: 2 ** 32 times the chances that a Poisson number of mean 1 is at most 0, 1, 2 and so on, as whole numbers.
POISSON = [int(sum(Fraction(1, factorial(i)) for i in range(k + 1)) * Fraction(exp(-1)) * 2**32) for k in range(13)]


def poisson(*parts: Column) -> Column:
    """A Poisson number of mean 1 that the parts' MD5 decides, the same in every engine."""
    drawn = F.conv(F.left(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), F.lit(8)), 16, 10).cast("bigint")
    return reduce(Column.__add__, [(drawn >= t).cast("int") for t in POISSON])


def _by_hash(df: DataFrame, predicted: Column, gold: Column, weight: Column, key: str, times: int, seed: int) -> DataFrame:
    """(precision, recall) of each replicate, a row of which counts as often as a Poisson number of (seed, replicate, key)
    says. Column expressions alone; tasks add replicates up before they are shuffled."""
    rows = df.select(predicted.alias("p"), gold.alias("g"), weight.alias("w"), F.col(key).alias("k"))
    drawn = rows.select("p", "g", "w", "k", F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("id")).withColumn("w", F.col("w") * poisson(F.lit(seed), F.col("id"), F.col("k")))
    sums = drawn.groupBy("id").agg(*[F.coalesce(F.sum(F.when(F.expr(c), F.col("w"))), F.lit(0.0)).alias(n) for n, c in (("both", "p AND g"), ("pred", "p"), ("all_gold", "g"))])
    every = df.sparkSession.range(times).join(sums, "id", "left")
    return every.select("id", F.try_divide("both", "pred").alias("precision"), F.try_divide("both", "all_gold").alias("recall"))


def bootstrap(df: DataFrame, cell: list[str], predicted: str, gold: str, weight: str, times: int = 2000, seed: int = 1, tasks: int = 32, key: str | None = None) -> DataFrame:
    """One row: 95 % intervals of weighted precision and recall.

    With a ``key`` (null or not) every row counts as often as a Poisson number that a hash of seed, replicate and key gives:
    nothing is drawn on the driver, and other engines draw the same. Without one, cells are resampled with replacement:
    rows of a cell that agree in prediction, gold and weight are alike, so Spark counts them, and a replicate draws how
    often each kind comes (multinomial, as many as the cell has rows). A copy of the counts goes to each task; weights
    belong to strata, so the kinds are few. Each replicate has a seed of its own, so results don't depend on the number
    of tasks."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    if key:
        return _intervals(_by_hash(df, yes(predicted), yes(gold), F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), key, times, seed))
    kinds = df.groupBy(F.concat_ws(":", *cell).alias("cell"), yes(predicted).alias("p"), yes(gold).alias("g"), F.coalesce(F.col(weight).cast("double"), F.lit(0.0)).alias("w")).agg(F.count("*").alias("n"))
    rows = kinds.orderBy("cell", "p", "g", "w").toPandas()
    cells = [(x.index.to_numpy(), int(x["n"].sum()), x["n"].to_numpy(float) / float(x["n"].sum())) for _, x in rows.groupby("cell")]
    p, g, w = rows["p"].to_numpy(bool), rows["g"].to_numpy(bool), rows["w"].to_numpy(float)

    def work(batches):
        for ids in batches:
            out = []
            for i in ids["id"]:
                rng = np.random.default_rng([seed, int(i)])
                drawn = np.zeros(len(w))
                for at, n, shares in cells:
                    drawn[at] = rng.multinomial(n, shares)
                both, pred, all_gold = (float((w * drawn)[m].sum()) for m in (p & g, p, g))
                out.append((int(i), both / pred if pred else None, both / all_gold if all_gold else None))
            yield pd.DataFrame(out, columns=["id", "precision", "recall"])

    return _intervals(df.sparkSession.range(0, times, 1, tasks).mapInPandas(work, "id long, precision double, recall double"))


def _intervals(runs: DataFrame) -> DataFrame:
    def ends(c: str) -> list[Column]:
        s, n = F.array_sort(F.collect_list(c)), F.count(c)
        low, high = F.floor(n * 0.025), F.floor(n * 0.975) - 1
        return [F.get(s, low.cast("int")).alias(f"{c}_low"), F.get(s, high.cast("int")).alias(f"{c}_high")]

    return runs.agg(*ends("precision"), *ends("recall"), F.count("*").alias("replicates"))

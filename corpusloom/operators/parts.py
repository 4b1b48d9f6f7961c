"""Upkeep of tables that grow by parts: what is to do, copies, renamed keys, rows that needn't be made again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import signature


def todo(df: DataFrame, done: DataFrame | None, key: str) -> DataFrame:
    """Rows whose key isn't done."""
    return df if done is None else df.join(done.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def deduped(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key in the order, which should leave no ties."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """One row: rows, different keys, rows too many."""
    return df.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("keys"), (F.count("*") - F.count_distinct(key)).alias("dropped"))


def reconcile(df: DataFrame, key: str, keep: DataFrame, remap: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """df with keys renamed by ``remap`` (old, new), only those in ``keep``, one row for each; a renamed row wins over
    one that has the key already. Left to right: left join, semi join, row number."""
    named = df.join(remap.select(F.col("old").alias(key), F.col("new").alias("_new")), key, "left")
    named = named.withColumn("_old", F.col(key)).withColumn(key, F.coalesce("_new", key)).join(keep.select(key).distinct(), key, "left_semi")
    w = Window.partitionBy(key).orderBy(F.col("_new").isNotNull().desc(), *(order or []), "_old")
    return named.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select(*df.columns)


def reconciled_counts(before: DataFrame, after: DataFrame, key: str, remap: DataFrame) -> DataFrame:
    """One row: rows after, rows of renamed keys among them, rows dropped."""
    names = remap.select(F.col("new").alias(key)).distinct().withColumn("_named", F.lit(1))
    counted = after.join(names, key, "left").agg(F.count("*").alias("rows"), F.count("_named").alias("remapped"))
    return counted.crossJoin(before.agg(F.count("*").alias("_all"))).select("rows", "remapped", (F.col("_all") - F.col("rows")).alias("dropped"))


def changes(now: DataFrame, before: DataFrame, key: str, of: list[str], error: str = "error") -> DataFrame:
    """(key, same): whether the columns ``of`` are what they were; rows with an error now are never the same."""
    old = before.select(key, signature(*[F.col(c) for c in of]).alias("_was"))
    new = now.select(key, signature(*[F.col(c) for c in of]).alias("_is"), F.col(error).isNotNull().alias("failed"))
    joined = new.join(old, key, "left")
    return joined.select(key, "failed", (F.col("_is").eqNullSafe(F.col("_was")) & ~F.col("failed")).alias("same"), F.col("_was").isNotNull().alias("known"))


def change_counts(changed: DataFrame) -> DataFrame:
    """One row: documents, unchanged, changed, errors."""
    return changed.agg(F.count("*").alias("documents"), F.count_if("same").alias("unchanged"), F.count_if(~F.col("same") & ~F.col("failed")).alias("changed"), F.count_if("failed").alias("errors"))


def carried(derived: DataFrame, changed: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Derived rows that hold still, without those that are there already."""
    return todo(derived.join(changed.where("same").select(key), key, "left_semi"), done, key)


def pruned(derived: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """Derived rows of keys whose source is there and is what it was."""
    return derived.join(changed.where("same").select(key), key, "left_semi")

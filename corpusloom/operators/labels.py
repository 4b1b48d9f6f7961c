"""Coders' labels: checks, the last word of each coder, majorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONFIDENCE = ("high", "medium", "low")


def error(in_scope: Column, clauses: Column, evidence: Column, confidence: Column, coder: Column, in_set: Column, allowed: Column | None = None, most_clause: int = 4) -> Column:
    """What is wrong with a label, by the first rule that it breaks; null if nothing is. ``in_set``: the article was
    drawn; ``allowed``: the article's coders, where articles are assigned."""
    odd = clauses.isNull() | F.exists(clauses, lambda c: c.isNull() | (c < 1) | (c > most_clause))
    chain = F.when(~F.coalesce(in_set, F.lit(False)), "not in the set")
    if allowed is not None:
        chain = chain.when(~F.coalesce(F.array_contains(allowed, coder), F.lit(False)), "not this coder's")
    return (
        chain.when(in_scope.isNull(), "in_scope is missing")
        .when(odd, "unknown clauses")
        .when(in_scope != (F.size(clauses) > 0), "clauses just when in scope")
        .when(in_scope & (F.coalesce(evidence, F.lit("")) == ""), "in scope without evidence")
        .when(~F.coalesce(confidence, F.lit("")).isin(*CONFIDENCE), "unknown confidence")
        .when(F.coalesce(coder, F.lit("")) == "", "no coder")
    )


def latest(labels: DataFrame, event: str, coder: str, time: str, line: str) -> DataFrame:
    """Each coder's last label of each article; of equal times the later line."""
    w = Window.partitionBy(event, coder).orderBy(F.col(time).desc(), F.col(line).desc())
    return labels.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def progress(labels: DataFrame, assigned: DataFrame, event: str, coder: str) -> DataFrame:
    """Per coder: articles assigned and labelled."""
    due = assigned.select(event, F.explode("coders").alias(coder))
    done = labels.select(event, coder, F.lit(1).alias("_done")).distinct()
    return due.join(done, [event, coder], "left").groupBy(coder).agg(F.count("*").alias("assigned"), F.count("_done").alias("labelled"))


def majority(labels: DataFrame, event: str, coder: str, in_scope: str, clauses: str, shared: str, least: int = 3) -> DataFrame:
    """(event, in_scope, clauses). Shared articles need ``least`` labels and are in scope with two votes for it; their
    clauses are those that two of the yes-votes name. Of others the label of the greatest coder counts."""
    votes = labels.where(shared).groupBy(event).agg(F.count("*").alias("_n"), F.count_if(F.col(in_scope)).alias("_yes"), F.flatten(F.collect_list(F.when(F.col(in_scope), F.array_distinct(clauses)))).alias("_named"))
    named = F.filter(F.sort_array(F.array_distinct("_named")), lambda c: F.size(F.filter("_named", lambda x: x == c)) >= 2)
    agreed = votes.where(F.col("_n") >= least).select(event, (F.col("_yes") >= 2).alias(in_scope), F.when(F.col("_yes") >= 2, named).otherwise(F.array().cast("array<int>")).alias(clauses))
    single = labels.where(~F.col(shared)).groupBy(event).agg(F.max_by(F.struct(in_scope, clauses), coder).alias("_l")).select(event, F.col(f"_l.{in_scope}").alias(in_scope), F.sort_array(F.array_distinct(f"_l.{clauses}")).alias(clauses))
    return agreed.unionByName(single)

"""An append-only log of what was fetched, with two times: when it was valid, and when it was recorded.

Columns by default: event_id, kind ("insert" or "delete"), unit_id, valid_time, ingest_time, content_sha256, attrs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(log: DataFrame, moment, clock: str = "ingest_time") -> DataFrame:
    """What was recorded by then."""
    return log.where(F.col(clock) <= F.lit(moment))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of each key the row that comes last in the order. Spark keeps one row of each key before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def current(log: DataFrame, unit: str = "unit_id", time: str = "ingest_time", tie: str = "event_id", kind: str = "kind") -> DataFrame:
    """Of each unit the insert recorded last."""
    return latest(log.where(F.col(kind) == "insert"), [unit], [F.col(time), F.col(tie)])


def current_events(log: DataFrame, unit: str = "unit_id", time: str = "ingest_time", tie: str = "event_id", kind: str = "kind") -> DataFrame:
    """Current inserts, and all that isn't an insert."""
    return current(log, unit, time, tie, kind).unionByName(log.where(F.col(kind) != "insert"))


def latest_outcome(attempts: DataFrame, key: str, outcome: str, time: str) -> DataFrame:
    return attempts.groupBy(key).agg(F.max_by(outcome, time).alias("outcome"))


def kind_counts(log: DataFrame, kind: str = "kind") -> DataFrame:
    return log.groupBy(kind).agg(F.count("*").alias("n"))


def gone(log: DataFrame, unit: str = "unit_id", time: str = "ingest_time", tie: str = "event_id", kind: str = "kind") -> DataFrame:
    """Of units that were never inserted, the delete recorded first."""
    inserted = log.where(F.col(kind) == "insert").select(unit).distinct()
    deletes = log.where(F.col(kind) == "delete").join(inserted, unit, "left_anti")
    w = Window.partitionBy(unit).orderBy(time, tie)
    return deletes.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def objects(log: DataFrame, stored: DataFrame, sha: str = "content_sha256", content: str = "content") -> DataFrame:
    """log with the stored object of each hash: ``content``, and ``state``: found, missing, or changed (what is stored
    under the hash has another one; it is not returned). Objects are stored by hash, so copies are one object; of several
    under a hash the smallest counts."""
    one = stored.where(F.col(sha).isNotNull()).groupBy(F.col(sha).alias("_sha")).agg(F.min(content).alias("_content"))
    rows = log.join(one, F.col(sha) == F.col("_sha"), "left")
    whole = F.sha2(F.col("_content").cast("binary"), 256) == F.col(sha)
    return rows.withColumn("state", F.when(F.col("_content").isNull(), "missing").when(whole, "found").otherwise("changed")).withColumn(content, F.when(F.col("state") == "found", F.col("_content"))).drop("_sha", "_content")


def corrections(log: DataFrame, pages: DataFrame, new_time: Column, pass_id: str, moment) -> DataFrame:
    """New inserts for current ones whose page says another date than was recorded. ``pages`` has content_sha256 and
    what ``new_time`` reads; rows dated by their page are left alone."""
    c = current(log).where((F.coalesce(F.col("attrs")["pub_date_source"], F.lit("")) != "page") & F.col("content_sha256").isNotNull())
    joined = c.join(pages.withColumn("_new", new_time).select("content_sha256", "_new"), "content_sha256").where(F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col("valid_time")))
    changed = F.map_concat(F.map_filter(F.coalesce("attrs", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin("pub_date_source", "corrects")), F.create_map(F.lit("pub_date_source"), F.lit("page"), F.lit("corrects"), F.col("event_id")))
    event = F.sha2(F.concat_ws("|", F.lit(pass_id), "unit_id", F.col("_new").cast("string")), 256)
    out = joined.select(*[c for c in log.columns if c not in ("event_id", "valid_time", "ingest_time", "attrs", "pass_id")], event.alias("event_id"), F.col("_new").alias("valid_time"), F.lit(moment).cast("timestamp").alias("ingest_time"), changed.alias("attrs"), F.lit(pass_id).alias("pass_id"))
    return out.select(*[c for c in log.columns])


def status(dated_out: Column, is_gone: Column, excluded: Column, error: Column) -> Column:
    """dated_out, gone, excluded_section, no_text:<error> or article, whichever comes first."""
    return F.when(F.coalesce(dated_out, F.lit(False)), "dated_out").when(F.coalesce(is_gone, F.lit(False)), "gone").when(F.coalesce(excluded, F.lit(False)), "excluded_section").when(error.isNotNull(), F.concat(F.lit("no_text:"), error)).otherwise("article")

"""How much of each outlet's days is covered."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import urls
from corpusloom.operators import log as lg

MEASURES = ["discovered", "fetched", "dated_out", "gone", "failed"]


def grid(outlets: DataFrame, outlet: str, first: date, last: date) -> DataFrame:
    """Every outlet on every day."""
    return outlets.select(outlet).distinct().select(outlet, F.explode(F.sequence(F.lit(first), F.lit(last), F.expr("interval 1 day"))).alias("day"))


def facts(found: DataFrame, log: DataFrame, attempts: DataFrame, first: date, last: date) -> DataFrame:
    """(outlet_id, day, measure), a row for each fact about the pages of ``found`` (url, outlet_id, day).

    Fetched pages count on the day that they were dated to; those dated out of the window, gone (deleted, or led to
    another page) or failed (by the last attempt, and not in the log) on the day that they were found."""
    pages = found.select("url", "outlet_id", "day")
    inside = F.to_date("valid_time").between(F.lit(first), F.lit(last))
    events = lg.current_events(log).where(F.col("kind").isin("insert", "delete")).select(F.col("unit_id").alias("url"), "kind", "valid_time", F.col("attrs")["final_url"].alias("final"))
    known = pages.join(events, "url")
    insert = F.col("kind") == "insert"
    measure = F.when(~insert | urls.soft_404(F.col("url"), F.col("final")), "gone").when(inside, "fetched").otherwise("dated_out")
    logged = known.withColumn("measure", measure).select("outlet_id", F.when(F.col("measure") == "fetched", F.to_date("valid_time")).otherwise(F.col("day")).alias("day"), "measure")
    last_tries = lg.latest_outcome(attempts, "url", "outcome", "attempted_at").where("outcome NOT IN ('stored', 'gone')")
    failed = pages.join(last_tries, "url", "left_semi").join(events.select("url").distinct(), "url", "left_anti").select("outlet_id", "day", F.lit("failed").alias("measure"))
    return pages.select("outlet_id", "day", F.lit("discovered").alias("measure")).unionByName(logged).unionByName(failed)


def cells(facts: DataFrame, outlet: str, first: date, last: date, outlets: DataFrame | None = None, expected: DataFrame | None = None) -> DataFrame:
    """A row for every outlet and day with the number of facts (outlet, day, measure) of each measure, zeros included,
    and ``expected`` (0 where it isn't known)."""
    counted = facts.where(F.col("day").between(F.lit(first), F.lit(last))).groupBy(outlet, "day").pivot("measure", MEASURES).count()
    full = grid(facts if outlets is None else outlets, outlet, first, last).join(counted, [outlet, "day"], "left").na.fill(0, MEASURES)
    if expected is None:
        return full.withColumn("expected", F.lit(0).cast("bigint"))
    return full.join(expected.select(outlet, F.col("expected").cast("bigint")), outlet, "left").na.fill(0, ["expected"])


def summary(cell: DataFrame, outlet: str) -> DataFrame:
    """Sums by outlet, days, days without discovery, share fetched and share expected."""
    sums = cell.groupBy(outlet).agg(*[F.sum(m).alias(m) for m in MEASURES], F.sum("expected").alias("expected"), F.count("*").alias("days"), F.count_if(F.col("discovered") == 0).alias("days_without_discovery"))
    share = lambda a, b, n: F.coalesce(F.round(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), n), F.lit(0.0))
    return sums.withColumn("discovered_vs_expected", share("discovered", "expected", 2)).withColumn("fetched_share", share("fetched", "discovered", 3))

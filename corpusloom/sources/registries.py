"""Small tables that people write: outlets, search terms, rules, routes; and tables in lines of JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import stripped

OUTLETS = ("outlet_id", "name", "domains", "basis", "rules_version")


def csv(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """A CSV file with a head line; quotes inside quotes are doubled. Values are stripped, null is empty; rows with an
    empty ``key`` are left out."""
    rows = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, encoding="UTF-8")
    rows = rows.select(*[stripped(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(c.strip()) for c in rows.columns])
    return rows.where(F.col(key) != "") if key else rows


def _hosts(text):
    plain = F.transform(F.split(F.lower(text), r"\s+"), lambda h: F.regexp_replace(h, r"^www\.", ""))
    return F.filter(plain, lambda h: h != "")


def outlets(spark: SparkSession, path: str, collected_only: bool = False) -> DataFrame:
    """(outlet_id, name, domains, exclude_hosts, basis, rules_version, collect). An error if a row lacks what it must have."""
    rows = csv(spark, path, "outlet_id")
    for c in ("exclude_hosts", "collect"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(""))
    lacking = rows.select("outlet_id", F.filter(F.array(*[F.when(F.col(c) == "", F.lit(c)) for c in OUTLETS]), lambda x: x.isNotNull()).alias("lacks")).where(F.size("lacks") > 0).first()
    if lacking:
        raise ValueError(f"{path}: outlet {lacking['outlet_id']} lacks {lacking['lacks']}")
    out = rows.select("outlet_id", "name", _hosts(F.col("domains")).alias("domains"), _hosts(F.col("exclude_hosts")).alias("exclude_hosts"), "basis", "rules_version", F.lower("collect").isin("", "yes").alias("collect"))
    return out.where("collect") if collected_only else out


def terms(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(list, term) of a file of search terms, in its order."""
    rows = csv(spark, path, "list").select("list", "term").withColumn("i", F.monotonically_increasing_id())
    return [(r["list"], r["term"]) for r in rows.orderBy("i").collect()]


def sections(spark: SparkSession, path: str) -> DataFrame:
    """(outlet_id, segment, host, reason) of pages that are no news."""
    return csv(spark, path, "outlet_id").select("outlet_id", "segment", "host", "reason")


def rule_table(spark: SparkSession, path: str) -> DataFrame:
    """(outlet_id, rule, values) of a file of rules, values in its order (patterns keep their blanks)."""
    rows = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    rows = rows.select(stripped("outlet_id").alias("outlet_id"), stripped("rule").alias("rule"), F.struct(F.monotonically_increasing_id().alias("line"), F.coalesce("value", F.lit("")).alias("value")).alias("v"))
    return rows.where("outlet_id <> ''").groupBy("outlet_id", "rule").agg(F.array_sort(F.collect_list("v"))["value"].alias("values"))


def line_rules(spark: SparkSession, path: str) -> dict[str, dict[str, list[str]]]:
    """Outlet to rule to values."""
    by_outlet = rule_table(spark, path).groupBy("outlet_id").agg(F.map_from_entries(F.collect_list(F.struct("rule", "values"))).alias("rules"))
    return {r["outlet_id"]: r["rules"] for r in by_outlet.collect()}


def routes(spark: SparkSession, path: str) -> DataFrame:
    """(outlet_id, route, source, include)."""
    return csv(spark, path, "outlet_id").select("outlet_id", "route", "source", "include")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A row for each line that isn't empty."""
    return spark.read.schema(schema).json(path)

"""What leaves the house: an index of pages, the scope of each, and whether pages are still what they were."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.functions import urls
from corpusloom.operators import log as lg
from corpusloom.operators.discovery import nonnews

#: Strata that the classifier reads.
READ = ("candidate", "band-top10")
INDEX = ("event_id", "url", "final_url", "outlet_id", "status", "published_at", "date_source", "fetched_at", "discovered_via", "page_sha256", "body_sha256", "body_chars", "extractor")


def _stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def index(log: DataFrame, docs: DataFrame, rules: DataFrame, in_window: Column) -> DataFrame:
    """A row for every unit of the log: current inserts with their status, and units that only were deleted as gone.
    ``in_window`` reads the log's columns; ``docs`` has event_id, body_hash, n_chars, extractor, error."""
    a = F.col("attrs")
    d = docs.select("event_id", "body_hash", "n_chars", "extractor", "error")
    rows = lg.current(log).withColumn("_in", in_window).withColumn("outlet_id", a["outlet_id"]).join(d, "event_id", "left")
    rows = nonnews(rows, "unit_id", "outlet_id", rules, "_reason")
    gone = urls.soft_404(F.col("unit_id"), a["final_url"]) | F.coalesce(F.col("error").startswith("soft_404"), F.lit(False))
    status = lg.status(~F.col("_in"), gone, F.col("_reason").isNotNull(), F.col("error"))
    inserts = rows.select(
        "event_id", F.col("unit_id").alias("url"), a["final_url"].alias("final_url"), "outlet_id", status.alias("status"), _stamp(F.col("valid_time")).alias("published_at"), a["pub_date_source"].alias("date_source"), _stamp(F.col("ingest_time")).alias("fetched_at"), a["discovered_via"].alias("discovered_via"),
        F.col("content_sha256").alias("page_sha256"), F.col("body_hash").alias("body_sha256"), F.col("n_chars").alias("body_chars"), "extractor",
    )
    none = F.lit(None)
    deletes = lg.gone(log).select(
        "event_id", F.col("unit_id").alias("url"), none.cast("string").alias("final_url"), a["outlet_id"].alias("outlet_id"), F.lit("gone").alias("status"), _stamp(F.col("valid_time")).alias("published_at"), a["pub_date_source"].alias("date_source"), _stamp(F.col("ingest_time")).alias("fetched_at"), a["discovered_via"].alias("discovered_via"),
        *[none.cast(inserts.schema[c].dataType).alias(c) for c in ("page_sha256", "body_sha256", "body_chars", "extractor")],
    )
    return inserts.unionByName(deletes)


def scope(lexicon: DataFrame, band: DataFrame, decisions: DataFrame, articles: DataFrame, lists: list[str]) -> DataFrame:
    """A row for each article of the lexicon's: hits, band, the classifier's decision where it reads, and in_scope.
    ``decisions`` (event_id, status, in_scope, clauses, evidence, confidence) counts where it succeeded; ``articles``
    has the event ids of the index's articles."""
    hits = [f"hit_{x}" for x in lists]
    rows = lexicon.join(articles.select("event_id").distinct(), "event_id", "left_semi").select("event_id", F.col("candidate").alias("lexicon_candidate"), *hits)
    rows = rows.join(band.select("event_id", F.col("score").alias("band_score"), F.col("stratum").alias("band_stratum")), "event_id", "left")
    made = decisions.where("status = 'succeeded'").groupBy("event_id").agg(F.max(F.struct("in_scope", "clauses", "evidence", "confidence")).alias("d"))
    rows = rows.join(made, "event_id", "left")
    read = F.coalesce(F.col("band_stratum").isin(*READ), F.lit(False)) & F.col("d").isNotNull()
    d = F.col("d")
    return rows.select(
        "event_id", "lexicon_candidate", *hits, "band_score", "band_stratum", read.alias("classified"), d["in_scope"].alias("classifier_in_scope"), d["clauses"].alias("classifier_clauses"), tx.evidence_pointers(d["evidence"]).alias("classifier_evidence"), d["confidence"].alias("classifier_confidence"),
        (read & F.coalesce(d["in_scope"], F.lit(False))).alias("in_scope"),
    )


def outcome(status: Column, stored_hash: Column, found_hash: Column, same: str = "unchanged", other: str = "edited") -> Column:
    """gone, failed, ``same`` or ``other``: what became of a page that was asked for again."""
    return F.when(status.isin(404, 410), "gone").when(F.coalesce(status != 200, F.lit(True)), "failed").when(stored_hash.eqNullSafe(found_hash), same).otherwise(other)


def verified(stored: DataFrame, fetched: DataFrame, key: str = "event_id") -> DataFrame:
    """(key, outlet_id, status, outcome, similarity) of pages asked for again. ``stored`` has body and body_hash,
    ``fetched`` status, body and body_hash; similarity is given for edited pages only."""
    new = fetched.select(key, F.col("status").alias("status"), F.col("body").alias("_new"), F.col("body_hash").alias("_hash"))
    rows = stored.join(new, key).withColumn("outcome", outcome(F.col("status"), F.col("body_hash"), F.col("_hash")))
    edited = F.when(F.col("outcome") == "edited", F.col("body"))
    return rows.select(key, "outlet_id", "status", "outcome", F.round(tx.similarity(edited, F.col("_new")), 4).alias("similarity"))


def to_rebuild(pages: DataFrame, scoped: DataFrame | None = None, outlets: list[str] | None = None, done: DataFrame | None = None) -> DataFrame:
    """Articles whose texts are to be fetched again: all, those in scope, those of some outlets; without those done."""
    rows = pages.where("status = 'article'").select("event_id", "url", "outlet_id", "body_sha256")
    if scoped is not None:
        rows = rows.join(scoped.where("in_scope").select("event_id").distinct(), "event_id", "left_semi")
    if outlets is not None:
        rows = rows.where(F.col("outlet_id").isin(outlets))
    return rows if done is None else rows.join(done.select("event_id").distinct(), "event_id", "left_anti")


def counts(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n"))

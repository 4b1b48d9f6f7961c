"""Queries over the log, discovery, coverage and upkeep. The events table stands in for a log: a user is a unit, an error
a delete, any other event an insert."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F

from corpusloom.operators import coverage, discovery, parts, release
from corpusloom.operators import log as lg
from corpusloom.session import load, work_folder
from corpusloom.streaming import log as stream

FIRST, LAST = date(2024, 1, 5), date(2024, 1, 25)


def log(spark, sf):
    e = load(spark, sf, "events")
    return e.select("event_id", F.when(F.col("event_type") == "error", "delete").otherwise("insert").alias("kind"), F.col("user_id").alias("unit_id"), F.col("ts").cast("timestamp").alias("ingest_time"), "event_type")


def current_inserts(spark, sf):
    return lg.current(log(spark, sf)).select("unit_id", "event_id")


def current_events(spark, sf):
    return lg.current_events(log(spark, sf)).groupBy("kind").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def as_of_snapshot(spark, sf):
    return lg.current(lg.as_of(log(spark, sf), F.lit("2024-01-15 12:00:00").cast("timestamp"))).select("unit_id", "event_id")


def units_only_deleted(spark, sf):
    """By unit and day, so that there are some."""
    rows = log(spark, sf).withColumn("unit_id", F.concat_ws("/", "unit_id", F.to_date("ingest_time").cast("string")))
    return lg.gone(rows).select("unit_id", "event_id")


def latest_outcome(spark, sf):
    return lg.latest_outcome(log(spark, sf), "unit_id", "event_type", "ingest_time")


def kind_counts(spark, sf):
    return lg.kind_counts(log(spark, sf))


def window_counts(spark, sf):
    from corpusloom.functions.dates import within

    return log(spark, sf).where(within(F.col("ingest_time"), FIRST, LAST)).groupBy("kind").agg(F.count("*").alias("n"))


def _routes(spark, sf):
    pages = load(spark, sf, "pages").select(F.lit("sitemap").alias("route"), "url", F.lit("h").alias("host"), F.expr("date_add(DATE'2024-01-01', cast(page_id % 31 AS int))").alias("day"))
    feed = load(spark, sf, "pages").where("page_id % 3 = 0").select(F.lit("feed").alias("route"), "url", F.lit("g").alias("host"), F.expr("timestamp'2024-01-01 06:00:00' + make_dt_interval(cast(page_id % 40 AS int))").alias("pub_date"), F.concat(F.lit("t"), F.col("page_id").cast("string")).alias("title"))
    return discovery.union_dedupe(discovery.union_routes([pages, feed]), FIRST, LAST)


def discovery_union(spark, sf):
    return _routes(spark, sf).select("url", "host", F.date_format("pub_date", "yyyy-MM-dd HH:mm").alias("published"), F.col("day").cast("string").alias("day"), "title", "routes")


def _facts(spark, sf):
    return log(spark, sf).select((F.col("unit_id") % 9).alias("outlet_id"), F.to_date("ingest_time").alias("day"), F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "discovered").otherwise("fetched").alias("measure"))


def coverage_grid(spark, sf):
    return coverage.cells(_facts(spark, sf), "outlet_id", FIRST, LAST).withColumn("day", F.col("day").cast("string"))


def coverage_summary(spark, sf):
    expected = spark.range(9).select(F.col("id").alias("outlet_id"), (10 + F.col("id")).alias("expected"))
    c = coverage.summary(coverage.cells(_facts(spark, sf), "outlet_id", FIRST, LAST, expected=expected), "outlet_id")
    return c.select("outlet_id", *coverage.MEASURES, "expected", "days", "days_without_discovery", "discovered_vs_expected", "fetched_share")


def incremental_todo(spark, sf):
    return parts.todo(load(spark, sf, "documents"), load(spark, sf, "labels"), "doc_id").select("doc_id")


def repeated_keys(spark, sf):
    return parts.duplicates(load(spark, sf, "conversations"), "conv_id")


def first_of_key(spark, sf):
    return parts.deduped(load(spark, sf, "conversations"), "conv_id", [F.col("turn").desc(), F.col("text")]).select("conv_id", "turn", "role")


def _remap(spark, sf):
    ids = load(spark, sf, "documents").select("doc_id")
    return ids.where("doc_id % 10 = 0").select(F.col("doc_id").alias("old"), (F.col("doc_id") + 5).alias("new")), ids.where("doc_id % 4 <> 1")


def reconcile(spark, sf):
    remap, keep = _remap(spark, sf)
    return parts.reconcile(load(spark, sf, "documents").select("doc_id", "source", "n_chars"), "doc_id", keep, remap)


def reconcile_counts(spark, sf):
    remap, _ = _remap(spark, sf)
    return parts.reconciled_counts(load(spark, sf, "documents"), reconcile(spark, sf), "doc_id", remap)


def _changes(spark, sf):
    """Documents beside an earlier version, in which some texts differ and some are missing; some fail now."""
    d = load(spark, sf, "documents").select("doc_id", "source", "text")
    before = d.where("doc_id % 11 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.upper("text")).otherwise(F.col("text")))
    now = d.withColumn("error", F.when(F.col("doc_id") % 13 == 0, "no text"))
    return parts.changes(now, before, "doc_id", ["source", "text"])


def carryover_stats(spark, sf):
    return parts.change_counts(_changes(spark, sf))


def carryover_rows(spark, sf):
    derived = load(spark, sf, "labels").select("doc_id", "quality")
    return parts.carried(derived, _changes(spark, sf), derived.where("doc_id % 2 = 0"), "doc_id")


def carryover_kept(spark, sf):
    return parts.pruned(load(spark, sf, "labels").select("doc_id", "quality"), _changes(spark, sf), "doc_id")


def to_rebuild(spark, sf):
    d = load(spark, sf, "documents").select(F.col("doc_id").alias("event_id"), F.lit("u").alias("url"), F.col("source").alias("outlet_id"), F.lit("h").alias("body_sha256"), F.when(F.col("lang") == "en", "article").otherwise("gone").alias("status"))
    scoped = load(spark, sf, "labels").select(F.col("doc_id").alias("event_id"), (F.col("quality") == 1).alias("in_scope"))
    return release.to_rebuild(d, scoped, [f"src{i}" for i in range(7)]).select("event_id", "outlet_id")


def _curve(spark, sf):
    return discovery.calibration(load(spark, sf, "events").withColumn("d", F.to_date("ts")), "event_id", "d")


def calibration_curve(spark, sf):
    return _curve(spark, sf).select(F.col("day").cast("string").alias("day"), F.col("id").alias("median_id"))


def day_of_number(spark, sf):
    numbers = load(spark, sf, "documents").select("doc_id", (F.col("doc_id") * 37 % 12007).alias("number"))
    return discovery.day_of(numbers, "number", _curve(spark, sf)).select("doc_id", F.col("day").cast("string").alias("day"))


def number_bounds(spark, sf):
    return discovery.bounds(_curve(spark, sf), date(2024, 1, 10), date(2024, 1, 28))


def probe_ids(spark, sf):
    """Ids between the smallest and the largest labelled one that have no label."""
    l = load(spark, sf, "labels")
    lo, hi = l.agg(F.min("doc_id"), F.max("doc_id")).first()
    return discovery.numbers_to_probe(spark, lo, hi, l, "doc_id").select("id")


def release_index(spark, sf):
    """Index rows by status: of current inserts, and of units that only were deleted."""
    rows = log(spark, sf).withColumn("unit_id", F.concat(F.lit("https://x.org/"), F.when(F.col("unit_id") % 4 == 0, "sport/").otherwise("news/"), (F.col("unit_id") * 1000 + F.dayofmonth("ingest_time")).cast("string")))
    attrs = F.create_map(F.lit("outlet_id"), F.lit("o"), F.lit("final_url"), F.when(F.col("event_id") % 6 == 0, "https://x.org/news/").otherwise(F.col("unit_id")))
    rows = rows.select("event_id", "kind", "unit_id", F.col("ingest_time").alias("valid_time"), "ingest_time", F.lit("s").alias("content_sha256"), attrs.alias("attrs"))
    docs = load(spark, sf, "events").select("event_id", F.lit("h").alias("body_hash"), F.lit(1).alias("n_chars"), F.lit("e").alias("extractor"), F.when(F.col("event_id") % 10 == 1, "empty").alias("error"))
    rules = spark.createDataFrame([("o", "sport", "", "sport")], "outlet_id string, segment string, host string, reason string")
    index = release.index(rows, docs, rules, F.to_date("valid_time").between(F.lit(FIRST), F.lit(LAST)))
    return index.groupBy("status").agg(F.count("*").alias("n"), F.count("body_sha256").alias("with_body"))


def stream_daily_counts(spark, sf):
    """The events as a stream: rows of each day and type, written once the day is over for the watermark."""
    schema = load(spark, sf, "events").schema
    rows = stream.read(spark, f"{sf}/events.parque[t]", schema).withColumn("ts", F.col("ts").cast("timestamp"))
    out = f"{work_folder(spark)}/stream-{uuid.uuid4().hex}"
    query = stream.append_once(stream.windowed_counts(rows, "ts", ["event_type"], delay="0 seconds"), f"{out}/rows", f"{out}/checkpoint")
    query.awaitTermination()
    return spark.read.parquet(f"{out}/rows").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


QUERIES = {
    f.__name__: f
    for f in (
        current_inserts, current_events, as_of_snapshot, units_only_deleted, latest_outcome, kind_counts, window_counts, discovery_union, coverage_grid, coverage_summary, incremental_todo, repeated_keys, first_of_key,
        reconcile, reconcile_counts, carryover_stats, carryover_rows, carryover_kept, to_rebuild, calibration_curve, day_of_number, number_bounds, probe_ids, release_index, stream_daily_counts,
    )
}

L = "WITH g AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'insert' END AS kind, user_id AS unit_id, ts, event_type FROM events) "
_LATEST = "SELECT unit_id, arg_max(event_id, (ts, event_id)) AS event_id FROM g WHERE kind = 'insert'{} GROUP BY unit_id"
DAYS = f"BETWEEN DATE '{FIRST}' AND DATE '{LAST}'"
FACTS = "WITH f AS (SELECT user_id % 9 AS outlet_id, CAST(ts AS DATE) AS day, CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'discovered' ELSE 'fetched' END AS m FROM events), "
CELLS = (
    FACTS
    + f"""o AS (SELECT DISTINCT outlet_id FROM f), d AS (SELECT CAST(unnest(generate_series(DATE '{FIRST}', DATE '{LAST}', INTERVAL 1 DAY)) AS DATE) AS day),
      c AS (SELECT outlet_id, day, {', '.join(f"count(*) FILTER (m = '{m}') AS {m}" for m in coverage.MEASURES)} FROM o CROSS JOIN d LEFT JOIN f USING (outlet_id, day) GROUP BY outlet_id, day) """
)
REMAPPED = """WITH n AS (SELECT CASE WHEN doc_id % 10 = 0 THEN doc_id + 5 ELSE doc_id END AS id, doc_id % 10 = 0 AS renamed, doc_id AS old, source, n_chars FROM documents),
  k AS (SELECT * FROM n WHERE id IN (SELECT doc_id FROM documents WHERE doc_id % 4 <> 1)), r AS (SELECT id AS doc_id, source, n_chars, renamed FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY renamed DESC, old) AS k FROM k) WHERE k = 1) """
CHANGED = """WITH c AS (SELECT doc_id, doc_id % 13 = 0 AS failed, doc_id % 11 <> 0 AND doc_id % 13 <> 0 AND (CASE WHEN doc_id % 5 = 0 THEN upper(text) ELSE text END) = text AS same FROM documents) """
CURVE = """WITH d AS (SELECT CAST(ts AS DATE) AS day, list_sort(list(event_id)) AS ids FROM events GROUP BY 1), c AS (SELECT day, max(ids[len(ids) // 2 + 1]) OVER (ORDER BY day) AS id FROM d) """
ORACLE_SQL = {
    "current_inserts": L + _LATEST.format(""),
    "current_events": L + "SELECT kind, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM (SELECT * FROM g QUALIFY kind <> 'insert' OR row_number() OVER (PARTITION BY unit_id, kind ORDER BY ts DESC, event_id DESC) = 1) GROUP BY kind",
    "as_of_snapshot": L + _LATEST.format(" AND ts <= TIMESTAMP '2024-01-15 12:00:00'"),
    "units_only_deleted": L + ", u AS (SELECT *, unit_id || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS u FROM g) SELECT u AS unit_id, arg_min(event_id, (ts, event_id)) AS event_id FROM u GROUP BY u HAVING count_if(kind = 'insert') = 0",
    "latest_outcome": L + "SELECT unit_id, arg_max(event_type, ts) AS outcome FROM g GROUP BY unit_id",
    "kind_counts": L + "SELECT kind, count(*) AS n FROM g GROUP BY kind",
    "window_counts": L + f"SELECT kind, count(*) AS n FROM g WHERE CAST(ts AS DATE) {DAYS} GROUP BY kind",
    "discovery_union": f"""WITH r AS (SELECT 'sitemap' AS route, url, 'h' AS host, DATE '2024-01-01' + CAST(page_id % 31 AS INT) AS day, NULL::TIMESTAMP AS pub_date, NULL AS title FROM pages
      UNION ALL SELECT 'feed', url, 'g', NULL, TIMESTAMP '2024-01-01 06:00:00' + to_days(CAST(page_id % 40 AS INT)), 't' || page_id FROM pages WHERE page_id % 3 = 0)
      SELECT url, min(host) AS host, strftime(min(pub_date), '%Y-%m-%d %H:%M') AS published, CAST(min(day) AS VARCHAR) AS day, min(title) AS title, string_agg(DISTINCT route, ',' ORDER BY route) AS routes FROM r GROUP BY url HAVING coalesce(CAST(min(pub_date) AS DATE), min(day)) {DAYS}""",
    "coverage_grid": CELLS + f"SELECT outlet_id, CAST(day AS VARCHAR) AS day, {', '.join(coverage.MEASURES)}, CAST(0 AS BIGINT) AS expected FROM c",
    "coverage_summary": CELLS
    + f""", s AS (SELECT outlet_id, {', '.join(f'CAST(sum({m}) AS BIGINT) AS {m}' for m in coverage.MEASURES)}, count(*) * (10 + outlet_id) AS expected, count(*) AS days, CAST(count_if(discovered = 0) AS BIGINT) AS days_without_discovery FROM c GROUP BY outlet_id)
      SELECT *, coalesce(round(discovered / expected, 2), 0) AS discovered_vs_expected, coalesce(round(fetched / nullif(discovered, 0), 3), 0) AS fetched_share FROM s""",
    "incremental_todo": "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "repeated_keys": "SELECT count(*) AS rows, count(DISTINCT conv_id) AS keys, count(*) - count(DISTINCT conv_id) AS dropped FROM conversations",
    "first_of_key": "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text) AS k FROM conversations) WHERE k = 1",
    "reconcile": REMAPPED + "SELECT doc_id, source, n_chars FROM r",
    "reconcile_counts": REMAPPED + "SELECT count(*) AS rows, CAST(count_if(doc_id IN (SELECT doc_id + 5 FROM documents WHERE doc_id % 10 = 0)) AS BIGINT) AS remapped, (SELECT count(*) FROM documents) - count(*) AS dropped FROM r",
    "carryover_stats": CHANGED + "SELECT count(*) AS documents, CAST(count_if(same) AS BIGINT) AS unchanged, CAST(count_if(NOT same AND NOT failed) AS BIGINT) AS changed, CAST(count_if(failed) AS BIGINT) AS errors FROM c",
    "carryover_rows": CHANGED + "SELECT doc_id, quality FROM labels JOIN c USING (doc_id) WHERE same AND doc_id % 2 <> 0",
    "carryover_kept": CHANGED + "SELECT doc_id, quality FROM labels JOIN c USING (doc_id) WHERE same",
    "to_rebuild": "SELECT doc_id AS event_id, source AS outlet_id FROM documents WHERE lang = 'en' AND source IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5', 'src6') AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "calibration_curve": CURVE + "SELECT CAST(day AS VARCHAR) AS day, id AS median_id FROM c",
    "day_of_number": CURVE
    + """, e AS (SELECT min(id) AS i0, max(id) AS i1, min(day) AS d0, max(day) AS d1, (max(id) - min(id)) / greatest(1, max(day) - min(day)) AS rate FROM c),
      k AS (SELECT id, min(day) AS a, max(day) AS z FROM c GROUP BY id), s AS (SELECT lag(id) OVER (ORDER BY id) AS lo, lag(z) OVER (ORDER BY id) AS dlo, id AS hi, a AS dhi FROM k), n AS (SELECT doc_id, doc_id * 37 % 12007 AS x FROM documents)
      SELECT doc_id, CAST(CASE WHEN x <= i0 THEN d0 + CAST(round_even((x - i0) / rate, 0) AS INT) WHEN x > i1 THEN d1 + CAST(round_even((x - i1) / rate, 0) AS INT)
        ELSE DATE '1970-01-01' + CAST(round_even((dlo - DATE '1970-01-01') + 719163 + (dhi - dlo) * (x - lo) / (hi - lo), 0) - 719163 AS INT) END AS VARCHAR) AS day FROM n CROSS JOIN e LEFT JOIN s ON x > lo AND x <= hi""",
    "number_bounds": CURVE
    + """, e AS (SELECT min(id) AS i0, max(id) AS i1, min(day) AS d0, max(day) AS d1, (max(id) - min(id)) / greatest(1, max(day) - min(day)) AS rate FROM c),
      b AS (SELECT arg_max(id, day) FILTER (day <= DATE '2024-01-07') AS b, max(day) FILTER (day <= DATE '2024-01-07') AS bd, arg_min(id, day) FILTER (day >= DATE '2024-01-31') AS a, min(day) FILTER (day >= DATE '2024-01-31') AS ad FROM c)
      SELECT CAST(round_even(coalesce(b, i0) - rate * greatest(0, coalesce(bd, d0) - DATE '2024-01-07'), 0) AS BIGINT) AS lo, CAST(round_even(coalesce(a, i1) + rate * greatest(0, DATE '2024-01-31' - coalesce(ad, d1)), 0) AS BIGINT) AS hi FROM b, e""",
    "probe_ids": "SELECT id FROM (SELECT unnest(generate_series(min(doc_id), max(doc_id))) AS id FROM labels) WHERE id NOT IN (SELECT doc_id FROM labels)",
    "release_index": L
    + f""", u AS (SELECT *, 'https://x.org/' || CASE WHEN unit_id % 4 = 0 THEN 'sport/' ELSE 'news/' END || (unit_id * 1000 + day(ts)) AS u, unit_id * 1000 + day(ts) AS no FROM g),
      i AS (SELECT u, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(CAST(ts AS DATE), (ts, event_id)) AS d, max(no) AS no, max(unit_id) AS unit FROM u WHERE kind = 'insert' GROUP BY u),
      s AS (SELECT CASE WHEN NOT (d {DAYS}) THEN 'dated_out' WHEN event_id % 6 = 0 AND no >= 1000 THEN 'gone' WHEN unit % 4 = 0 THEN 'excluded_section' WHEN event_id % 10 = 1 THEN 'no_text:empty' ELSE 'article' END AS status, 'h' AS h FROM i
        UNION ALL SELECT 'gone', NULL FROM u GROUP BY u HAVING count_if(kind = 'insert') = 0)
      SELECT status, count(*) AS n, count(h) AS with_body FROM s GROUP BY status""",
    "stream_daily_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events WHERE CAST(ts AS DATE) < (SELECT CAST(max(ts) AS DATE) FROM events) GROUP BY 1, 2",
}

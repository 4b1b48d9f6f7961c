"""Queries over whole drivers and sinks: listings of days, dated section pages, corrections, coverage facts, and tables that
are written in parts, replaced, and kept current by a stream."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F

from corpusloom.operators import coverage, discovery
from corpusloom.operators import log as lg
from corpusloom.plans import history
from corpusloom.session import checkpointed, load, work_folder
from corpusloom.sources import discovered, feeds, keyed, packs, sinks
from corpusloom.streaming import feed
from corpusloom.streaming import log as stream

FIRST, LAST = history.FIRST, history.LAST
#: The window in which the SQL of number_bounds looks.
NEAR = (date(2024, 1, 10), date(2024, 1, 28))
SHIFT = 100_000


def _pages_log(spark, sf):
    """The log with a page for each user and day; what is recorded was valid up to three days before."""
    rows = history.log(spark, sf).withColumn("outlet_id", F.col("unit_id") % 9).withColumn("day", F.to_date("ingest_time"))
    number = 1_000_000 + F.col("unit_id") * 1000 + F.dayofyear("ingest_time")
    return rows.withColumn("unit_id", F.concat(F.lit("https://x.org/news/"), number.cast("string"))).withColumn("valid_time", F.expr("ingest_time - make_dt_interval(cast(event_id % 4 AS int))"))


def corrections(spark, sf):
    """Events as fetched pages, some of which say a day other than the recorded one."""
    rows = _pages_log(spark, sf).withColumn("valid_time", F.date_trunc("second", "valid_time"))
    content = F.concat(F.lit("c"), F.col("event_id").cast("string"))
    attrs = F.create_map(F.lit("pub_date_source"), F.when(F.col("event_id") % 3 == 0, "page").otherwise("rss"), F.lit("kept"), F.col("event_type"))
    rows = rows.select(F.col("event_id").cast("string").alias("event_id"), "kind", "unit_id", "valid_time", "ingest_time", content.alias("content_sha256"), attrs.alias("attrs"))
    at = F.col("event_id").cast("bigint")
    pages = rows.where(at % 7 != 0).select("content_sha256", F.when(at % 11 == 0, None).when(at % 5 == 0, F.col("valid_time")).otherwise(F.expr("valid_time + interval 1 day")).alias("found"))
    made = lg.corrections(rows, pages, F.col("found"), "pass-1", "2024-03-01 00:00:00")
    a = F.col("attrs")
    return made.select("event_id", "unit_id", F.date_format("valid_time", "yyyy-MM-dd HH:mm:ss").alias("valid"), a["corrects"].alias("corrects"), a["pub_date_source"].alias("dated_by"), a["kept"].alias("kept"))


def coverage_facts(spark, sf):
    """What became of found pages by outlet, day and measure; a third of what was tried never got into the log."""
    rows = _pages_log(spark, sf)
    final = F.when(F.col("event_id") % 6 == 1, "https://x.org/news/").otherwise(F.col("unit_id"))
    logged = rows.where("event_id % 3 <> 0").withColumn("attrs", F.create_map(F.lit("final_url"), final))
    found = rows.select(F.col("unit_id").alias("url"), "outlet_id", "day").distinct()
    outcome = F.when(F.col("event_type") == "click", "stored").when(F.col("event_type") == "error", "gone").otherwise("timeout")
    tries = rows.select(F.col("unit_id").alias("url"), outcome.alias("outcome"), F.struct("ingest_time", "event_id").alias("attempted_at"))
    facts = coverage.facts(found, logged, tries, FIRST, LAST)
    return facts.groupBy("outlet_id", F.col("day").cast("string").alias("day"), "measure").agg(F.count("*").alias("n"))


def listing_days(spark, sf):
    """Items of whole days. An event is a listing page of one of three sections; some failed, some days lack their last."""
    e, at = load(spark, sf, "events", spread=True), F.col("event_id")
    section = F.when(F.floor(at / 17) % 3 == 0, "a").when(F.floor(at / 17) % 3 == 1, "b")
    day = F.expr("date_add(DATE'2024-01-02', cast(event_id % 17 AS int))")
    page = (F.floor(at / 51) + 1).cast("int")
    under = F.concat(F.lit('<a href="https://l.org/'), day.cast("string"))
    linked = F.when(at % 17 == 4, 999_999_999).otherwise(page)
    name = F.concat(F.lit("item/"), (F.col("user_id") % 40).cast("string"))
    html = F.concat(
        F.lit('<html><a class="n" href="/x/izvor/src'), F.when(section.isNotNull(), F.concat(F.lit("/"), section)).otherwise(F.lit("")), F.lit("/"), linked.cast("string"), F.lit('">next</a>'),
        under, F.lit("/src/"), name, F.lit('">one</a>'), under, F.lit("/src/"), name, F.lit('">again</a>'), under, F.lit("/other/"), name, F.lit('">of another source</a></html>'),
    )
    failed = (at % 17 % 3 == 1) & (F.col("event_type") == "error")
    fetched = e.select(day.alias("day"), section.alias("section"), page.alias("page"), F.when(~failed, html).alias("html"))
    return feeds.listing_discovery(fetched, "https://l.org", "src", FIRST, LAST, ["a", "b", None]).select("route", F.col("day").cast("string").alias("day"), "url", "host")


def section_stories(spark, sf):
    """Stories of section pages, dated by the number in their URL; a link behind the list's end doesn't count."""
    number = (SHIFT + F.col("doc_id") * 37 % 120_011).cast("string")
    story = lambda dress, n: F.concat(F.lit(f'<a class="{dress} x" href="/news/'), n, F.lit('/title.html">t</a>'))
    html = F.concat(F.lit('<div id="storyBrowser">'), story("largeThumb", number), story("smallThumb", F.lit("101000")), F.lit('<nav aria-label="Pagination">'), story("largeThumb", F.lit("102000")))
    fetched = load(spark, sf, "documents").select(html.alias("html"))
    shifted = load(spark, sf, "events").select((F.col("event_id") + SHIFT).alias("event_id"), F.to_date("ts").alias("d"))
    found = feeds.section_discovery(fetched, "https://s.org", discovery.calibration(shifted, "event_id", "d"), *NEAR)
    return found.select("number", F.col("day").cast("string").alias("day"), "url", "host")


def stream_current_units(spark, sf):
    """The latest event of each user, kept as a table by a stream over the events."""
    schema = load(spark, sf, "events").schema
    rows = stream.read(spark, f"{sf}/events.parque[t]", schema).withColumn("ts", F.col("ts").cast("timestamp"))
    out = f"{work_folder(spark)}/current-{uuid.uuid4().hex}"
    stream.keep_current(rows, f"{out}/table", f"{out}/checkpoint", unit="user_id", time="ts").awaitTermination()
    return sinks.current(spark, f"{out}/table").select("user_id", "event_id", "event_type")


def stream_change_feed(spark, sf):
    """The latest event of each user, as the end of the feed of changes of a stream in two batches or more."""
    out = f"{work_folder(spark)}/feed-{uuid.uuid4().hex}"
    log = load(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    # as many files as cores or as the input has, each of days that are odd or even
    parts = max(2, spark.sparkContext.defaultParallelism, len(log.inputFiles()))
    log.repartition(parts, F.dayofmonth("ts") % 2, F.pmod("event_id", F.lit(parts))).write.parquet(f"{out}/log")
    files = max(1, len(spark.read.parquet(f"{out}/log").inputFiles()) // 2)
    feed.follow(stream.read(spark, f"{out}/log", log.schema, files), f"{out}/rows", f"{out}/checkpoint", unit="user_id", time="ts", kind=None).awaitTermination()
    return lg.latest(spark.read.parquet(f"{out}/rows"), ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type")


def parts_replaced(spark, sf):
    """Documents added in two parts by source, after which the partitions of three sources are replaced by other rows."""
    out = f"{work_folder(spark)}/parts-{uuid.uuid4().hex}"
    d = load(spark, sf, "documents").select("doc_id", "n_chars", "source")
    sinks.append(d.where("doc_id % 2 = 0"), out, ["source"])
    sinks.append(d.where("doc_id % 2 = 1"), out, ["source"])
    sinks.replace_days(d.where("source IN ('src1', 'src2', 'src3') AND doc_id % 3 = 0").withColumn("n_chars", F.lit(0).cast("bigint")), out, ["source"])
    return spark.read.schema(d.schema).parquet(out).select("doc_id", "n_chars", "source")


def _escaped(c):
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def _element(name, c):
    return F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))


def dump_found(spark, sf):
    """Candidates of two weeks, read by the source of dumps from a file for each day that pages are written to; the titles
    of a fifth aren't escaped."""
    p, id = load(spark, sf, "pages"), F.col("page_id")
    title = F.concat(F.lit("A & <b> "), id.cast("string"))
    sent = F.date_format(F.expr("timestamp'2024-11-01 06:30:00' + make_interval(0, 0, 0, cast(page_id % 30 AS int))"), "EEE, dd MMM yyyy HH:mm:ss")
    value = _element("item", F.concat(_element("link", _escaped(F.col("url"))), F.when(id % 4 != 0, _element("pubDate", F.concat(sent, F.lit(" +0200")))).otherwise("<pubDate></pubDate>"), _element("title", F.when(id % 5 == 0, title).otherwise(_escaped(title)))))
    day = F.expr("date_add(DATE'2024-11-01', cast(page_id % 30 AS int))")
    folder = f"{work_folder(spark)}/dumps-{uuid.uuid4().hex}"
    p.select(day.alias("day"), id, value.alias("value")).repartition("day").sortWithinPartitions("day", "page_id").drop("page_id").write.partitionBy("day").option("compression", "gzip").text(folder)
    discovered.register(spark)
    items = spark.read.format("feed_dump").load(folder).where(F.col("day").between(date(2024, 11, 5), date(2024, 11, 18)) & F.col("host").isNotNull())
    found = feeds.dump_discovery(items, ["example.com", "example.net"])
    return found.select(F.col("day").cast("string").alias("day"), "url", "host", "title", F.date_format("pub_date", "yyyy-MM-dd HH:mm").alias("sent"))


def sitemap_found(spark, sf):
    """An outlet's pages of a quarter, read by the source of sitemaps from files of up to a thousand pages a month."""
    p, id = load(spark, sf, "pages"), F.col("page_id")
    day = F.expr("date_add(DATE'2024-08-01', cast(page_id % 150 AS int))")
    told = F.concat(F.lit('<news:news xmlns:news="n"><news:publication_date>'), F.date_format(day, "yyyy-MM-dd"), F.lit("T23:30:00-02:00</news:publication_date>"), _element("news:title", F.concat(F.lit("t &amp; "), id.cast("string"))), F.lit("</news:news>"))
    value = _element("url", F.concat(_element("loc", _escaped(F.col("url"))), _element("lastmod", F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T08:00:00+00:00"))), F.when(id % 3 == 0, told).otherwise("")))
    rows = p.select(F.date_format(day, "yyyy-MM").alias("month"), F.floor(id / 1000).alias("file"), value.alias("v"))
    whole = rows.groupBy("month", "file").agg(F.array_join(F.array_sort(F.collect_list("v")), "").alias("v"))
    folder = f"{work_folder(spark)}/sitemaps-{uuid.uuid4().hex}"
    whole.select("month", "file", F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), "v", F.lit("</urlset>")).alias("value")).write.partitionBy("month", "file").text(folder)
    discovered.register(spark)
    first, last = date(2024, 9, 10), date(2024, 11, 20)
    pages = spark.read.format("sitemap").load(folder).where(F.col("month").between(date(2024, 9, 1), date(2024, 11, 1)) & (F.col("host") != "spam-farm.example.com")).withColumn("child", F.col("path"))
    pages = checkpointed(pages)  # files are read once
    registry = spark.createDataFrame([("com", ["example.com"])], "outlet_id string, domains array<string>")
    found = feeds.sitemap_discovery(pages, pages.select(F.col("child").alias("loc"), "month").distinct(), registry, "com", first, last)
    return found.select("url", F.col("day").cast("string").alias("day"), "title", F.date_format("lastmod", "yyyy-MM-dd HH:mm").alias("changed"))


def table_upserted(spark, sf):
    """Documents as a table with a key, after a batch of changed, new and gone ones that touches its first files only."""
    d, id = load(spark, sf, "documents").select("doc_id", "n_chars", "source"), F.col("doc_id")
    root = f"{work_folder(spark)}/keyed-{uuid.uuid4().hex}"
    keyed.create(d, root, "doc_id", file_rows=1000)
    changed = d.where(id.between(40, 90)).withColumn("n_chars", F.lit(0).cast("bigint"))
    new = d.where(id % 40 == 0).withColumn("doc_id", id + 10_000_000)
    keyed.upsert(spark, root, changed.unionByName(new), "doc_id", gone=d.where(id.between(100, 400) & (id % 50 == 7)))
    return keyed.read(spark, root)


def packed_objects(spark, sf):
    """Pages by the hash of their HTML, six sevenths of which are stored, in two batches of which the second has the first's."""
    p, id = load(spark, sf, "pages", spread=True).select("page_id", "html"), F.col("page_id")
    root = f"{work_folder(spark)}/objects-{uuid.uuid4().hex}"
    packs.add(p.where((id % 7 != 0) & (id % 2 == 0)), root, "html")
    packs.add(p.where(id % 7 != 0), root, "html")
    found = packs.objects(p.select("page_id", F.sha2("html", 256).alias("sha256")), root, "sha256")
    return found.select("page_id", "sha256", F.octet_length(packs.verified(F.col("content"), F.col("sha256"))).alias("bytes"))


QUERIES = {f.__name__: f for f in (corrections, coverage_facts, listing_days, section_stories, dump_found, sitemap_found, stream_current_units, stream_change_feed, parts_replaced, table_upserted, packed_objects)}

PAGES_LOG = "WITH g AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'insert' END AS kind, event_type, ts, user_id % 9 AS outlet_id, CAST(ts AS DATE) AS day, 'https://x.org/news/' || (1000000 + user_id * 1000 + dayofyear(ts)) AS u, ts - to_days(CAST(event_id % 4 AS INT)) AS valid FROM events) "
NUMBERED = history.ORACLE_SQL["day_of_number"].replace("SELECT doc_id, doc_id * 37 % 12007 AS x FROM documents", "SELECT DISTINCT doc_id * 37 % 120011 AS doc_id, doc_id * 37 % 120011 AS x FROM documents")
FOUND = r"""WITH h AS (SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '[?&]utm_source=[^&]*$', '') AS url, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\.', '') AS host FROM pages) """
ORACLE_SQL = {
    "packed_objects": "SELECT page_id, sha256(html) AS sha256, CASE WHEN sha256(html) IN (SELECT sha256(html) FROM pages WHERE page_id % 7 <> 0) THEN CAST(strlen(html) AS INT) END AS bytes FROM pages",
    "table_upserted": """SELECT doc_id, CASE WHEN doc_id BETWEEN 40 AND 90 THEN 0 ELSE n_chars END AS n_chars, source FROM documents WHERE NOT (doc_id BETWEEN 100 AND 400 AND doc_id % 50 = 7)
      UNION ALL SELECT doc_id + 10000000, n_chars, source FROM documents WHERE doc_id % 40 = 0""",
    "dump_found": FOUND
    + """, d AS (SELECT *, DATE '2024-11-01' + CAST(page_id % 30 AS INT) AS day FROM h)
      SELECT strftime(day, '%Y-%m-%d') AS day, url, host, 'A & <b> ' || page_id AS title, CASE WHEN page_id % 4 <> 0 THEN strftime(day, '%Y-%m-%d') || ' 04:30' END AS sent FROM d
      WHERE day BETWEEN '2024-11-05' AND '2024-11-18' AND (host LIKE '%.rs' OR regexp_matches(host, '(^|[.])example[.](com|net)$')) QUALIFY row_number() OVER (PARTITION BY day, url ORDER BY page_id) = 1""",
    "sitemap_found": FOUND
    + """, d AS (SELECT *, DATE '2024-08-01' + CAST(page_id % 150 AS INT) AS day FROM h)
      SELECT url, strftime(CASE WHEN page_id % 3 = 0 THEN day + 1 ELSE CAST(date_trunc('month', day) AS DATE) END, '%Y-%m-%d') AS day, CASE WHEN page_id % 3 = 0 THEN 't & ' || page_id END AS title, strftime(day, '%Y-%m-%d') || ' 08:00' AS changed
      FROM d WHERE day BETWEEN '2024-09-01' AND '2024-11-30' AND regexp_matches(host, '(^|[.])example[.]com$') AND host <> 'spam-farm.example.com'""",
    "corrections": PAGES_LOG
    + """, c AS (SELECT * FROM g WHERE kind = 'insert' QUALIFY row_number() OVER (PARTITION BY u ORDER BY ts DESC, CAST(event_id AS VARCHAR) DESC) = 1),
      n AS (SELECT *, strftime(date_trunc('second', valid) + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS new FROM c WHERE event_id % 3 <> 0 AND event_id % 7 <> 0 AND event_id % 11 <> 0 AND event_id % 5 <> 0)
      SELECT sha256('pass-1|' || u || '|' || new) AS event_id, u AS unit_id, new AS valid, CAST(event_id AS VARCHAR) AS corrects, 'page' AS dated_by, event_type AS kept FROM n""",
    "coverage_facts": PAGES_LOG
    + f""", f AS (SELECT DISTINCT u, outlet_id, day FROM g), l AS (SELECT * FROM g WHERE event_id % 3 <> 0 QUALIFY kind = 'delete' OR row_number() OVER (PARTITION BY u, kind ORDER BY ts DESC, event_id DESC) = 1),
      k AS (SELECT f.outlet_id, f.day, CAST(l.valid AS DATE) AS dated, CASE WHEN kind = 'delete' OR event_id % 6 = 1 THEN 'gone' WHEN CAST(l.valid AS DATE) {history.DAYS} THEN 'fetched' ELSE 'dated_out' END AS measure FROM f JOIN l USING (u)),
      t AS (SELECT u FROM g GROUP BY u HAVING arg_max(event_type, (ts, event_id)) NOT IN ('click', 'error')),
      a AS (SELECT outlet_id, day, 'discovered' AS measure FROM f UNION ALL SELECT outlet_id, CASE WHEN measure = 'fetched' THEN dated ELSE day END, measure FROM k
        UNION ALL SELECT outlet_id, day, 'failed' FROM f WHERE u IN (SELECT u FROM t) AND u NOT IN (SELECT u FROM l))
      SELECT outlet_id, CAST(day AS VARCHAR) AS day, measure, count(*) AS n FROM a GROUP BY ALL""",
    "listing_days": f"""WITH p AS (SELECT event_id % 17 AS d, DATE '2024-01-02' + CAST(event_id % 17 AS INT) AS day, event_id // 17 % 3 AS s, event_id // 51 + 1 AS page, CASE WHEN event_id % 17 = 4 THEN 999999999 ELSE event_id // 51 + 1 END AS due, user_id % 40 AS item FROM events
        WHERE NOT (event_id % 17 % 3 = 1 AND event_type = 'error')),
      s AS (SELECT day, s FROM p WHERE day {history.DAYS} GROUP BY day, s HAVING count(DISTINCT page) >= max(due)), w AS (SELECT day FROM s GROUP BY day HAVING count(*) = 3)
      SELECT DISTINCT 'listing' AS route, CAST(day AS VARCHAR) AS day, 'https://l.org/' || day || '/src/item/' || item AS url, 'l.org' AS host FROM p JOIN w USING (day)""",
    "section_stories": f"""WITH n AS ({NUMBERED}), b AS ({history.ORACLE_SQL["number_bounds"]})
      SELECT doc_id + {SHIFT} AS number, day, 'https://s.org/news/' || (doc_id + {SHIFT}) || '/title.html' AS url, 's.org' AS host FROM n, b WHERE doc_id BETWEEN lo AND hi AND day BETWEEN '{NEAR[0]}' AND '{NEAR[1]}'""",
    "stream_change_feed": "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id",
    "stream_current_units": "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id",
    "parts_replaced": """SELECT doc_id, CASE WHEN source IN ('src1', 'src2', 'src3') THEN 0 ELSE n_chars END AS n_chars, source FROM documents WHERE source IS NULL OR source NOT IN ('src1', 'src2', 'src3') OR doc_id % 3 = 0""",
}

import gzip
import hashlib
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import feeds, registries, sinks
from corpusloom.streaming import log as stream

def dump_item(number, **elements):
    """A line of a dump; ``feed`` goes into the attributes of its source."""
    feed = elements.pop("feed", None)
    inner = "".join(f"<{k}>{v}</{k}>" for k, v in elements.items())
    source = f'<source url="https://{feed}/all.xml" mcFeedId="{number}0" mcSourceId="{number}"/>' if feed else ""
    return f"<item>{inner}{source}</item>"


#: By title: what a line of a dump says.
SAID = {
    "plain": dict(link="https://lake.test/a/plain", pubDate="Sun, 02 Mar 2025 23:59:59 +0000", domain="lake.test", feed="lake.test"),
    "west of UTC": dict(link="https://lake.test/a/west", pubDate="Sun, 02 Mar 2025 20:30:00 -0500", domain="LAKE.test"),
    "known by its feed only": dict(link="https://short.example/r/7", domain="short.example", feed="www.wood.test"),
    "known by its domain only": dict(link="https://amp.example/wood/8", pubDate="2025", domain="wood.test"),
    "under a known host": dict(link="http://m.wood.test/9?mc_eid=5&page=2", domain="m.wood.test"),
    "unknown": dict(link="https://field.example/b", domain="field.example", feed="field.example"),
    "broken & <loose> \x07marks": dict(link="https://wood.test/b?x=1&y=2", domain="wood.test"),
    "without a link": dict(domain="lake.test"),
}
SAME_PAGE = [dict(link="https://lake.test/c?fbclid=1", domain="lake.test", title="first said"), dict(link="https://LAKE.test/c#comments", domain="lake.test", title="said again")]


def test_dumps(spark, tmp_path):
    said = [dump_item(i, title=t, **what) for i, (t, what) in enumerate(SAID.items(), 1)] + [dump_item(50 + i, **what) for i, what in enumerate(SAME_PAGE)]
    head = ["<?xml version='1.0' encoding='UTF-8'?>", '<rss version="2.0"><channel>', "<title>no item</title>"]
    (tmp_path / "d.xml.gz").write_bytes(gzip.compress("\n".join([*head, *said, "</channel></rss>"]).encode()))
    items = feeds.dump_items(spark, str(tmp_path / "d.xml.gz")).withColumn("day", F.lit(date(2025, 3, 3)))
    got = {r.title: r for r in items.collect()}
    assert len(got) == len(said) - 1 and "without a link" not in got
    assert got["plain"].pub_date == datetime(2025, 3, 2, 23, 59, 59) and got["west of UTC"].pub_date == datetime(2025, 3, 3, 1, 30)
    assert got["known by its domain only"].pub_date is None is got["unknown"].pub_date and got["west of UTC"].domain == "lake.test"
    assert (got["plain"].source_url, got["plain"].mc_source_id) == ("https://lake.test/all.xml", "1") and got["west of UTC"].source_url is None
    assert "broken & <loose> marks" in got and got["broken & <loose> marks"].link == "https://wood.test/b?x=1&y=2"
    found = {r.title: r.url for r in feeds.dump_discovery(items, ["lake.test", "wood.test"]).collect()}
    assert found == {
        "plain": "https://lake.test/a/plain", "west of UTC": "https://lake.test/a/west", "known by its feed only": "https://short.example/r/7", "known by its domain only": "https://amp.example/wood/8",
        "under a known host": "http://m.wood.test/9?page=2", "broken & <loose> marks": "https://wood.test/b?x=1&y=2", "first said": "https://lake.test/c",
    }


INDEX = """<?xml version="1.0"?><sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">
<sitemap><loc>https://hill.test/maps/2025-3.xml.gz</loc></sitemap>
<sitemap><loc>https://sea.example/map/2024/m12</loc><lastmod>2025-01-02T00:00:00Z</lastmod></sitemap>
<sitemap><loc>https://valley.test/posts_31.xml</loc></sitemap></sitemapindex>"""
URLS = """<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:news="http://www.google.com/schemas/sitemap-news/0.9">
<url><loc>https://valley.test/k/</loc><lastmod>2025-03-09T12:00:05+02:00</lastmod></url>
<url><loc>https://valley.test/l/</loc><lastmod>2025-03-08T10:00:00+01:00</lastmod><news:news><news:publication_date>2025-03-07T23:30:00-01:00</news:publication_date><news:title>L</news:title></news:news></url>
<url><loc>https://elsewhere.test/m/</loc></url></urlset>"""


def test_sitemaps(spark, tmp_path):
    (tmp_path / "i.xml").write_text(INDEX)
    (tmp_path / "u.xml.gz").write_bytes(gzip.compress(URLS.encode()))
    index = feeds.sitemap_index(spark, str(tmp_path / "i.xml"))
    assert sorted((r.loc[8:11], r.month) for r in index.collect()) == [("hil", date(2025, 3, 1)), ("sea", date(2024, 12, 1)), ("val", None)]
    pages = feeds.sitemap_urls(spark, str(tmp_path / "u.xml.gz")).withColumn("child", F.lit("https://valley.test/posts_31.xml"))
    got = {r.loc[-2]: r for r in pages.collect()}
    assert got["k"].lastmod == datetime(2025, 3, 9, 10, 0, 5) and got["l"].pub_date == datetime(2025, 3, 8, 0, 30) and got["l"].title == "L"
    registry = spark.createDataFrame([("v", ["valley.test"])], "outlet_id string, domains array<string>")
    found = feeds.sitemap_discovery(pages, index, registry, "v", date(2025, 3, 1), date(2025, 3, 31), include="posts")
    assert sorted((r.url[-2], r.day) for r in found.collect()) == [("k", date(2025, 3, 8)), ("l", date(2025, 3, 8))]
    assert feeds.sitemap_discovery(pages, index, registry, "v", date(2023, 1, 1), date(2023, 1, 31)).count() == 0


def listing(day, numbers, pages=(), section=None):
    items = "".join(f"""<a class=x href={q}https://list.test/{day}/sun/item-{n}/{n}{q}>i</a>""" for n, q in zip(numbers, "\"'" * len(numbers)))
    under = f"sun/{section}" if section else "sun"
    return items + "".join(f'<a href="https://list.test/{day}/izvor/{under}/{n}">{n}</a>' for n in pages)


def test_listings(spark):
    day = date(2025, 3, 4)
    page = listing(day, [501, 502, 501], [2, 11]) + f'<a href="https://list.test/{day}/moon/a/9">o</a><a href="https://list.test/{day}/sun/9">s</a>'
    df = spark.createDataFrame([(page, day)], "p string, d date")
    r = df.select(feeds.listing_links(F.col("p"), "https://list.test", F.col("d"), "sun").alias("a"), feeds.listing_pages(F.col("p"), "sun").alias("n"), feeds.listing_pages(F.col("p"), "sun", "sport").alias("m")).first()
    assert [x.rsplit("/", 1)[1] for x in r.a] == ["501", "502"] and (r.n, r.m) == (11, 1)
    item = """<a href="/local" class="src-btn"><a rel="x" class='big src-btn' href='https://hill.test/v/300001/t.html'>"""
    page = '<a href="/v/111111/no.html" class="largeThumb"><div id="storyBrowser"><a href="/v/300001/x.html" class="largeThumb"><a class="largeThumb" href="/v/300001/x.html"><a href="/v/12/y.html" class="largeThumb"><a href="/v/300003/y.html"><nav aria-label="Pagination"><a href="/v/300002/y.html" class="largeThumb">'
    r = spark.createDataFrame([(item, page)], "i string, p string").select(feeds.listing_source(F.col("i")).alias("s"), feeds.listing_source(F.col("p")).alias("n"), feeds.stories(F.col("p"), "https://hill.test").alias("t"), feeds.stories(F.col("i"), "").alias("e")).first()
    assert r.s == "https://hill.test/v/300001/t.html" and r.n is None and r.e == []
    assert [tuple(x) for x in r.t] == [("https://hill.test/v/300001/x.html", 300001)]


def test_days_of_listings_count_as_a_whole(spark):
    d = [date(2025, 3, n) for n in range(1, 6)]
    fetched = [
        (d[0], None, 1, listing(d[0], [1, 2], [2])), (d[0], None, 2, listing(d[0], [2, 3], [1])), (d[0], "sport", 1, listing(d[0], [3, 4], section="sport")),
        (d[1], None, 1, listing(d[1], [5], [2])), (d[1], None, 2, None), (d[1], "sport", 1, listing(d[1], [6])),  # a page failed
        (d[2], None, 1, listing(d[2], [7])),  # a section is missing
        (d[3], None, 1, listing(d[3], [])), (d[3], "sport", 1, listing(d[3], [8], [2], "sport")), (d[3], "sport", 2, listing(d[3], [9])), (d[3], "sport", 2, listing(d[3], [9])),
        (d[4], None, 1, listing(d[4], [10])), (d[4], "sport", 1, ""),
    ]
    df = spark.createDataFrame(fetched, "day date, section string, page int, html string")
    found = feeds.listing_discovery(df, "https://list.test", "sun", d[0], d[3], [None, "sport"]).collect()
    assert sorted((r.day, int(r.url.rsplit("/", 1)[1])) for r in found) == [(d[0], 1), (d[0], 2), (d[0], 3), (d[0], 4), (d[3], 8), (d[3], 9)]
    assert {r.host for r in found} == {"list.test"}


def test_section_pages_are_dated_by_their_numbers(spark):
    curve = spark.createDataFrame([(date(2025, 3, 1 + n), 300_000 + 100 * n) for n in range(20)], "day date, id long")
    link = lambda n: f'<a class="largeThumb" href="/v/{n}/t.html">'
    html = '<div id="storyBrowser">' + "".join(link(n) for n in (300_000, 300_500, 300_510, 301_900, 399_999, 300_500)) + '<nav aria-label="Pagination">' + link(300_600)
    df = spark.createDataFrame([(html,), (html,), (None,), ("",)], "html string")
    found = feeds.section_discovery(df, "https://hill.test", curve, date(2025, 3, 5), date(2025, 3, 10)).orderBy("url").collect()
    assert [(r.number, r.day) for r in found] == [(300_500, date(2025, 3, 6)), (300_510, date(2025, 3, 6))]


def test_registries(spark, tmp_path):
    (tmp_path / "o.csv").write_text('outlet_id,name,domains,basis,rules_version,exclude_hosts,collect\na,A,www.a.rs b.rs,x,r1,c.a.rs,yes\n,,,,,,\nb,B,b.net,x,r1,,no\n')
    got = registries.outlets(spark, str(tmp_path / "o.csv"))
    assert [(r.outlet_id, r.domains, r.exclude_hosts, r.collect) for r in got.orderBy("outlet_id").collect()] == [("a", ["a.rs", "b.rs"], ["c.a.rs"], True), ("b", ["b.net"], [], False)]
    assert registries.outlets(spark, str(tmp_path / "o.csv"), collected_only=True).count() == 1
    (tmp_path / "bad.csv").write_text("outlet_id,name,domains,basis,rules_version\na,A,,x,r1\n")
    with pytest.raises(ValueError, match="domains"):
        registries.outlets(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "t.csv").write_text('list,term,note\nx,"a && b","say ""hi"", now"\n,skip,\ny,c,\n')
    assert registries.terms(spark, str(tmp_path / "t.csv")) == [("x", "a && b"), ("y", "c")]
    (tmp_path / "r.csv").write_text('outlet_id,rule,value,reason\na,drop_line,"one, two",z\na,end_marker,End,z\n')
    assert registries.line_rules(spark, str(tmp_path / "r.csv")) == {"a": {"drop_line": ["one, two"], "end_marker": ["End"]}}
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r.a for r in registries.json_lines(spark, str(tmp_path / "l.jsonl"), "a int").collect()) == [1, 2]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    root = str(tmp_path / "table")
    assert not sinks.exists(spark, root)
    sinks.replace(df, root)
    sinks.replace(sinks.current(spark, root).withColumn("v", F.col("v") + 1), root)
    assert sorted(tuple(r) for r in sinks.current(spark, root).collect()) == [("a", 2), ("b", 3)]
    sinks.append(df, str(tmp_path / "parts"))
    sinks.append(df, str(tmp_path / "parts"))
    assert spark.read.parquet(str(tmp_path / "parts")).count() == 4
    sinks.replace_days(df, str(tmp_path / "days"), ["k"])
    sinks.replace_days(df.where("k = 'a'").withColumn("v", F.lit(9)), str(tmp_path / "days"), ["k"])
    assert sorted((r.k, r.v) for r in spark.read.parquet(str(tmp_path / "days")).collect()) == [("a", 9), ("b", 2)]
    with pytest.raises(ValueError, match="body"):
        sinks.release(df.withColumn("body", F.lit("x")), str(tmp_path / "r"))
    sinks.release(df, str(tmp_path / "r"))
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_once(df, str(tmp_path / "r"))
    assert all(len(r.sha256) == 64 for r in sinks.checksums(spark, str(tmp_path / "r")).collect())
    m = sinks.manifest(spark, str(tmp_path / "r"), "index", "2025-05-01T00:00:00Z", {"terms": "lex-1"}).first()
    assert (m["name"], m["rows"], [tuple(c) for c in m["columns"]], m["notes"]) == ("index", 2, [("k", "string"), ("v", "int")], {"terms": "lex-1"})
    assert {f["sha256"] for f in m["files"]} == {r.sha256 for r in sinks.checksums(spark, str(tmp_path / "r")).where("path LIKE '%/part-%'").collect()}
    assert m["bytes"] == sum(f["bytes"] for f in m["files"])
    sinks.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_stream_keeps_the_latest(spark, tmp_path):
    schema = "unit_id string, event_id int, ingest_time timestamp"
    day = lambda n: datetime(2026, 1, n)
    source, table, mark = (str(tmp_path / x) for x in ("in", "table", "mark"))

    def arrive(rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        stream.keep_current(stream.read(spark, source, schema), table, mark).awaitTermination()
        return sorted((r.unit_id, r.event_id) for r in sinks.current(spark, table).collect())

    assert arrive([("a", 1, day(1)), ("a", 2, day(3)), ("b", 3, day(1))]) == [("a", 2), ("b", 3)]
    assert arrive([("a", 4, day(2)), ("b", 5, day(1)), ("c", 6, day(1))]) == [("a", 2), ("b", 5), ("c", 6)]


def test_stream_folds_several_batches_at_once(spark, tmp_path):
    schema = "unit_id string, event_id int, ingest_time timestamp"
    source, table, mark = (str(tmp_path / x) for x in ("in", "table", "mark"))
    seen, versions = {}, []
    for n in range(1, 8):
        rows = [(f"u{(n * k) % 5}", 10 * n + k, datetime(2026, 1, 1 + (7 * n + k) % 9)) for k in range(4)]
        for unit, event, at in rows:
            seen[unit] = max(seen.get(unit, (at, event)), (at, event))
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        stream.keep_current(stream.read(spark, source, schema), table, mark, every=3).awaitTermination()
        assert {r.unit_id: (r.ingest_time, r.event_id) for r in stream.kept(spark, table).collect()} == seen
        versions.append((sinks.exists(spark, table), sinks.parts(spark, table)))
    assert versions == [(False, 1), (False, 2), (True, 0), (True, 1), (True, 2), (True, 0), (True, 1)]
    assert len([x for x in (tmp_path / "table").iterdir() if x.name.startswith("v-")]) == 2
    # a part that is written again under its number counts once
    again = spark.createDataFrame([("u0", 1, datetime(2025, 1, 1))], schema)
    for _ in range(2):
        sinks.add_part(again, table, 99)
    assert sinks.parts(spark, table) == 2 and sinks.with_parts(spark, table).where("event_id = 1").count() == 1
    assert stream.kept(spark, table).count() == len(seen)


def test_stream_sees_each_url_once(spark, tmp_path):
    schema = "url string, ingest_time timestamp"
    spark.createDataFrame([("u", datetime(2026, 1, 1)), ("u", datetime(2026, 1, 1, 5)), ("v", datetime(2026, 1, 1))], schema).write.parquet(str(tmp_path / "in"))
    q = stream.append_once(stream.first_seen(stream.read(spark, str(tmp_path / "in"), schema)), str(tmp_path / "out"), str(tmp_path / "mark"))
    q.awaitTermination()
    assert sorted(r.url for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["u", "v"]


def test_checksums_of_files_of_any_size(spark, tmp_path):
    """A file of more than 2 GB, which no value of Spark's holds, and one in a folder; empty ones Spark passes over."""
    folder = tmp_path / "f"
    (folder / "in").mkdir(parents=True)
    large = (2 << 30) + 12_345
    with (folder / "large").open("wb") as f:
        f.truncate(large)
    (folder / "empty").touch()
    (folder / "in" / "é x.bin").write_bytes(b"abc")
    zeros, piece = hashlib.sha256(), bytes(1 << 20)
    for _ in range(large >> 20):
        zeros.update(piece)
    zeros.update(bytes(large & (1 << 20) - 1))
    got = {r["path"].rsplit("/", 1)[1]: (r["bytes"], r["sha256"]) for r in sinks.checksums(spark, str(folder)).collect()}
    assert got == {"large": (large, zeros.hexdigest()), "é x.bin": (3, hashlib.sha256(b"abc").hexdigest())}

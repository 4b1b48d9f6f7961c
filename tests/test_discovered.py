import gzip
from datetime import date, datetime

import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from corpusloom.sources import discovered as dc


def write(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(gzip.compress(text.encode()) if name.endswith(".gz") else text.encode())


def items(*links):
    return "\n".join(["<?xml version='1.0'?>", "<rss><channel>", *[f"<item><link>{x}</link><title>t &  {i}</title></item>" for i, x in enumerate(links)], "<item><title>none</title></item>", "<item><link>broken", "</channel></rss>"])


@pytest.fixture
def dumps(spark, tmp_path):
    dc.register(spark)
    write(tmp_path, "in/2025-03-01.xml.gz", items("https://www.A.org/1", "http://b.net/2?x=1&amp;y=2"))
    write(tmp_path, "in/2025-03-02.xml", items("https://a.org/3"))
    write(tmp_path, "in/day=20250303/part-0.txt", items("https://c.org/4"))
    write(tmp_path, "in/undated.xml", items("https://a.org/5"))
    write(tmp_path, "in/_hidden/2025-03-04.xml", items("https://a.org/6"))
    return tmp_path / "in"


def links(df):
    return sorted(r["link"].rsplit("/", 1)[1] for r in df.select("link").collect())


def test_dumps_with_filters(spark, dumps):
    df = spark.read.format("feed_dump").load(str(dumps))
    assert links(df) == ["1", "2?x=1&y=2", "3", "4", "5"]
    first = df.where("link LIKE '%1'").first()
    assert (first["day"], first["line"], first["host"], first["title"], first["pub_date"]) == (date(2025, 3, 1), 2, "a.org", "t &  0", None)
    assert links(df.where("day = DATE'2025-03-02' OR day IS NULL")) == ["3", "5"]
    for condition, want in {
        "day >= DATE'2025-03-02'": ["3", "4"], "day < DATE'2025-03-02'": ["1", "2?x=1&y=2"], "day IN (DATE'2025-03-03', DATE'2025-01-01')": ["4"], "day IS NULL": ["5"], "day IS NOT NULL AND host = 'a.org'": ["1", "3"],
        "NOT day = DATE'2025-03-01'": ["3", "4"], "host <> 'a.org'": ["2?x=1&y=2", "4"], "host IN ('b.net', 'c.org') AND title LIKE 't%'": ["2?x=1&y=2", "4"], "day > DATE'2030-01-01'": [],
    }.items():
        assert links(df.where(condition)) == want, condition
    # the row count needs no column, and files of other days aren't opened
    write(dumps, "2025-03-09.xml.gz", "")
    (dumps / "2025-03-09.xml.gz").write_bytes(b"no gzip")
    assert spark.read.format("feed_dump").load(str(dumps)).where("day <= DATE'2025-03-02'").count() == 3


def test_filters_are_pushed_down(spark, dumps, capsys):
    spark.read.format("feed_dump").load(str(dumps)).where("day = DATE'2025-03-02' AND host = 'a.org' AND title <> ''").explain()
    plan = capsys.readouterr().out
    after = plan[plan.index("Filter") :].splitlines()[0]
    assert "title" in after and "day" not in after and "host" not in after


def test_filters_as_in_sql():
    values = [None, 1, 2, 3]
    at = ("x",)
    for f, want in [
        (ds.EqualTo(at, 2), [None, False, True, False]), (ds.EqualNullSafe(at, 2), [False, False, True, False]), (ds.In(at, (1, 3)), [None, True, False, True]), (ds.In(at, (1, None)), [None, True, None, None]), (ds.GreaterThan(at, 2), [None, False, False, True]),
        (ds.LessThanOrEqual(at, 2), [None, True, True, False]), (ds.IsNull(at), [True, False, False, False]), (ds.IsNotNull(at), [False, True, True, True]), (ds.Not(ds.EqualTo(at, 2)), [None, True, False, True]),
    ]:
        assert [dc.passes(f, v) for v in values] == want


def test_dates_of_names():
    assert [dc.date_of(x) for x in ("a/2025-03-04.xml", "20250304", "maps/2025-3/x", "map_2025_12_2.xml", "2025/07/x-9", "part-00000-a1.txt", "2025-02-31.xml", "120250304")] == [date(2025, 3, 4), date(2025, 3, 4), None, date(2025, 12, 1), date(2025, 7, 1), None, None, None]


URLS = """<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:n="http://www.google.com/schemas/sitemap-news/0.9">
<url><loc> https://river.test/a </loc><lastmod>2025-04-01</lastmod></url><url><lastmod>2025-04-01</lastmod></url>
<url><loc>https://www.river.test/b</loc><n:news><n:publication_date>2025-04-02T01:00:00+03:00</n:publication_date><n:title>B &amp; c</n:title></n:news></url></urlset>"""


def test_sitemaps(spark, tmp_path):
    dc.register(spark)
    write(tmp_path, "m/posts-2025-04.xml.gz", URLS)
    write(tmp_path, "m/index.xml", "<sitemapindex><sitemap><loc>https://river.test/posts-2025-04.xml</loc><lastmod>never</lastmod></sitemap></sitemapindex>")
    df = spark.read.format("sitemap").load(str(tmp_path / "m"))
    got = {r["loc"]: r for r in df.collect()}
    assert {k.rsplit("/", 1)[1]: (r["kind"], r["month"], r["host"]) for k, r in got.items()} == {"a": ("page", date(2025, 4, 1), "river.test"), "b": ("page", date(2025, 4, 1), "river.test"), "posts-2025-04.xml": ("child", None, "river.test")}
    a, b = got["https://river.test/a"], got["https://www.river.test/b"]
    assert a["lastmod"] == datetime(2025, 4, 1) and b["pub_date"] == datetime(2025, 4, 1, 22) and b["title"] == "B & c" and b["lastmod"] is None
    assert df.where("month = DATE'2025-04-01' AND kind = 'page'").count() == 2
    write(tmp_path, "bad/2025-05.xml", "<urlset><url>")
    with pytest.raises(Exception, match="2025-05.xml"):
        spark.read.format("sitemap").load(str(tmp_path / "bad")).collect()
    (tmp_path / "none").mkdir()
    assert spark.read.format("sitemap").load(str(tmp_path / "none")).count() == 0


def test_streams_take_every_file_once(spark, dumps, tmp_path):
    def run():
        q = spark.readStream.format("feed_dump").load(str(dumps)).where(F.col("host") == "a.org").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(once=True).start()
        q.awaitTermination()
        return links(spark.read.parquet(str(tmp_path / "out")))

    assert run() == ["1", "3", "5"]
    write(dumps, "2025-02-01.xml", items("https://a.org/7", "https://b.net/8"))
    assert run() == ["1", "3", "5", "7"] == run()

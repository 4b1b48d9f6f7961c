"""Listings that pages are found by: dumps of feeds, sitemaps, and HTML pages with links."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import dates, urls
from corpusloom.functions.text import stripped
from corpusloom.operators.discovery import bounds, day_of, first_of_day, outlet_of

ITEM = "link string, pubDate string, domain string, title string, source struct<_url string, _mcSourceId string, _VALUE string>"
#: Elements of an item; any other < in a line that isn't well-formed is text.
ELEMENTS = "item|link|pubDate|domain|title|source|guid|description|category"


def repaired(line: Column) -> Column:
    """An item's line with what XML doesn't allow taken out or escaped: control characters, stray & and stray <."""
    clean = F.regexp_replace(line, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    clean = F.regexp_replace(clean, r"&(?!#?\w{1,10};)", "&amp;")
    return F.regexp_replace(clean, rf"<(?!/?(?:{ELEMENTS})\b)", "&lt;")


def dump_items(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, link, pub_date, domain, title, source_url, mc_source_id) of dumps, gzipped or not, with one <item> a
    line. Lines that aren't well-formed XML are repaired first; those without a link are skipped."""
    rows = spark.read.text(path).select(F.input_file_name().alias("path"), F.monotonically_increasing_id().alias("line"), F.trim("value").alias("v")).where("v LIKE '<item>%'")
    read = lambda c: F.from_xml(c, ITEM, {"mode": "PERMISSIVE"})
    rows = rows.withColumn("x", read("v"))
    rows = rows.withColumn("x", F.when(F.col("x.link").isNotNull(), F.col("x")).otherwise(read(repaired(F.col("v")))))
    clean = {k: stripped(F.coalesce(F.col(f"x.{k}"), F.lit(""))) for k in ("link", "pubDate", "domain", "title")}
    out = rows.select("path", "line", clean["link"].alias("link"), dates.mail_date(clean["pubDate"]).alias("pub_date"), F.lower(clean["domain"]).alias("domain"), clean["title"].alias("title"), F.col("x.source._url").alias("source_url"), F.col("x.source._mcSourceId").alias("mc_source_id"))
    return out.where("link <> ''")


def dump_discovery(items: DataFrame, domains: list[str], route: str = "dump") -> DataFrame:
    """Rows of a discovery table from dump_items with a column ``day``: candidates by host, one for each day and URL, the
    first in the dump."""
    hosts = [urls.host(F.col("link")), F.col("domain"), urls.host(F.col("source_url"))]
    rows = items.where(urls.is_candidate(hosts, domains)).withColumn("url", urls.canonical(F.col("link")))
    rows = first_of_day(rows, "day", "url", "line")
    return rows.select(F.lit(route).alias("route"), "day", "url", "link", urls.host(F.col("url")).alias("host"), "pub_date", "domain", "title", "source_url", "mc_source_id")


def sitemap_index(spark: SparkSession, path: str) -> DataFrame:
    """(loc, lastmod, month) of the children of sitemap indexes, gzipped or not."""
    rows = spark.read.format("xml").options(rowTag="sitemap", ignoreNamespace="true").schema("loc string, lastmod string").load(path)
    loc = F.trim("loc")
    return rows.where("trim(loc) <> ''").select(loc.alias("loc"), dates.iso(F.col("lastmod")).alias("lastmod"), child_month(loc).alias("month"))


def sitemap_urls(spark: SparkSession, path: str) -> DataFrame:
    """(path, loc, lastmod, pub_date, title) of the pages in sitemaps, gzipped or not."""
    schema = "loc string, lastmod string, news struct<publication_date string, title string>"
    rows = spark.read.format("xml").options(rowTag="url", ignoreNamespace="true").schema(schema).load(path).withColumn("path", F.input_file_name())
    return rows.where("trim(loc) <> ''").select("path", F.trim("loc").alias("loc"), dates.iso(F.col("lastmod")).alias("lastmod"), dates.iso(F.col("news.publication_date")).alias("pub_date"), F.trim("news.title").alias("title"))


def child_month(url: Column) -> Column:
    """First day of the month that a sitemap's URL names: its last two numbers are a year and a month. Null if they aren't."""
    found = F.regexp_extract_all(url, F.lit(r"(\d+)"), F.lit(1))
    number = lambda i: F.try_element_at(found, F.lit(i)).try_cast("int")
    y, m = number(-2), number(-1)
    return F.when(y.between(1990, 2100) & m.between(1, 12), F.make_date(y, m, F.lit(1)))


def month_overlaps(month: Column, first: date, last: date) -> Column:
    return (month <= F.lit(last)) & (F.add_months(month, 1) > F.lit(first))


def sitemap_discovery(pages: DataFrame, children: DataFrame, registry: DataFrame, outlet: str, first: date, last: date, include: str = "", route: str = "sitemap") -> DataFrame:
    """Rows of a discovery table. ``pages``: sitemap_urls with ``child``, the sitemap's URL; ``children``: sitemap_index.

    A child that names a month counts if that overlaps the window, another one if its page's median day or a page beside
    it does. A page's day is its publication's, else its sitemap's month or median day."""
    named = children.where(F.col("loc").rlike(include)) if include else children
    middle = pages.groupBy("child").agg(F.to_date(F.timestamp_micros(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY unix_micros(lastmod))").cast("bigint"))).alias("median_day"))
    known = named.select(F.col("loc").alias("child"), "month").join(middle, "child", "left").withColumn("guess", F.coalesce("month", "median_day"))
    near = known.where(F.when(F.col("month").isNotNull(), month_overlaps(F.col("month"), first, last)).otherwise(F.coalesce(F.col("median_day").between(F.date_sub(F.lit(first), 31), F.date_add(F.lit(last), 31)), F.lit(True))))
    rows = pages.join(F.broadcast(near.select("child", "guess")), "child").withColumn("url", urls.canonical(F.col("loc"))).withColumn("host", urls.host(F.col("url")))
    owned = outlet_of(rows, "host", registry).where(F.col("outlet_id") == outlet)
    return owned.select(F.lit(route).alias("route"), "outlet_id", "url", "host", F.coalesce(F.to_date("pub_date"), "guess").alias("day"), "pub_date", "lastmod", "title", F.col("child").alias("source"))


def anchors(page: Column) -> Column:
    """array<struct<href, classes>> of a page's links in order; an empty page has none."""
    tags = F.regexp_extract_all(F.coalesce(page, F.lit("")), F.lit(r"(?i)<a\s[^>]*>"), F.lit(0))
    value = lambda tag, name: F.regexp_replace(F.regexp_extract(tag, rf"""(?i)\s{name}\s*=\s*("[^"]*"|'[^']*')""", 1), r"""^["']|["']$""", "")
    return F.transform(tags, lambda x: F.struct(value(x, "href").alias("href"), F.split(value(x, "class"), r"\s+").alias("classes")))


def _hrefs(page: Column) -> Column:
    return F.transform(anchors(page), lambda a: a["href"])


def listing_links(page: Column, base: str, day: Column, slug: str) -> Column:
    """Item pages, base/day/slug/name/number, that a day's listing of a source links to, in order, each once."""
    under = F.concat(F.lit(f"{base}/"), day.cast("string"), F.lit(f"/{slug}/"))
    rest = lambda h: F.split(F.substr(h, F.length(under) + 1), "/")
    item = lambda h: F.startswith(h, under) & (F.size(rest(h)) == 2) & rest(h)[1].rlike("^[0-9]+$") & (rest(h)[0] != "")
    return F.array_distinct(F.filter(_hrefs(page), item))


def listing_pages(page: Column, slug: str, section: str | None = None, marker: str = "izvor") -> Column:
    """The highest page number that a listing links to, as .../marker/slug[/section]/number; 1 if none."""
    wanted = [marker, slug, *([section] if section else [])]
    n = len(wanted)
    parts = F.transform(_hrefs(page), lambda h: F.split(h, "/"))
    ends = F.filter(parts, lambda p: (F.size(p) > n) & (F.slice(p, F.greatest(F.size(p) - n, F.lit(1)), F.lit(n)) == F.array(*map(F.lit, wanted))))
    numbers = F.transform(ends, lambda p: F.element_at(p, -1).try_cast("int"))
    return F.coalesce(F.array_max(numbers), F.lit(1))


def listing_source(page: Column, button: str = "src-btn") -> Column:
    """The page that an item page leads to: the first link to a web address that is dressed as a source button."""
    found = F.filter(anchors(page), lambda a: a["href"].rlike("^https?://") & F.array_contains(a["classes"], button))
    return F.get(found, F.lit(0))["href"]


def stories(page: Column, base: str, begin: str = 'id="storyBrowser"', end: str = 'aria-label="Pagination"', dress: str = "largeThumb") -> Column:
    """array<struct<url, id>> of a section page's own stories, in order, each once: links of the class ``dress`` to .html
    pages with a number of six to eight digits in their path, between the marks ``begin`` and ``end``."""
    start = F.locate(begin, page)
    inside = F.substring_index(F.substr(page, start), end, 1)
    number = lambda h: F.get(F.filter(F.split(h, "/"), lambda x: x.rlike("^[0-9]{6,8}$")), F.lit(0))
    found = F.filter(anchors(inside), lambda a: F.array_contains(a["classes"], dress) & F.startswith(a["href"], F.lit("/")) & F.endswith(a["href"], F.lit(".html")) & number(a["href"]).isNotNull())
    made = F.transform(F.array_distinct(F.transform(found, lambda a: a["href"])), lambda h: F.struct(F.concat(F.lit(base), h).alias("url"), number(h).cast("bigint").alias("id")))
    return F.when(start > 0, made).otherwise(F.array().cast("array<struct<url:string,id:bigint>>"))


def listing_discovery(fetched: DataFrame, base: str, slug: str, first: date, last: date, sections: list[str | None], route: str = "listing") -> DataFrame:
    """Rows of a discovery table from a source's daily listings. ``fetched``: (day, section, page, html), a row for each
    listing page that was asked for; html is null where that failed.

    A day counts only as a whole: of each section all pages must be there, up to the highest number that one of its pages
    links to. Of a URL that several sections list on a day one row stays, that of the first section and page."""
    rows = fetched.where(F.col("day").between(F.lit(first), F.lit(last))).where(F.col("html").isNotNull())
    last_page = F.lit(1)
    for s in sections:
        last_page = F.when(F.col("section").eqNullSafe(F.lit(s)), listing_pages(F.col("html"), slug, s)).otherwise(last_page)
    per_section = rows.withColumn("_last", last_page).groupBy("day", "section").agg(F.count_distinct("page").alias("there"), F.max("_last").alias("due"))
    wanted = F.lit(False)
    for s in sections:
        wanted = wanted | F.col("section").eqNullSafe(F.lit(s))
    whole = per_section.where(wanted & (F.col("there") >= F.col("due"))).groupBy("day").agg(F.count("*").alias("n")).where(F.col("n") == len(sections)).select("day")
    order = F.array_position(F.array(*[F.lit(s or "") for s in sections]), F.coalesce("section", F.lit("")))
    found = rows.join(whole, "day").select("day", order.alias("_section"), "page", F.posexplode(listing_links(F.col("html"), base, F.col("day"), slug)).alias("_at", "link"))
    found = found.withColumn("url", urls.canonical(F.col("link"))).withColumn("_order", F.struct("_section", "page", "_at"))
    return first_of_day(found, "day", "url", "_order").select(F.lit(route).alias("route"), "day", "url", "link", urls.host(F.col("url")).alias("host"))


def section_discovery(fetched: DataFrame, base: str, curve: DataFrame, first: date, last: date, route: str = "section_listing", margin: int = 3) -> DataFrame:
    """Rows of a discovery table from section pages (html) whose stories carry numbers but no dates: numbers within the
    bounds of the window, each dated by ``curve`` (day, id) and kept if its day is in the window, once for each day and URL."""
    found = fetched.select(F.explode(stories(F.col("html"), base)).alias("s")).select(F.col("s.url").alias("link"), F.col("s.id").alias("number")).distinct()
    near = found.join(F.broadcast(bounds(curve, first, last, margin)), F.col("number").between(F.col("lo"), F.col("hi"))).drop("lo", "hi")
    dated = day_of(near, "number", curve).where(F.col("day").between(F.lit(first), F.lit(last))).withColumn("url", urls.canonical(F.col("link")))
    return first_of_day(dated, "day", "url", "link").select(F.lit(route).alias("route"), "day", "url", "link", urls.host(F.col("url")).alias("host"), "number")

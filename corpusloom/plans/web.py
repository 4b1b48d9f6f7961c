"""Queries over pages and their URLs."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import dates, urls
from corpusloom.operators import discovery, pages
from corpusloom.session import load

REGISTRY = [("com", ["example.com"], ["m.example.com"]), ("net", ["example.net"], []), ("netm", ["m.example.net"], []), ("org", ["example.org"], [])]
RULES = [("com", "fr", "", "french"), ("net", "de", "", "german"), ("org", "*", "blog.example.org", "blog")]


def _with_outlet(spark, sf):
    p = load(spark, sf, "pages").select("page_id", "url", urls.host(F.col("url")).alias("host"))
    registry = spark.createDataFrame(REGISTRY, "outlet_id string, domains array<string>, exclude_hosts array<string>")
    return discovery.outlet_of(p, "host", registry)


def canonical_urls(spark, sf):
    messy = F.concat(F.upper(F.regexp_extract("url", "^[a-z]+://[^/?#]*", 0)), F.regexp_replace("url", "^[a-z]+://[^/?#]*", ""), F.when(F.contains("url", F.lit("#")), "").otherwise("#top"))
    return load(spark, sf, "pages").select("page_id", urls.canonical(messy).alias("url"))


def hosts(spark, sf):
    return load(spark, sf, "pages").select("page_id", urls.host(F.col("url")).alias("host"), urls.section(F.col("url")).alias("section"))


def candidate_hosts(spark, sf):
    h = urls.host(F.col("url"))
    return load(spark, sf, "pages").select("page_id", urls.is_candidate([h], ["example.com"], ".net").alias("candidate"))


def registry_match(spark, sf):
    return _with_outlet(spark, sf).select("page_id", "outlet_id")


def nonnews_reason(spark, sf):
    rules = spark.createDataFrame(RULES, "outlet_id string, segment string, host string, reason string")
    return discovery.nonnews(_with_outlet(spark, sf), "url", "outlet_id", rules).select("page_id", "reason")


def soft_404(spark, sf):
    p = load(spark, sf, "pages")
    asked = F.concat(F.lit("https://x.org/a/"), (F.col("page_id") * 731).cast("string"), F.lit("/t.html"))
    got = F.when(F.col("page_id") % 3 == 0, "https://x.org/a/").when(F.col("page_id") % 3 == 1, F.concat(F.lit("https://x.org/b/"), (F.col("page_id") * 731).cast("string"), F.lit("-t"))).otherwise(asked)
    return p.select("page_id", urls.soft_404(asked, got).alias("lost"))


def article_ids(spark, sf):
    made = F.concat(F.lit("https://x.org/a/"), (F.col("page_id") * 731).cast("string"), F.when(F.col("page_id") % 2 == 0, "/x").otherwise("-x"))
    return load(spark, sf, "pages").select("page_id", urls.article_number(made).alias("number"))


def page_titles(spark, sf):
    return load(spark, sf, "pages").select("page_id", pages.title(F.col("html")).alias("title"))


def extract_pages(spark, sf):
    r = pages.records(load(spark, sf, "pages", spread=True))
    return r.select("page_id", "section", "script", "n_chars", "body_hash", F.size("para_offsets").alias("paragraphs"), "error")


#: Outlet to the path of its container.
CONTAINERS = {"r0": "//body/div[contains(concat(' ', normalize-space(@class), ' '), ' ad ')]", "r1": "//article/p[2]", "r2": "//article[not(@class) and not(@id)]"}


def container_blocks(spark, sf):
    """The blocks of containers that paths lead to: adverts, second paragraphs, whole articles."""
    p = load(spark, sf, "pages", spread=True).select("page_id", "html", F.concat(F.lit("r"), (F.col("page_id") % 3).cast("string")).alias("rule"))
    rule = F.create_map(*[F.lit(x) for pair in CONTAINERS.items() for x in pair])[F.col("rule")]
    read = pages.reader()(F.col("html"), rule)["blocks"]
    return p.select("page_id", read.alias("blocks")).select("page_id", F.size("blocks").alias("n"), F.get("blocks", F.lit(0)).alias("first_block"))


def page_dates(spark, sf):
    """Dates put into pages in several ways."""
    id = F.col("page_id")
    day = F.date_format(F.expr("date_add(DATE'2024-11-01', cast(page_id % 100 AS int))"), "yyyy-MM-dd")
    said = F.when(id % 4 == 0, F.concat(F.lit('{"datePublished": "'), day, F.lit('T10:30:00+01:00"}'))).when(id % 4 == 1, F.concat(F.lit('<meta property="article:published_time" content="'), day, F.lit('T10:30:00Z">'))).when(id % 4 == 2, F.concat(F.lit('{"datePublished": "'), day, F.lit('T10:30:00"}')))
    page = F.concat(F.coalesce(said, F.lit("")), F.col("html"))
    return load(spark, sf, "pages").select("page_id", F.date_format(dates.page_date(page), "yyyy-MM-dd HH:mm").alias("published"))


def json_attrs(spark, sf):
    k = F.from_json("props", "k bigint")["k"]
    return load(spark, sf, "events").groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).alias("total"))


QUERIES = {f.__name__: f for f in (canonical_urls, hosts, candidate_hosts, registry_match, nonnews_reason, soft_404, article_ids, page_titles, extract_pages, container_blocks, page_dates, json_attrs)}

H = r"WITH h AS (SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\.', '') AS host, lower(regexp_extract(url, '^[a-z]+://[^/?#]*/([^/?#]*)', 1)) AS section FROM pages) "


def _under(d: str) -> str:
    return f"(host = '{d}' OR host LIKE '%.{d}')"


O = H + f", o AS (SELECT *, CASE WHEN {_under('m.example.com')} THEN NULL WHEN {_under('m.example.net')} THEN 'netm' WHEN {_under('example.com')} THEN 'com' WHEN {_under('example.net')} THEN 'net' WHEN {_under('example.org')} THEN 'org' END AS outlet_id FROM h) "
#: Text of a block: without tags, the references that pages have decoded, white space squeezed.
PLAIN = r"trim(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(block, '<br>', ' ', 'g'), '<[^>]+>', '', 'g'), '&quot;?', chr(34), 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g'))"
ORACLE_SQL = {
    "canonical_urls": "SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '[?&]utm_source=[^&]*$', '') AS url FROM pages",
    "hosts": H + "SELECT page_id, host, section FROM h",
    "candidate_hosts": H + f"SELECT page_id, host LIKE '%.net' OR {_under('example.com')} AS candidate FROM h",
    "registry_match": O + "SELECT page_id, outlet_id FROM o",
    "nonnews_reason": O + "SELECT page_id, CASE WHEN host = 'blog.example.org' THEN 'blog' WHEN outlet_id = 'com' AND section = 'fr' THEN 'french' WHEN outlet_id = 'net' AND section = 'de' THEN 'german' END AS reason FROM o",
    "soft_404": "SELECT page_id, page_id * 731 >= 1000 AND page_id % 3 = 0 AS lost FROM pages",
    "article_ids": "SELECT page_id, CASE WHEN page_id % 2 = 0 AND page_id * 731 BETWEEN 10000 AND 99999999 THEN page_id * 731 END AS number FROM pages",
    "page_titles": r"SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(regexp_extract(html, '(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>', 1), '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS title FROM pages".replace('\\"', '"'),
    "container_blocks": f"""WITH a AS (SELECT page_id, page_id % 3 AS kind, regexp_extract(html, '(?s)<div class="ad">(.*?)</div>', 1) AS ad, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS art FROM pages),
      p AS (SELECT page_id, kind, unnest(CASE WHEN kind = 0 THEN string_split(ad, chr(10)) ELSE string_split(art, '<p>')[2:] END) AS block, generate_subscripts(CASE WHEN kind = 0 THEN string_split(ad, chr(10)) ELSE string_split(art, '<p>')[2:] END, 1) AS k FROM a),
      t AS (SELECT page_id, kind, k, {PLAIN} AS block FROM p), u AS (SELECT *, max(k) FILTER (kind = 1) OVER (PARTITION BY page_id) AS last FROM t WHERE block <> '')
      SELECT page_id, CAST(count(*) AS INT) AS n, arg_min(block, k) AS first_block FROM u WHERE kind <> 1 OR last < 2 OR k = 2 GROUP BY page_id""",
    "page_dates": "SELECT page_id, CASE WHEN page_id % 4 < 2 THEN strftime(DATE '2024-11-01' + CAST(page_id % 100 AS INT), '%Y-%m-%d') || CASE WHEN page_id % 4 = 0 THEN ' 09:30' ELSE ' 10:30' END END AS published FROM pages",
    "json_attrs": "SELECT event_type, count(props->>'k') AS n, CAST(sum(CAST(props->>'k' AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY event_type",
}

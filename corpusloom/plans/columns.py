"""Queries that hold single functions and small operators against SQL, over inputs made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import dates
from corpusloom.functions import text as tx
from corpusloom.operators import band, discovery, judging, lexicon, release
from corpusloom.operators import log as lg
from corpusloom.session import load

LOWER, CYRILLIC = "abvgdežzijklmnoprstufhcčš", "абвгдежзијклмнопрстуфхцчш"
GENESIS = 1_595_431_050


def _scripts(spark, sf):
    """Documents in Cyrillic, in both scripts, or as they are."""
    d = load(spark, sf, "documents", spread=True)
    t = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Љиља Џон Њ. "), F.translate("text", LOWER, CYRILLIC))).when(F.col("doc_id") % 3 == 1, F.translate("text", "ae", "ае")).otherwise(F.col("text"))
    return d.select("doc_id", "source", t.alias("t"))


def latin_texts(spark, sf):
    return _scripts(spark, sf).select("doc_id", F.md5(tx.to_latin(F.col("t"))).alias("digest"))


def scripts(spark, sf):
    rows = _scripts(spark, sf).withColumn("share", tx.cyrillic_share(F.col("t")))
    return rows.select("doc_id", F.round("share", 6).alias("share"), tx.script(F.col("share")).alias("script"))


def headlines_dropped(spark, sf):
    d = load(spark, sf, "documents")
    body = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" \n\n"), F.col("source"), F.lit("\n"), F.col("text"))).otherwise(F.col("text"))
    return d.select("doc_id", F.md5(tx.without_headline(body, F.concat(F.upper("source"), F.lit("!")))).alias("digest"))


def _stamp(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def mail_dates(spark, sf):
    e = load(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    zone = F.when(F.col("event_id") % 3 == 0, " +0100").when(F.col("event_id") % 3 == 1, " -0530").otherwise(" GMT")
    said = F.when(F.col("event_id") % 7 == 0, F.lit("some day")).otherwise(F.concat(F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss"), zone))
    return e.select("event_id", _stamp(dates.mail_date(said)).alias("at"))


def iso_dates(spark, sf):
    e = load(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    zone = F.when(F.col("event_id") % 3 == 0, "+01:00").when(F.col("event_id") % 3 == 1, "Z").otherwise("")
    said = F.when(F.col("event_id") % 7 == 0, F.lit("T10:00")).otherwise(F.concat(F.lit(" "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), zone))
    return e.select("event_id", _stamp(dates.iso(said)).alias("at"), _stamp(dates.zoned(said)).alias("zoned_at"))


def local_times(spark, sf):
    e = load(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    said = F.concat(F.lit("on "), F.date_format("ts", "d.M.yyyy, HH:mm"), F.lit(" h"))
    return e.select("event_id", _stamp(dates.local(said, r"(\d+)\.(\d+)\.(\d+), (\d+):(\d+)", "Europe/Belgrade")).alias("at"))


def day_ranges(spark, sf):
    first = F.expr("date_add(DATE'2024-01-01', cast(page_id % 300 AS int))")
    rows = load(spark, sf, "pages").select("page_id", F.explode(dates.days(first, F.date_add(first, (F.col("page_id") % 4).cast("int")))).alias("d"))
    return rows.select("page_id", F.col("d").cast("string").alias("day"))


def beacon_rounds(spark, sf):
    ts = F.col("ts").cast("timestamp")
    n = dates.round_of(ts, GENESIS)
    return load(spark, sf, "events").select("event_id", n.alias("round"), _stamp(dates.time_of(n, GENESIS)).alias("round_at"))


def seeds(spark, sf):
    """Seeds from the texts' hashes, which stand in for a beacon's randomness."""
    randomness = F.sha2("text", 256)
    return load(spark, sf, "documents").select("doc_id", dates.beacon_holds(F.hex("text"), F.upper(randomness)).alias("holds"), dates.seed_of(randomness, "sample").alias("seed"))


def judge_requests(spark, sf):
    lines = judging.judge_requests(load(spark, sf, "documents"), "doc_id", F.col("text"), "m-1", "Judge it.", '{"type":"object"}')
    at = lambda p: F.get_json_object("line", p)
    return lines.select(
        at("$.custom_id").cast("bigint").alias("doc_id"), F.md5(at("$.params.messages[0].content")).alias("digest"), at("$.params.model").alias("model"), at("$.params.system[0].text").alias("system"), at("$.params.max_tokens").cast("bigint").alias("most"), at("$.params.output_config.format.schema.type").alias("kind")
    )


def vector_lines(spark, sf):
    """Vectors that came back as lines of JSON, some cut short, some with an error."""
    n = F.col("vec_id")
    v = F.when(n % 5 == 0, F.slice("embedding", 1, 7)).otherwise(F.col("embedding"))
    line = F.when(n % 7 == 0, F.to_json(F.struct(n.cast("string").alias("key"), F.lit("quota").alias("error")))).otherwise(F.to_json(F.struct(n.cast("string").alias("key"), F.struct(F.struct(v.alias("values")).alias("embedding")).alias("response"))))
    got = judging.embedded(load(spark, sf, "embeddings").select(line.alias("value")), 64)
    return got.select(F.col("key").cast("bigint").alias("vec_id"), F.size("vector").cast("bigint").alias("dims"), F.round(F.get("vector", F.lit(3)).cast("double"), 4).alias("fourth"), "error")


def decisions(spark, sf):
    """Answers in JSON to the labelled documents, some unreadable, some failed."""
    n, yes = F.col("doc_id"), F.col("quality") == 1
    answer = F.when(n % 11 == 0, F.lit("not json")).otherwise(F.to_json(F.struct(yes.alias("in_scope"), F.when(yes, F.array(n % 4 + 1, F.lit(1).cast("bigint"))).otherwise(F.array().cast("array<bigint>")).alias("clauses"), F.lit("p1").alias("evidence"), F.lit("high").alias("confidence"))))
    rows = load(spark, sf, "labels").select("doc_id", F.when(n % 5 == 0, "errored").otherwise("succeeded").alias("status"), answer.alias("answer"))
    return judging.judged(rows).select("doc_id", "status", "in_scope", F.array_join("clauses", ",").alias("clauses"), "evidence", "confidence")


def _band(spark, sf):
    n = F.col("vec_id")
    stratum = F.when(n % 4 == 0, "candidate").when(n % 4 == 1, "band-top10").when(n % 4 == 2, "band-next20").otherwise("rest")
    return load(spark, sf, "embeddings").select(n.alias("event_id"), F.col("label").cast("double").alias("score"), stratum.alias("stratum"))


def scope_rows(spark, sf):
    """The scope of documents from their terms, strata and decisions."""
    n = F.col("doc_id")
    d = load(spark, sf, "documents")
    lex = d.select(n.alias("event_id"), (n % 3 == 0).alias("candidate"), (n % 5).alias("hit_process"))
    made = load(spark, sf, "labels").select(n.alias("event_id"), F.when(F.col("toxic") == 0, "succeeded").otherwise("errored").alias("status"), (F.col("quality") == 1).alias("in_scope"), F.array(n % 4).alias("clauses"), F.concat(F.lit("see p"), (n % 9).cast("string"), F.lit(" and lead")).alias("evidence"), F.lit("low").alias("confidence"))
    s = release.scope(lex, _band(spark, sf), made, d.where("doc_id % 6 <> 0").select(n.alias("event_id")), ["process"])
    return s.select("event_id", "lexicon_candidate", "hit_process", "band_score", "band_stratum", "classified", "classifier_in_scope", "classifier_evidence", "in_scope")


def classifier_targets(spark, sf):
    """Documents of the strata that the classifier reads, without those that failed and only labelled ones."""
    docs = load(spark, sf, "documents").select(F.col("doc_id").alias("event_id"), F.when(F.col("doc_id") % 13 == 0, "no text").alias("error"))
    ids = load(spark, sf, "labels").select(F.col("doc_id").alias("event_id"))
    return judging.targets(docs, _band(spark, sf), release.READ, ids).select("event_id", "stratum")


def token_costs(spark, sf):
    n = F.col("doc_id")
    cost = judging.token_cost(F.col("n_chars"), n % 500, F.when(n % 3 == 0, n % 70), F.lit(120), (3.0, 15.0), batch=False)
    half = judging.token_cost(F.col("n_chars"), n % 500, F.when(n % 3 == 0, n % 70), F.lit(120), (3.0, 15.0))
    return load(spark, sf, "documents").select("doc_id", F.round(cost, 9).alias("cost"), F.round(half, 9).alias("batch_cost"))


def searched_texts(spark, sf):
    """Documents with and without lemmas."""
    n = F.col("doc_id")
    docs = load(spark, sf, "documents").select(n.alias("event_id"), F.col("source").alias("title"), F.lit(None).cast("string").alias("lead"), F.col("text").alias("body"), F.when(n % 13 == 0, "no text").alias("error"))
    lemmas = load(spark, sf, "labels").where("quality = 1").select(n.alias("event_id"), F.concat(F.lit("Lemma "), n.cast("string")).alias("lemmas_title"), F.lit("B").alias("lemmas_body"))
    return lexicon.searchable(docs, lemmas).select("event_id", F.md5("searched").alias("digest"))


def vector_sources(spark, sf):
    """Vectors with the source of their document, where there is one."""
    outlets = load(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "source")
    return band.with_outlet(load(spark, sf, "embeddings").select("vec_id", "label"), outlets, "vec_id", "source")


def raw_objects(spark, sf):
    """Pages looked up by the hash that the log has of them; some objects are missing, some were changed."""
    p = load(spark, sf, "pages").select("page_id", F.sha2("html", 256).alias("content_sha256"), "html")
    stored = p.where("page_id % 5 <> 0").select("content_sha256", F.when(F.col("page_id") % 7 == 0, F.upper("html")).otherwise(F.col("html")).alias("content"))
    return lg.objects(p.select("page_id", "content_sha256"), stored).select("page_id", "state", F.length("content").cast("bigint").alias("chars"))


def probe_outcomes(spark, sf):
    n = F.col("page_id")
    status = F.when(n % 7 == 0, 404).otherwise(200)
    page = F.when(n % 5 == 0, F.col("html")).otherwise(F.concat(F.lit("<link rel='canonical' href='https://x.org/v/"), (n * 731).cast("string"), F.lit("/t.html'>"), F.col("html")))
    url = discovery.probed_url(page, status)
    return load(spark, sf, "pages").select("page_id", url.alias("url"), discovery.probe_outcome(n % 11 != 0, url, n % 3 == 0, 2).alias("outcome"))


QUERIES = {
    f.__name__: f
    for f in (
        latin_texts, scripts, headlines_dropped, mail_dates, iso_dates, local_times, day_ranges, beacon_rounds, seeds, judge_requests, vector_lines, decisions, scope_rows, classifier_targets, token_costs, searched_texts, vector_sources,
        raw_objects, probe_outcomes,
    )
}

T = f"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Љиља Џон Њ. ' || translate(text, '{LOWER}', '{CYRILLIC}') WHEN doc_id % 3 = 1 THEN translate(text, 'ae', 'ае') ELSE text END AS t FROM documents) """
_LATIN = "translate(" + "replace(" * len(tx.DIGRAPHS) + "t" + "".join(f", '{a}', '{b}')" for a, b in tx.DIGRAPHS.items()) + f", '{tx.CYRILLIC}{tx.CYRILLIC.lower()}', '{tx.LATIN}{tx.LATIN.lower()}')"
_AT = "strftime(date_trunc('second', ts) {}, '%Y-%m-%d %H:%M:%S')"
B = "WITH b AS (SELECT vec_id AS event_id, CAST(label AS DOUBLE) AS score, ['candidate', 'band-top10', 'band-next20', 'rest'][vec_id % 4 + 1] AS stratum FROM embeddings) "
_COST = "(n_chars * 3.0::DOUBLE + (doc_id % 500) * 3.0::DOUBLE * 0.1::DOUBLE + CASE WHEN doc_id % 3 = 0 THEN doc_id % 70 ELSE 0 END * 3.0::DOUBLE * 1.25::DOUBLE + 120 * 15.0::DOUBLE) / 1e6::DOUBLE"
ORACLE_SQL = {
    "latin_texts": T + f"SELECT doc_id, md5({_LATIN}) AS digest FROM t",
    "scripts": T + r"""SELECT doc_id, round(s, 6) AS share, CASE WHEN s > 0.6 THEN 'cyrl' WHEN s > 0.1 THEN 'mixed' ELSE 'latn' END AS script FROM (SELECT doc_id, coalesce(length(regexp_replace(t, '[^\x{400}-\x{4FF}]', '', 'g')) / nullif(length(regexp_replace(t, '[^\p{L}\p{Nl}\p{No}]', '', 'g')), 0), 0) AS s FROM t)""",
    "headlines_dropped": r"SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN text ELSE regexp_replace(text, '^([^\S\n]*\n)+', '') END) AS digest FROM documents",
    "mail_dates": f"SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 3 = 0 THEN {_AT.format('- INTERVAL 60 MINUTE')} WHEN event_id % 3 = 1 THEN {_AT.format('+ INTERVAL 330 MINUTE')} ELSE {_AT.format('')} END AS at FROM events",
    "iso_dates": f"SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 3 = 0 THEN {_AT.format('- INTERVAL 60 MINUTE')} ELSE {_AT.format('')} END AS at, CASE WHEN event_id % 7 = 0 OR event_id % 3 = 2 THEN NULL WHEN event_id % 3 = 0 THEN {_AT.format('- INTERVAL 60 MINUTE')} ELSE {_AT.format('')} END AS zoned_at FROM events",
    "local_times": "SELECT event_id, strftime(date_trunc('minute', ts) - INTERVAL 60 MINUTE, '%Y-%m-%d %H:%M:%S') AS at FROM events",
    "day_ranges": "SELECT page_id, CAST(CAST(unnest(generate_series(f, f + CAST(page_id % 4 AS INT), INTERVAL 1 DAY)) AS DATE) AS VARCHAR) AS day FROM (SELECT page_id, DATE '2024-01-01' + CAST(page_id % 300 AS INT) AS f FROM pages)",
    "beacon_rounds": f"SELECT event_id, r AS round, strftime(make_timestamp(((r - 1) * 30 + {GENESIS}) * 1000000), '%Y-%m-%d %H:%M:%S') AS round_at FROM (SELECT event_id, (epoch_us(date_trunc('second', ts)) // 1000000 - {GENESIS}) // 30 + 1 AS r FROM events)",
    "seeds": "SELECT doc_id, true AS holds, CAST(CAST('0x' || substr(sha256(unhex(sha256(text)) || 'sample'::BLOB), 1, 16) AS UBIGINT) AS VARCHAR) AS seed FROM documents",
    "judge_requests": "SELECT doc_id, md5(text) AS digest, 'm-1' AS model, 'Judge it.' AS system, CAST(4000 AS BIGINT) AS most, 'object' AS kind FROM documents",
    "vector_lines": """SELECT vec_id, CASE WHEN vec_id % 7 <> 0 AND vec_id % 5 <> 0 THEN len(embedding) END AS dims, CASE WHEN vec_id % 7 <> 0 AND vec_id % 5 <> 0 THEN round(CAST(embedding[4] AS DOUBLE), 4) END AS fourth,
      CASE WHEN vec_id % 7 = 0 THEN 'quota' WHEN vec_id % 5 = 0 THEN 'bad vector of length 7' END AS error FROM embeddings""",
    "decisions": """WITH x AS (SELECT *, doc_id % 5 <> 0 AND doc_id % 11 <> 0 AS ok FROM labels) SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'errored' WHEN ok THEN 'succeeded' ELSE 'unparsed' END AS status, CASE WHEN ok THEN quality = 1 END AS in_scope,
      CASE WHEN ok THEN CASE WHEN quality = 0 THEN '' WHEN doc_id % 4 = 0 THEN '1' ELSE '1,' || (doc_id % 4 + 1) END END AS clauses, CASE WHEN ok THEN 'p1' END AS evidence, CASE WHEN ok THEN 'high' END AS confidence FROM x""",
    "scope_rows": B
    + """, x AS (SELECT d.doc_id AS event_id, d.doc_id % 3 = 0 AS lexicon_candidate, d.doc_id % 5 AS hit_process, score AS band_score, stratum AS band_stratum, l.doc_id IS NOT NULL AS made, quality = 1 AS yes FROM documents d LEFT JOIN b ON b.event_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id AND toxic = 0 WHERE d.doc_id % 6 <> 0),
      r AS (SELECT *, made AND coalesce(band_stratum IN ('candidate', 'band-top10'), false) AS classified FROM x)
      SELECT event_id, lexicon_candidate, hit_process, band_score, band_stratum, classified, yes AS classifier_in_scope, CASE WHEN made THEN 'p' || event_id % 9 || ', lead' END AS classifier_evidence, classified AND coalesce(yes, false) AS in_scope FROM r""",
    "classifier_targets": B + "SELECT event_id, stratum FROM b WHERE stratum IN ('candidate', 'band-top10') AND event_id IN (SELECT doc_id FROM documents WHERE doc_id % 13 <> 0) AND event_id IN (SELECT doc_id FROM labels)",
    "token_costs": f"SELECT doc_id, round({_COST}, 9) AS cost, round({_COST} / 2, 9) AS batch_cost FROM documents",
    "searched_texts": "SELECT d.doc_id AS event_id, md5(lower(source || chr(10) || chr(10) || text) || CASE WHEN quality = 1 THEN chr(10) || 'lemma ' || d.doc_id || chr(10) || 'b' ELSE '' END) AS digest FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE d.doc_id % 13 <> 0",
    "vector_sources": "SELECT vec_id, label, source FROM embeddings LEFT JOIN documents ON doc_id = vec_id",
    "raw_objects": """WITH s AS (SELECT sha256(html) AS h, min(CASE WHEN page_id % 7 = 0 THEN upper(html) ELSE html END) AS c FROM pages WHERE page_id % 5 <> 0 GROUP BY 1)
      SELECT page_id, CASE WHEN c IS NULL THEN 'missing' WHEN sha256(c) = h THEN 'found' ELSE 'changed' END AS state, CASE WHEN sha256(c) = h THEN length(c) END AS chars FROM pages LEFT JOIN s ON h = sha256(html)""",
    "probe_outcomes": """WITH u AS (SELECT page_id, CASE WHEN page_id % 7 <> 0 AND page_id % 5 <> 0 AND page_id * 731 BETWEEN 10000 AND 99999999 AND NOT starts_with(CAST(page_id * 731 AS VARCHAR), '404') THEN 'https://x.org/v/' || page_id * 731 || '/t.html' END AS url FROM pages)
      SELECT page_id, url, CASE WHEN page_id % 11 = 0 THEN 'robots' WHEN url IS NULL THEN 'not_in_sections' WHEN page_id % 3 = 0 THEN 'known' ELSE 'new' END AS outcome FROM u""",
}

"""Queries over documents: search terms, hashes, paragraphs, checks, what models read."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import dialects
from corpusloom.functions import text as tx
from corpusloom.operators import judging, lexicon, parts, quality
from corpusloom.session import load

#: Search terms for the test tables' invented words.
TERMS = lexicon.terms_of(
    [
        ("process", r"\w{3,}tion\b && \bretition\w*"),
        ("process", r"\b(the|that) \w+tion(ing|s)?\b"),
        ("quality", r"\w+keit\b && \bnicht\b"),
        ("quality", r"\b(und|nicht) (der|die|das)\b"),
        ("place", r"\bdans\b && \bavec\b"),
        ("place", r"\bpara (el|la|los|que)\b"),
        ("number", r"\b(15|16) \w+"),
    ]
)
LISTS = list(dict.fromkeys(t.list for t in TERMS))
BOILERPLATE = {"rights": r"all rights reserved|©", "contact": r"^(e-?mail|phone|tel)\b", "license": r"\blicen[cs]e\b"}


def matched(spark, sf, of=None):
    """Documents with their terms; only those whose ids are in ``of``, if it is given."""
    d = load(spark, sf, "documents", spread=True).select("doc_id", "source", F.lower("text").alias("t"))
    return lexicon.match(d if of is None else d.join(of.select("doc_id"), "doc_id", "left_semi"), "t", TERMS)


def lexicon_rate_by_source(spark, sf):
    rows = matched(spark, sf).groupBy("source").agg(F.count("*").alias("docs"), F.count_if("candidate").alias("candidates"))
    return rows.withColumn("rate", F.round(F.col("candidates") / F.col("docs"), 6))


def lexicon_hits(spark, sf):
    return matched(spark, sf).select("doc_id", *[f"hit_{x}" for x in LISTS], "candidate", F.array_join("terms", "; ").alias("terms"))


def lexicon_report_rollup(spark, sf):
    return lexicon.report(matched(spark, sf), "source", LISTS)


def lexicon_per_term(spark, sf):
    return lexicon.per_term(matched(spark, sf), TERMS)


def lexicon_without_list(spark, sf):
    return lexicon.only_through(matched(spark, sf), "process")


def many_terms(spark, sf):
    """A term for each longer word of the benchmark: words of documents that begin with it."""
    words = load(spark, sf, "benchmark").select(F.explode(F.split(F.lower("text"), dialects.OTHER + "+")).alias("w")).where("length(w) >= 6").distinct()
    found = sorted(r["w"] for r in words.limit(lexicon.MOST_TERMS + 1).collect())
    return lexicon.terms_of([("long" if len(w) > 8 else "short", rf"\b{w}\w*") for w in found])


def matched_many(spark, sf):
    d = load(spark, sf, "documents", spread=True).select("doc_id", F.lower("text").alias("t"))
    return lexicon.match_many(d, "t", many_terms(spark, sf))


def lexicon_many_terms(spark, sf):
    terms = F.array_join(F.array_sort("terms"), "; ")
    return matched_many(spark, sf).select("doc_id", "hit_long", "hit_short", "candidate", F.md5(terms).alias("terms_md5"))


def lexicon_many_per_term(spark, sf):
    return lexicon.per_term_many(matched_many(spark, sf))


def body_hash(spark, sf):
    return load(spark, sf, "documents", spread=True).select("doc_id", tx.body_hash(F.col("text")).alias("body_hash"))


def duplicate_bodies(spark, sf):
    return body_hash(spark, sf).groupBy("body_hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def paragraphs(spark, sf):
    rows = load(spark, sf, "documents", spread=True).select("doc_id", F.explode(tx.paragraph_offsets(F.col("text"))).alias("o"))
    return rows.select("doc_id", F.col("o")[0].cast("bigint").alias("begin_at"), F.col("o")[1].cast("bigint").alias("end_at"))


def qa_metrics_by_source(spark, sf):
    return quality.metrics(load(spark, sf, "documents", spread=True), "source", "text", BOILERPLATE)


def article_text(spark, sf):
    d = load(spark, sf, "documents", spread=True).withColumn("offsets", tx.paragraph_offsets(F.col("text")))
    text = tx.article(F.col("source"), F.lit("2024-11-01"), F.lit(None), tx.paragraphs(F.col("text"), F.col("offsets")))
    return d.select("doc_id", F.md5(text).alias("digest"), F.length(text).cast("bigint").alias("chars"))


def embedding_input(spark, sf):
    d = load(spark, sf, "documents")
    text = tx.embedding_input(F.col("source"), F.lit(None).cast("string"), F.col("text"))
    return d.select("doc_id", F.md5(text).alias("digest"), F.length(text).cast("bigint").alias("chars"))


def characters_per_token(spark, sf):
    d = load(spark, sf, "documents").withColumn("tokens", F.size(F.split("text", " ")))
    return quality.characters_per_token(d, "text", "tokens").select(F.round("chars_per_token", 6).alias("chars_per_token"))


def first_batch(spark, sf):
    return judging.first_batch(load(spark, sf, "documents").select("doc_id", "text"), "doc_id", F.octet_length("text"), 300_000).select("doc_id")


def token_portions(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", "source", (F.length("text") / 3).alias("tokens"))
    return judging.portions(d, "source", "doc_id", F.col("tokens"), 5_000)


def evidence_pointers(spark, sf):
    n = F.col("doc_id")
    said = F.concat(F.lit("see p"), (n % 20).cast("string"), F.when(n % 3 == 0, F.concat(F.lit(" - p"), (n % 20 + 2).cast("string"))).otherwise(" and headline"), F.when(n % 5 == 0, ", the lead").otherwise(", leads"))
    rows = load(spark, sf, "documents").select("doc_id", F.when(n % 7 == 0, "none of it").otherwise(said).alias("said"))
    return rows.select("doc_id", tx.evidence_pointers(F.col("said")).alias("pointers"))


def row_signature(spark, sf):
    return load(spark, sf, "documents").select("doc_id", tx.signature(F.col("source"), F.lit(None), F.col("text")).alias("signature"))


def embed_requests(spark, sf):
    d = load(spark, sf, "documents")
    lines = judging.embed_requests(d, "doc_id", tx.embedding_input(F.col("source"), F.lit(None).cast("string"), F.col("text")), 768)
    key = F.get_json_object("line", "$.key").cast("bigint")
    return lines.select(key.alias("doc_id"), F.md5(F.get_json_object("line", "$.request.content.parts[0].text")).alias("digest"), F.get_json_object("line", "$.request.output_dimensionality").cast("bigint").alias("dims"))


def kept_lines(spark, sf):
    """Documents without lines of few words, up to a line that begins with a licence's name."""
    text = tx.kept_lines(F.col("text"), [r"\w+( \w+){0,2}\.?"], [r"(Permission|Licensed|Copyright).*"])
    return load(spark, sf, "documents", spread=True).select("doc_id", F.length(text).cast("bigint").alias("chars"), F.md5(text).alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (
        lexicon_rate_by_source, lexicon_hits, lexicon_report_rollup, lexicon_per_term, lexicon_without_list, lexicon_many_terms, lexicon_many_per_term, body_hash, duplicate_bodies, paragraphs, qa_metrics_by_source,
        article_text, embedding_input, characters_per_token, first_batch, token_portions, evidence_pointers, row_signature, embed_requests, kept_lines,
    )
}

NORMAL = r"trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
#: CTE m: documents with a column of each term (t0 ...), of each list (hit_...), and candidate.
_FLAGS = ", ".join(f"{t.sql('t')} AS t{i}" for i, t in enumerate(TERMS))
_HITS = ", ".join("(" + " + ".join(f"CAST(t{i} AS BIGINT)" for i, t in enumerate(TERMS) if t.list == x) + f") AS hit_{x}" for x in LISTS)
_COUNT = " + ".join(f"CAST(t{i} AS BIGINT)" for i in range(len(TERMS)))
M = f"WITH f AS (SELECT doc_id, source, {_FLAGS} FROM (SELECT doc_id, source, lower(text) AS t FROM documents)), m AS (SELECT *, {_HITS}, ({_COUNT}) AS n_terms, ({_COUNT}) > 0 AS candidate FROM f) "
LINES = "WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) "


def _name(t):
    return f"{t.list}: {t.pattern}".replace("'", "''")


#: CTE h: documents and the terms of many_terms that they have.
H = r"""WITH b AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+')) AS w FROM benchmark) WHERE length(w) >= 6),
  d AS (SELECT DISTINCT doc_id, w FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+')) AS w FROM documents) WHERE length(w) >= 6),
  p AS (SELECT doc_id, left(w, n) AS w FROM (SELECT doc_id, w, unnest(range(6, length(w) + 1)) AS n FROM d)),
  h AS (SELECT DISTINCT doc_id, CASE WHEN length(w) > 8 THEN 'long' ELSE 'short' END AS list, CASE WHEN length(w) > 8 THEN 'long' ELSE 'short' END || ': \b' || w || '\w*' AS term FROM p JOIN b USING (w)) """
_REPEATED = r"""SELECT doc_id, count(*) <> count(DISTINCT p) AS r FROM (SELECT doc_id, regexp_replace(line, '^\s+|\s+$', '', 'g') AS p FROM l) WHERE length(p) > 40 GROUP BY doc_id"""
ORACLE_SQL = {
    "token_portions": """WITH RECURSIVE r AS (SELECT doc_id, source, length(text) / 3 AS s, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
      w(source, k, doc_id, held, portion) AS (SELECT source, k, doc_id, s, 0::bigint FROM r WHERE k = 1
        UNION ALL SELECT r.source, r.k, r.doc_id, CASE WHEN held > 0 AND held + s > 5000 THEN s ELSE held + s END, CASE WHEN held > 0 AND held + s > 5000 THEN portion + 1 ELSE portion END FROM w JOIN r ON r.source IS NOT DISTINCT FROM w.source AND r.k = w.k + 1)
      SELECT source, doc_id, portion FROM w""",
    "lexicon_rate_by_source": M + "SELECT source, count(*) AS docs, CAST(count_if(candidate) AS BIGINT) AS candidates, round(count_if(candidate) / count(*), 6) AS rate FROM m GROUP BY source",
    "lexicon_hits": M + f"SELECT doc_id, {', '.join(f'hit_{x}' for x in LISTS)}, candidate, concat_ws('; ', {', '.join(f"CASE WHEN t{i} THEN '{_name(t)}' END" for i, t in enumerate(TERMS))}) AS terms FROM m",
    "lexicon_report_rollup": M + f"SELECT source, count(*) AS docs, CAST(count_if(candidate) AS BIGINT) AS candidates, {', '.join(f'CAST(count_if(hit_{x} > 0) AS BIGINT) AS docs_{x}' for x in LISTS)} FROM m GROUP BY ROLLUP (source)",
    "lexicon_per_term": M + "SELECT term, count(*) AS docs FROM (" + " UNION ALL ".join(f"SELECT '{_name(t)}' AS term FROM m WHERE t{i}" for i, t in enumerate(TERMS)) + ") GROUP BY term",
    "lexicon_without_list": M + "SELECT CAST(count_if(candidate) AS BIGINT) AS candidates, CAST(count_if(candidate AND hit_process = 0) AS BIGINT) AS without, CAST(count_if(candidate AND hit_process > 0 AND n_terms > 1) AS BIGINT) AS among_others FROM m",
    "lexicon_many_terms": H
    + """, g AS (SELECT doc_id, count(*) FILTER (list = 'long') AS l, count(*) FILTER (list = 'short') AS s, string_agg(term, '; ' ORDER BY term) AS t FROM h GROUP BY doc_id)
      SELECT doc_id, coalesce(l, 0) AS hit_long, coalesce(s, 0) AS hit_short, l IS NOT NULL AS candidate, md5(coalesce(t, '')) AS terms_md5 FROM documents LEFT JOIN g USING (doc_id)""",
    "lexicon_many_per_term": H + "SELECT term, count(*) AS docs FROM h GROUP BY term",
    "body_hash": f"SELECT doc_id, substr(sha256({NORMAL}), 1, 32) AS body_hash FROM documents",
    "duplicate_bodies": f"SELECT substr(sha256({NORMAL}), 1, 32) AS body_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "paragraphs": LINES + r"SELECT doc_id, CAST(b AS BIGINT) AS begin_at, CAST(b + length(line) AS BIGINT) AS end_at FROM (SELECT doc_id, line, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 1 AS b FROM l) WHERE regexp_matches(line, '\S')",
    "qa_metrics_by_source": LINES
    + f""", r AS ({_REPEATED}) SELECT source, count(*) AS n, round(avg(CAST(length(text) < 200 AS DOUBLE)), 6) AS under_200, round(avg(CAST(length(text) < 500 AS DOUBLE)), 6) AS under_500, median(CAST(length(text) AS DOUBLE)) AS median_chars,
      round(avg(CAST(coalesce(r, false) AS DOUBLE)), 6) AS repeated_lines, CAST(0 AS DOUBLE) AS cyrillic, {', '.join(f"round(avg(CAST(regexp_matches(text, '(?im){p}') AS DOUBLE)), 6) AS has_{k}" for k, p in BOILERPLATE.items())}
      FROM documents LEFT JOIN r USING (doc_id) GROUP BY source""",
    "article_text": LINES
    + r""", p AS (SELECT doc_id, string_agg('[p' || k || '] ' || s, chr(10) ORDER BY k) AS body FROM (SELECT doc_id, regexp_replace(line, '^\s+|\s+$', '', 'g') AS s, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM l WHERE regexp_matches(line, '\S')) GROUP BY doc_id),
      a AS (SELECT doc_id, 'Title: ' || source || chr(10) || 'Date: 2024-11-01' || chr(10) || 'Lead: ' || chr(10) || coalesce(chr(10) || body, '') AS t FROM documents LEFT JOIN p USING (doc_id))
      SELECT doc_id, md5(t) AS digest, CAST(length(t) AS BIGINT) AS chars FROM a""",
    "embedding_input": "SELECT doc_id, md5(t) AS digest, CAST(length(t) AS BIGINT) AS chars FROM (SELECT doc_id, 'title: ' || source || ' | text: ' || substr(text, 1, 8000) AS t FROM documents)",
    "characters_per_token": "SELECT round(sum(length(text)) / sum(len(string_split(text, ' '))), 6) AS chars_per_token FROM documents",
    "first_batch": "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k, sum(strlen(text)) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS s FROM documents) WHERE k = 1 OR (s <= 300000 AND k <= 100000)",
    "evidence_pointers": r"""SELECT doc_id, nullif(array_to_string(list_transform(regexp_extract_all(said, '\bp\d+(?:\s*-\s*p\d+)?\b|\bheadline\b|\blead\b'), lambda x: regexp_replace(x, '\s+', '', 'g')), ', '), '') AS pointers
      FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'none of it' ELSE 'see p' || (doc_id % 20) || CASE WHEN doc_id % 3 = 0 THEN ' - p' || (doc_id % 20 + 2) ELSE ' and headline' END || CASE WHEN doc_id % 5 = 0 THEN ', the lead' ELSE ', leads' END END AS said FROM documents)""",
    "row_signature": "SELECT doc_id, md5(source || chr(31) || chr(31) || text) AS signature FROM documents",
    "embed_requests": "SELECT doc_id, md5('title: ' || source || ' | text: ' || substr(text, 1, 8000)) AS digest, CAST(768 AS BIGINT) AS dims FROM documents",
    "kept_lines": LINES
    + r""", s AS (SELECT doc_id, i, line, regexp_replace(line, '^\s+|\s+$', '', 'g') AS f FROM l), e AS (SELECT doc_id, min(i) AS stop FROM s WHERE regexp_full_match(f, '(Permission|Licensed|Copyright).*') GROUP BY doc_id),
      k AS (SELECT s.doc_id, string_agg(line, chr(10) ORDER BY i) AS t FROM s LEFT JOIN e USING (doc_id) WHERE (stop IS NULL OR i < stop) AND NOT regexp_full_match(f, '[0-9A-Za-z_]+( [0-9A-Za-z_]+){0,2}\.?') GROUP BY s.doc_id)
      SELECT doc_id, CAST(length(t) AS BIGINT) AS chars, md5(t) AS digest FROM (SELECT doc_id, regexp_replace(coalesce(k.t, ''), '^\n+|\n+$', '', 'g') AS t FROM documents LEFT JOIN k USING (doc_id))""",
}

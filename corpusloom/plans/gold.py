"""Queries over samples, labels, estimates and judgements. Two columns of labels stand in for coders."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import estimators, judging, labels, release, sampling
from corpusloom.plans import texts
from corpusloom.session import load

QUOTAS = {"en": 60, "fr": 25, "de": 10, "es": 5}
CODERS = ["R1", "R2", "R3"]


def allocation(spark, sf):
    return sampling.allocation(load(spark, sf, "documents"), "lang", "source", QUOTAS, 2)


def _drawn(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", "lang", "source")
    pop = sampling.population(d, "doc_id", [load(spark, sf, "labels").where("toxic = 1")])
    seats = pop.groupBy(F.col("lang").alias("stratum"), F.col("source").alias("source_")).agg(F.count("*").alias("size")).select("stratum", F.col("source_").alias("source"), "size", F.least(F.lit(3), "size").alias("seats"))
    return sampling.draw(pop, "doc_id", "lang", "source", seats, "7")


def stratified_draw(spark, sf):
    return _drawn(spark, sf)


def draw_positions(spark, sf):
    return sampling.positioned(_drawn(spark, sf), "doc_id", "7").select("doc_id", F.col("position").cast("bigint").alias("position"))


def assignment(spark, sf):
    a = sampling.assign(_drawn(spark, sf), "doc_id", "lang", CODERS, 20, "9")
    return a.select("doc_id", "lang", F.array_join("coders", ",").alias("coders"), "shared")


def per_source_sample(spark, sf):
    return sampling.per_group(load(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id", 3, "11")


def exact_sample(spark, sf):
    return sampling.exactly(load(spark, sf, "documents").select("doc_id"), "doc_id", 50, "13")


def _coded(spark, sf):
    """A row for each document and coder: clauses, scope, time and line; R1 says everything twice."""
    l = load(spark, sf, "labels")
    id, q, t = F.col("doc_id"), F.col("quality") == 1, F.col("toxic") == 1
    said = [("R1", q), ("R2", t), ("R3", F.when(id % 3 == 0, q).otherwise(t)), ("R1", F.when(id % 5 == 0, ~q).otherwise(q))]
    rows = None
    for line, (coder, yes) in enumerate(said):
        named = F.when(yes, F.array((id % 4 + 1).cast("int"), F.lit(2), F.lit(2))).otherwise(F.array().cast("array<int>"))
        one = l.select("doc_id", F.lit(coder).alias("coder"), yes.alias("in_scope"), named.alias("clauses"), F.when(id % 2 == 0, line).otherwise(0).alias("at"), F.lit(line).alias("line"), (id % 4 != 0).alias("shared"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def label_latest(spark, sf):
    return labels.latest(_coded(spark, sf), "doc_id", "coder", "at", "line").select("doc_id", "coder", "in_scope", F.array_join(F.sort_array(F.array_distinct("clauses")), ",").alias("clauses"), F.col("line").cast("bigint").alias("line"))


def label_errors(spark, sf):
    id = F.col("doc_id")
    rows = load(spark, sf, "labels").select(
        "doc_id",
        F.when(id % 17 == 0, F.lit(None)).otherwise(F.col("quality") == 1).alias("in_scope"),
        F.when(id % 11 == 0, F.array(F.lit(5))).when((F.col("quality") == 1) != (id % 7 == 0), F.array(F.lit(1))).otherwise(F.array().cast("array<int>")).alias("clauses"),
        F.when(id % 3 == 0, "").otherwise("p1").alias("evidence"),
        F.when(id % 5 == 0, "sure").otherwise("high").alias("confidence"),
        F.when(id % 4 == 0, "R4").otherwise("R1").alias("coder"),
        F.when(id % 19 != 0, F.array(*map(F.lit, CODERS))).alias("allowed"),
    )
    e = labels.error(F.col("in_scope"), F.col("clauses"), F.col("evidence"), F.col("confidence"), F.col("coder"), F.col("allowed").isNotNull(), F.col("allowed"))
    return rows.select("doc_id", e.alias("error"))


def label_progress(spark, sf):
    assigned = load(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.array(*map(F.lit, CODERS))).otherwise(F.array(F.lit("R1"))).alias("coders"))
    return labels.progress(_coded(spark, sf).where("coder <> 'R2' OR doc_id % 2 = 0"), assigned, "doc_id", "coder")


def gold_majority(spark, sf):
    last = labels.latest(_coded(spark, sf), "doc_id", "coder", "at", "line")
    return labels.majority(last, "doc_id", "coder", "in_scope", "clauses", "shared").select("doc_id", "in_scope", F.array_join("clauses", ",").alias("clauses"))


def _judged(spark, sf):
    l = load(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("g"))
    m = texts.matched(spark, sf, l).select("doc_id", "source", F.col("candidate").alias("p"))
    return l.join(m, "doc_id").withColumn("w", (F.col("doc_id") % 7 + 1).cast("double"))


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes])


def precision_recall(spark, sf):
    return _rounded(estimators.precision_recall(_judged(spark, sf), ["source"], "p", "g", "w", overall=True).withColumn("source", F.coalesce("source", F.lit("all"))))


def extension_rule(spark, sf):
    return estimators.extension(_judged(spark, sf), "source", "g", "w")


def krippendorff_alpha(spark, sf):
    l = load(spark, sf, "labels")
    long = l.select("doc_id", F.lit("a").alias("coder"), F.col("quality").alias("v")).unionByName(l.select("doc_id", F.lit("b").alias("coder"), F.col("toxic").alias("v")))
    return _rounded(estimators.alpha(long, "doc_id", "coder", "v"))


def stability(spark, sf):
    l = load(spark, sf, "labels")
    return _rounded(estimators.stability(l.select("doc_id", "quality"), l.where("doc_id % 3 <> 0").select("doc_id", F.col("toxic").alias("quality")), "doc_id", "quality"))


def bootstrap_intervals(spark, sf):
    return _rounded(estimators.bootstrap(_judged(spark, sf), ["source"], "p", "g", "w", 2000, 1, 32, "doc_id"))


def _results(spark, sf):
    e = load(spark, sf, "events")
    return e.select((F.col("user_id") * 31 + F.dayofmonth("ts")).alias("event_id"), F.when(F.col("event_type") == "error", "errored").when(F.col("event_type") == "click", "succeeded").otherwise("unparsed").alias("status"), (F.col("value") / 1000).alias("cost_usd"))


def classifier_state(spark, sf):
    s = judging.state(_results(spark, sf))
    return s.groupBy("decided", "given_up").agg(F.count("*").alias("n"), F.sum("failures").alias("failures"), F.round(F.sum("spent"), 6).alias("spent"))


def projected_cost(spark, sf):
    return _rounded(judging.projected(judging.totals(judging.state(_results(spark, sf))), 100_000, 0.0025, 500.0))


def undecided(spark, sf):
    """All documents are wanted, labelled ones under way."""
    wanted = load(spark, sf, "documents").select(F.col("doc_id").alias("event_id"))
    flight = load(spark, sf, "labels").select(F.col("doc_id").alias("event_id"))
    return judging.undecided(wanted, judging.state(_results(spark, sf)), flight)


def fetch_outcomes(spark, sf):
    """What became of documents asked for again: some gone, some failed, some edited in their middle; points: similarities
    of edited ones in ten thousandths."""
    id = F.col("doc_id")
    d = load(spark, sf, "documents", spread=True).select(id.alias("event_id"), F.col("source").alias("outlet_id"), F.col("text").alias("body"), F.md5("text").alias("body_hash"))
    n, body = F.col("event_id"), F.col("body")
    half = F.floor((F.length(body) + 1) / 2).cast("int")
    put_in = F.concat(F.left(body, half), F.lit("☃☃☃☃"), F.substring(body, half + 1, F.length(body)))
    put_over = F.concat(F.left(body, half), F.lit("☃"), F.substring(body, half + 2, F.length(body)))
    edited = n % 5 == 0
    again = d.select("event_id", F.when(n % 7 == 0, 404).when(n % 11 == 0, 503).otherwise(200).alias("status"), F.when(edited & ((n % 2 == 0) | (F.length(body) < 2)), put_in).when(edited, put_over).otherwise(body).alias("body"), F.when(edited, "other").otherwise(F.col("body_hash")).alias("body_hash"))
    r = release.verified(d, again)
    return r.groupBy("outlet_id", "outcome").agg(F.count("*").alias("n"), F.count("similarity").alias("compared"), F.coalesce(F.sum(F.round(F.col("similarity") * 10000).cast("long")), F.lit(0)).alias("points"))


QUERIES = {
    f.__name__: f
    for f in (
        allocation, stratified_draw, draw_positions, assignment, per_source_sample, exact_sample, label_latest, label_errors, label_progress, gold_majority, precision_recall, extension_rule, krippendorff_alpha,
        stability, bootstrap_intervals, classifier_state, projected_cost, undecided, fetch_outcomes,
    )
}

DRAWN = """WITH pop AS (SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
  k AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY md5('7:' || doc_id), doc_id) AS k, count(*) OVER (PARTITION BY lang, source) AS size FROM pop),
  drawn AS (SELECT doc_id, lang, source, round(size / least(3, size), 4) AS weight FROM k WHERE k <= 3) """
CODED = """WITH b AS (SELECT doc_id, quality = 1 AS q, toxic = 1 AS t FROM labels), c AS (SELECT doc_id, 'R1' AS coder, q AS yes, 0 AS line FROM b UNION ALL SELECT doc_id, 'R2', t, 1 FROM b
  UNION ALL SELECT doc_id, 'R3', CASE WHEN doc_id % 3 = 0 THEN q ELSE t END, 2 FROM b UNION ALL SELECT doc_id, 'R1', CASE WHEN doc_id % 5 = 0 THEN NOT q ELSE q END, 3 FROM b),
  d AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN line ELSE 0 END AS said_at, CASE WHEN yes THEN list_sort(list_distinct([doc_id % 4 + 1, 2])) ELSE [] END AS clauses FROM c),
  last AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY doc_id, coder ORDER BY said_at DESC, line DESC) = 1) """
JUDGED = texts.M + ", j AS (SELECT l.doc_id, source, candidate AS p, quality = 1 AS g, CAST(l.doc_id % 7 + 1 AS DOUBLE) AS w FROM labels l JOIN m ON m.doc_id = l.doc_id) "
_PR = "count(*) AS n, round(coalesce(sum(w) FILTER (p AND g), 0) / nullif(coalesce(sum(w) FILTER (p), 0), 0), 6) AS precision, round(coalesce(sum(w) FILTER (p AND g), 0) / nullif(coalesce(sum(w) FILTER (g), 0), 0), 6) AS recall FROM j"
RESULTS = "WITH r AS (SELECT user_id * 31 + day(ts) AS event_id, event_type = 'click' AS won, value / 1000 AS cost FROM events), s AS (SELECT event_id, bool_or(won) AS decided, CAST(count_if(NOT won) AS BIGINT) AS failures, sum(cost) AS spent FROM r GROUP BY event_id) "
_QUOTA = " ".join(f"WHEN '{k}' THEN {v}" for k, v in QUOTAS.items())
ORACLE_SQL = {
    "allocation": f"""WITH s AS (SELECT lang AS stratum, source, count(*) AS size FROM documents GROUP BY 1, 2), a AS (SELECT *, least(2, size) AS sure, size - least(2, size) AS room FROM s),
      b AS (SELECT *, greatest(0, (CASE stratum {_QUOTA} ELSE 0 END) - sum(sure) OVER (PARTITION BY stratum)) AS rest, row_number() OVER (PARTITION BY stratum ORDER BY room / size, source) AS place FROM a),
      c AS (SELECT *, rest - coalesce(sum(room) OVER p, 0) AS lft, sum(size) OVER (PARTITION BY stratum) - coalesce(sum(size) OVER p, 0) AS among FROM b WINDOW p AS (PARTITION BY stratum ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      l AS (SELECT stratum, min(place) AS nth FROM c WHERE lft * size <= room * among GROUP BY stratum), k AS (SELECT c.stratum, nth, greatest(0, lft) AS lft, among FROM c JOIN l ON c.stratum = l.stratum AND place = nth),
      d AS (SELECT c.stratum, source, size, sure, CASE WHEN place >= nth THEN floor(k.lft * size / k.among) ELSE room END AS whole, CASE WHEN place >= nth THEN (k.lft * size) % k.among ELSE 0 END AS part, coalesce(place >= nth, false) AS free, coalesce(k.lft, 0) AS lft FROM c LEFT JOIN k USING (stratum)),
      e AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY part DESC, source DESC) AS r, lft - coalesce(sum(whole) FILTER (free) OVER (PARTITION BY stratum), 0) AS over FROM d)
      SELECT stratum, source, size, CAST(sure + whole + CASE WHEN part > 0 AND r <= over THEN 1 ELSE 0 END AS BIGINT) AS seats FROM e""",
    "stratified_draw": DRAWN + "SELECT * FROM drawn",
    "draw_positions": DRAWN + "SELECT doc_id, row_number() OVER (ORDER BY md5('7/position:' || doc_id), doc_id) - 1 AS position FROM drawn",
    "assignment": DRAWN
    + """, o AS (SELECT doc_id, lang, row_number() OVER (ORDER BY lang, md5('9:' || doc_id), doc_id) - 1 AS i, count(*) OVER () AS n FROM drawn), h AS (SELECT *, floor((i + 1) * 20 / n) > floor(i * 20 / n) AS shared FROM o)
      SELECT doc_id, lang, CASE WHEN shared THEN 'R1,R2,R3' ELSE 'R' || ((row_number() OVER (PARTITION BY shared ORDER BY i) - 1) % 3 + 1) END AS coders, shared FROM h""",
    "per_source_sample": "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('11:' || doc_id), doc_id) <= 3",
    "exact_sample": "SELECT doc_id FROM documents ORDER BY md5('13:' || doc_id), doc_id LIMIT 50",
    "label_latest": CODED + "SELECT doc_id, coder, yes AS in_scope, array_to_string(clauses, ',') AS clauses, CAST(line AS BIGINT) AS line FROM last",
    "label_errors": """SELECT doc_id, CASE WHEN doc_id % 19 = 0 THEN 'not in the set' WHEN doc_id % 4 = 0 THEN 'not this coder''s' WHEN doc_id % 17 = 0 THEN 'in_scope is missing' WHEN doc_id % 11 = 0 THEN 'unknown clauses'
      WHEN (quality = 1) <> ((quality = 1) <> (doc_id % 7 = 0)) THEN 'clauses just when in scope' WHEN quality = 1 AND doc_id % 3 = 0 THEN 'in scope without evidence' WHEN doc_id % 5 = 0 THEN 'unknown confidence' END AS error FROM labels""",
    "label_progress": "WITH a AS (SELECT doc_id, 'R1' AS coder FROM documents UNION ALL SELECT doc_id, unnest(['R2', 'R3']) FROM documents WHERE doc_id % 3 = 0) SELECT coder, count(*) AS assigned, CAST(count_if(l.doc_id IS NOT NULL AND (coder <> 'R2' OR l.doc_id % 2 = 0)) AS BIGINT) AS labelled FROM a LEFT JOIN labels l USING (doc_id) GROUP BY coder",
    "gold_majority": CODED
    + """, v AS (SELECT doc_id, count_if(yes) AS y FROM last WHERE doc_id % 4 <> 0 GROUP BY doc_id HAVING count(*) >= 3), n AS (SELECT doc_id, c FROM (SELECT doc_id, unnest(clauses) AS c FROM last WHERE yes AND doc_id % 4 <> 0) GROUP BY doc_id, c HAVING count(*) >= 2)
      SELECT doc_id, y >= 2 AS in_scope, CASE WHEN y >= 2 THEN coalesce((SELECT string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FROM n WHERE n.doc_id = v.doc_id), '') ELSE '' END AS clauses FROM v
      UNION ALL SELECT doc_id, arg_max(yes, coder), array_to_string(arg_max(clauses, coder), ',') FROM last WHERE doc_id % 4 = 0 GROUP BY doc_id""",
    "precision_recall": JUDGED + f"SELECT 'all' AS source, {_PR} UNION ALL SELECT source, {_PR} GROUP BY source",
    "bootstrap_intervals": JUDGED.replace("SELECT l.doc_id, source,", "SELECT l.doc_id, source, l.doc_id AS k,")
    + f""", r AS (SELECT id, p, g, w * ({" + ".join(f"(u >= {t})::int" for t in estimators.POISSON)}) AS w FROM (SELECT id, p, g, w, CAST('0x' || left(md5('1:' || id || ':' || k), 8) AS BIGINT) AS u FROM j, range(2000) AS x(id))),
      s AS (SELECT id, coalesce(sum(w) FILTER (p AND g), 0) AS hit, coalesce(sum(w) FILTER (p), 0) AS pred, coalesce(sum(w) FILTER (g), 0) AS gold FROM r GROUP BY id),
      i AS (SELECT list_sort(list(hit / pred) FILTER (pred > 0)) AS p, list_sort(list(hit / gold) FILTER (gold > 0)) AS r FROM s)
      SELECT round(p[floor(len(p) * 0.025)::int + 1], 6) AS precision_low, round(p[floor(len(p) * 0.975)::int], 6) AS precision_high, round(r[floor(len(r) * 0.025)::int + 1], 6) AS recall_low, round(r[floor(len(r) * 0.975)::int], 6) AS recall_high, 2000::bigint AS replicates FROM i""",
    "extension_rule": JUDGED + ", s AS (SELECT source, coalesce(sum(w) FILTER (g), 0) AS x FROM j GROUP BY source) SELECT source, round(coalesce(x / nullif(sum(x) OVER (), 0), 0), 6) AS share, coalesce(x / nullif(sum(x) OVER (), 0), 0) > CAST(0.05 AS DOUBLE) AS extend FROM s",
    "krippendorff_alpha": """WITH v AS (SELECT doc_id, 'a' AS c, quality AS v FROM labels UNION ALL SELECT doc_id, 'b', toxic FROM labels), p AS (SELECT x.v AS a, y.v AS b FROM v x JOIN v y ON x.doc_id = y.doc_id AND x.c <> y.c),
      n AS (SELECT a, CAST(count(*) AS DOUBLE) AS n FROM p GROUP BY a), t AS (SELECT sum(n) AS n, sum(n * n) AS s FROM n) SELECT round(1 - (SELECT count_if(a <> b) FROM p) / ((n * n - s) / (n - 1)), 6) AS alpha, CAST(n AS BIGINT) AS values FROM t""",
    "stability": """WITH b AS (SELECT count(*) AS n, CAST(count_if(quality = toxic) AS BIGINT) AS k FROM labels WHERE doc_id % 3 <> 0), p AS (SELECT *, k / n AS p, CAST(1.96 AS DOUBLE) AS z FROM b),
      h AS (SELECT *, (p + z * z / (2 * n)) / (1 + z * z / n) AS m, z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n) AS h FROM p) SELECT n, k AS agree, round(p, 6) AS share, round(greatest(0, m - h), 6) AS low, round(least(1, m + h), 6) AS high FROM h""",
    "classifier_state": RESULTS + "SELECT decided, NOT decided AND failures >= 3 AS given_up, count(*) AS n, CAST(sum(failures) AS BIGINT) AS failures, round(sum(spent), 6) AS spent FROM s GROUP BY 1, 2",
    "projected_cost": RESULTS
    + ", t AS (SELECT count_if(decided) AS d, sum(spent) AS s FROM s), c AS (SELECT s + (CASE WHEN d >= 1000 THEN s / d ELSE CAST(0.0025 AS DOUBLE) END) * (100000 - d) AS c FROM t) SELECT round(c, 6) AS projected, c > 500 AS over FROM c",
    "undecided": RESULTS + "SELECT doc_id AS event_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT event_id FROM s WHERE decided OR failures >= 3)",
    "fetch_outcomes": """WITH o AS (SELECT source AS outlet_id, length(text) AS n, CASE WHEN doc_id % 7 = 0 THEN 'gone' WHEN doc_id % 11 = 0 THEN 'failed' WHEN doc_id % 5 = 0 THEN 'edited' ELSE 'unchanged' END AS outcome,
        CASE WHEN doc_id % 2 = 0 OR length(text) < 2 THEN 2.0::double * length(text) / (2 * length(text) + 4) ELSE (length(text) - 1)::double / length(text) END AS ratio FROM documents)
      SELECT outlet_id, outcome, count(*) AS n, CAST(count_if(outcome = 'edited') AS BIGINT) AS compared, CAST(coalesce(sum(round(round(ratio, 4) * 10000)) FILTER (outcome = 'edited'), 0) AS BIGINT) AS points FROM o GROUP BY ALL""",
}

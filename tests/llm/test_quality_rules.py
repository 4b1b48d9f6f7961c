import math
import random
import unicodedata

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from corpusloom.llm import quality_rules as qr
from corpusloom.llm import queries as q


def test_rules_compile_to_the_sum_of_their_weights(spark):
    rules = (qr.Rule((("a", True, 2.0),), 1.5), qr.Rule((("a", False, 1.0), ("b", True, 0.0)), -0.5))
    df = spark.createDataFrame([((1.0, 0.0),), ((2.0, 0.0),), ((3.0, 1.0),)], "s struct<a:double,b:double>")
    got = [r[0] for r in df.select(qr.Ensemble(0.25, rules).score("s")).collect()]
    assert got == pytest.approx([1 / (1 + math.exp(-x)) for x in (1.75, 1.25, 0.25)])


def test_statistics_of_edge_cases(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "Ab 1!\nAb 1!", 0), (4, "x" * 2_000_000, 0)], "doc_id int, text string, stats int")
    got = {r["doc_id"]: r["s"].asDict() for r in qr.statistics(df, "text", "s").collect()}
    assert got[1] == got[2] and all(v == 0 for v in got[1].values())
    assert got[3]["distinct_words"] == 0.5 and got[3]["distinct_lines"] == 0.5 and got[3]["capitals"] == 0.5
    assert got[3]["digits"] == pytest.approx(2 / 11) and got[3]["marks"] == pytest.approx(2 / 11)
    assert got[4]["word_length"] == 2_000_000
    assert qr.statistics(df, "text", "s").columns == ["doc_id", "text", "stats", "s"]


def test_without_labels_or_with_one_class(spark):
    none = spark.createDataFrame([], "text string, label int")
    assert qr.fit(none, "text", "label").rules == ()
    assert qr.fit(none, "text", "label").intercept == 0
    one = spark.createDataFrame([("a", 1), ("b", 1)], "text string, label int")
    assert qr.score(one, qr.fit(one, "text", "label")).where("quality_score < 0.9").count() == 0
    assert qr.score(none, qr.Ensemble(0.0, ())).count() == 0


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = q.op2(spark, docs, labels)
    r = got.where("held_out").join(labels, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("a"), F.count("*").alias("n")).first()
    assert r["n"] > 1000 and r["a"] > 0.97
    assert got.count() == docs.count()


def plain_statistics(text):
    """The statistics in plain Python."""
    t = text or ""
    space = " \t\n\x0b\f\r"
    words, word = [], ""
    for c in t:
        if c in space:
            words.append(word)
            word = ""
        else:
            word += c
    words = [w for w in [*words, word] if w]
    lines = [x for x in t.split("\n") if x]
    kind = lambda c: unicodedata.category(c)
    spaces, letters = sum(c in space for c in t), sum(kind(c)[0] == "L" for c in t)
    share = lambda a, b: a / b if b else 0.0
    return {
        "chars": math.log1p(len(t)),
        "words": math.log1p(len(words)),
        "letters": share(letters, len(t)),
        "digits": share(sum(c in "0123456789" for c in t), len(t)),
        "spaces": share(spaces, len(t)),
        "capitals": share(sum(kind(c) == "Lu" for c in t), letters),
        "marks": share(sum(kind(c)[0] not in "LN" and c not in space and c not in ".," for c in t), len(t)),
        "stops": share(sum(c in ".," for c in t), len(words)),
        "word_length": share(len(t) - spaces, len(words)),
        "distinct_words": share(len(set(words)), len(words)),
        "distinct_lines": share(len(set(lines)), len(lines)),
        "line_words": math.log1p(share(len(words), len(lines))),
        "bare_words": share(sum(not any(kind(c)[0] == "L" for c in w) for w in words), len(words)),
    }


TEXTS = ["Äpfel, Birnen. 12 34\nÄpfel 5\n\n", "ÉTÉ — 3,5 % ½ ² «ça»", "\t one\ttwo \r\n", "...", "数字 12 ١٢", "a\n" * 50 + "B\n" * 50, "one two", "one two"]


def test_statistics_against_plain_python(spark):
    texts = TEXTS + [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    rows = qr.statistics(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"), "text").collect()
    for r in rows:
        assert r["stats"].asDict() == pytest.approx(plain_statistics(texts[r["i"]]), abs=1e-12), texts[r["i"]][:40]
    some = qr.statistics(spark.createDataFrame([("a b", 1, 2)], "text string, STATS_W int, stats_t int"), "text", only={"words", "capitals"})
    assert some.columns == ["text", "STATS_W", "stats_t", "stats"] and some.first()["stats"].asDict() == {"words": math.log1p(2), "capitals": 0}


@pytest.fixture(scope="module")
def grown(spark):
    """A table of 600 rows with a forest on it."""
    rng = random.Random(5)
    rows = []
    for _ in range(600):
        a, b, c = rng.random(), rng.random(), rng.randrange(3) / 2
        rows.append((float((a > 0.4 and b < 0.7) != (rng.random() < 0.1)), (a, b, c)))
    table = spark.createDataFrame(rows, "label double, stats struct<a:double,b:double,c:double>").coalesce(1).cache()
    data = table.select("label", array_to_vector(F.array("stats.a", "stats.b", "stats.c")).alias("v"))
    forest, found = qr.grown(data, ["a", "b", "c"], 4, 3, 7)
    return rows, table, forest, found


def holds(rule, x):
    at = dict(zip("abc", x))
    return all((at[n] <= t) if at_most else (at[n] > t) for n, at_most, t in rule)


def test_paths_lead_where_the_trees_lead(grown):
    """In each tree a row fires just the rules of the nodes that it passes; the last one is its leaf."""
    rows, _, forest, found = grown
    union = set()
    for tree in forest.trees:
        own = qr.paths(tree._call_java("rootNode"), ["a", "b", "c"])
        union |= set(own)
        for _, x in rows[:150]:
            node, passed = tree._call_java("rootNode"), 0
            while node.subtreeDepth():
                s = node.split()
                node = node.leftChild() if x[s.featureIndex()] <= s.threshold() else node.rightChild()
                passed += 1
            assert sum(holds(p, x) for p in own) == passed
            assert node.prediction() == tree.predict(Vectors.dense(x))
    assert sorted(union) == found


def test_weights_meet_the_conditions_of_the_lasso(grown):
    """Of each rule with a weight the loss's slope is the penalty, of each other one it is no more."""
    rows, table, _, found = grown
    lasso = 0.01
    intercept, weights = qr.weighed(table, found, lasso)
    assert 0 < sum(w != 0 for w in weights) < len(weights)
    fired = [[float(holds(p, x)) for p in found] for _, x in rows]
    off = [1 / (1 + math.exp(-(intercept + sum(w * f for w, f in zip(weights, fs))))) - y for (y, _), fs in zip(rows, fired)]
    assert abs(sum(off) / len(off)) < 2e-3
    for j, w in enumerate(weights):
        slope = sum(e * fs[j] for e, fs in zip(off, fired)) / len(rows)
        assert abs(slope + math.copysign(lasso, w)) < 2e-3 if w else abs(slope) < lasso + 2e-3


def test_repeated_rows_ties_and_clashing_names(spark):
    labels = spark.createDataFrame([(i % 40, i % 2, "k") for i in range(80)] + [(None, 1, "k"), (3, None, "k"), (4, 7, "k")], "doc_id long, quality int, _doc string")
    docs = spark.createDataFrame([(i % 40, f"text {'!' * (i % 2 * 9)} {i % 3}", "x", 0, 1.0) for i in range(80)], "doc_id long, text string, key string, label int, quality_score_stats double")
    sample = qr.labelled_sample(docs, labels, "doc_id", "quality")
    assert sample.columns == ["text", "label"] and sample.count() == 160
    small = [sorted(map(tuple, qr.labelled_sample(d, labels, "doc_id", "quality", bound=10).collect())) for d in (docs, docs.repartition(5))]
    assert small[0] == small[1] and len(small[0]) == 20
    ensemble = qr.fit(sample, "text", "label", trees=3)
    out = qr.score(docs, ensemble)
    assert out.columns == [*docs.columns, "quality_score"] and out.count() == 80
    assert out.groupBy("text").agg(F.count_distinct("quality_score").alias("n")).where("n > 1").count() == 0


def test_at_least_keeps_what_a_filter_keeps_and_computes_once(spark):
    ensemble = qr.Ensemble(-0.2, (qr.Rule((("words", False, 1.5), ("digits", True, 0.2)), 0.9), qr.Rule((("words", False, 2.0),), -0.4), qr.Rule((("digits", True, 0.1),), 0.1)))
    rows = [(1, "a b c d e f g", 0), (1, "a b c d e f g", 0), (2, None, 1), (3, "", 1), (4, "1 2 3 4 5 6", 2), (None, "one two three four", 3), (5, "x" * 50_000, 4)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, quality_score int")
    for least in (0.4, 0.5, 0.6):
        scored = qr.score(docs, ensemble, into="s")
        want = sorted(map(str, scored.where(F.col("s") >= least).select(docs.columns).collect()))
        kept = qr.at_least(docs, ensemble, least)
        assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == want
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in "".join(x for x in plan.splitlines() if "Filter" in x and "Generate" not in x) and plan.count("[^0-9]+") == 1
    assert qr.at_least(docs, qr.Ensemble(0.0, ()), 0.5).count() == len(rows)
    assert qr.at_least(docs.where("doc_id < 0"), ensemble, 0.5).count() == 0

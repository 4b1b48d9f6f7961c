import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import langid_crf as crf
from corpusloom.llm import queries as q


def test_marginals_equal_those_over_all_paths():
    rng = np.random.default_rng(0)
    K, lengths = 3, [1, 4, 6, 2]
    score, trans, start = rng.normal(size=(sum(lengths), K)), rng.normal(size=(K, K)), rng.normal(size=K)
    first = np.zeros(sum(lengths), bool)
    first[np.cumsum([0, *lengths[:-1]])] = True
    got, _, _ = crf.marginals(score, first, trans, start)
    at = 0
    for n in lengths:
        want = np.zeros((n, K))
        for path in itertools.product(range(K), repeat=n):
            s = start[path[0]] + sum(score[at + i, k] for i, k in enumerate(path)) + sum(trans[a, b] for a, b in itertools.pairwise(path))
            for i, k in enumerate(path):
                want[i, k] += np.exp(s)
        want /= want.sum(axis=1, keepdims=True)
        assert np.allclose(got[at : at + n], want, atol=1e-9)
        at += n


def test_runs_do_not_change_the_marginals(monkeypatch):
    rng = np.random.default_rng(1)
    score, trans, start = rng.normal(size=(1000, 4)), rng.normal(size=(4, 4)), rng.normal(size=4)
    first = rng.random(1000) < 0.01
    first[0] = True
    a, _, _ = crf.marginals(score, first, trans, start)
    monkeypatch.setattr(crf, "RUN", 1000)
    b, _, _ = crf.marginals(score, first, trans, start)
    monkeypatch.setattr(crf, "RUN", 7)
    c, _, _ = crf.marginals(score, first, trans, start)
    assert np.allclose(a, b) and np.allclose(a, c)


def test_words_in_switched_text_get_their_own_label():
    en = "the house stands near the river and the old mill where they used to work every morning"
    de = "das Haus steht nahe am Fluss und die alte Mühle wo sie jeden Morgen gearbeitet haben"
    model = crf.train([("en", en)] * 6 + [("de", de)] * 6)
    words = crf.words_of(en + " " + de)
    first = np.zeros(len(words), bool)
    first[0] = True
    m, _, _ = crf.marginals(model.scores(words), first, model.trans, model.start)
    picked = [model.labels[k] for k in m.argmax(axis=1)]
    n = len(crf.words_of(en))
    assert picked[:n] == ["en"] * n and picked[n:] == ["de"] * (len(words) - n)


def test_edge_cases(spark):
    model = crf.train([("en", "the cat sat"), ("fr", "le chat noir")] * 3)
    rows = [(1, None, "x"), (2, "", "x"), (3, "123 -- !!", "x"), (4, "the cat", None), (4, "the cat", None), (5, "le chat noir " * 30_000, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string")
    got = crf.predict(df, model).select("doc_id", "language.*").orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in got] == ["und", "und", "und", "en", "en", "fr"]
    assert [r["score"] for r in got[:3]] == [0, 0, 0] and all(0 <= r["score"] <= 1 for r in got)
    assert got[3] == got[4]
    empty = df.where("doc_id < 0")
    assert crf.fit(empty, label="lang_pred") is None
    assert crf.predict(empty, None).count() == 0
    assert {r["language"]["lang_pred"] for r in crf.predict(df, None).collect()} == {"und"}


def test_sample_takes_a_copied_text_once(spark):
    rows = [("the cat sat on the mat", "en")] * 3000 + [(f"le chat noir {i}", "fr") for i in range(40)] + [("nothing", None)]
    df = spark.createDataFrame(rows, "text string, lang string")
    got = crf.sample(df, "text", "lang")
    assert sorted(got) == sorted({(y, t) for t, y in rows[:-1]})
    few = crf.sample(df, "text", "lang", per_label=10)
    assert few and len(few) == len(set(few)) and sum(y == "fr" for y, _ in few) < 30


@pytest.fixture(scope="module")
def result(spark):
    return q.QUERIES["op1_langid_crf"](spark, "/root/testdata/sf0.01").cache()


def test_held_out_accuracy(spark, result):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = result.where("held_out").join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.count("*").alias("n")).first()
    assert r["n"] > 100 and r["a"] > 0.95
    assert result.count() == docs.count()


def test_labels_of_held_out_rows_are_not_used(spark, result):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    other = docs.withColumn("lang", F.when(held, F.lit("zz")).otherwise(F.col("lang")))
    again = q.op1(spark, other)
    a = {r["doc_id"]: r["lang_pred"] for r in result.collect()}
    b = {r["doc_id"]: r["lang_pred"] for r in again.collect()}
    assert a == b


def test_words_of_switched_text_get_labels_of_their_own(spark):
    en, fr = "the cat sat on the mat and the dog ran", "le chat noir dans la maison avec une souris"
    model = crf.train([("en", en), ("fr", fr)] * 4)
    rows = [(1, f"{en}. {fr}!"), (2, None), (3, "12 --"), (4, ""), (5, "The CAT"), (5, "The CAT")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id int, text string, lang string")
    out = crf.label_words(df, model)
    assert out.columns == ["doc_id", "text", "lang", "word_labels"]
    got = out.orderBy("doc_id").collect()
    first = got[0]["word_labels"]
    assert [w["word"] for w in first] == en.split() + fr.split()
    assert [w["lang"] for w in first] == ["en"] * len(en.split()) + ["fr"] * len(fr.split())
    assert [r["word_labels"] for r in got[1:4]] == [[], [], []] and got[4]["word_labels"] == got[5]["word_labels"]
    # they are the marginals that the text's score is the mean of
    whole = crf.predict(df.where("doc_id = 5"), model).first()["language"]
    assert whole["lang_pred"] == "en" and whole["score"] == pytest.approx(sum(w["score"] for w in got[4]["word_labels"]) / 2)
    assert crf.label_words(df, None).where("size(word_labels) > 0").count() == 0

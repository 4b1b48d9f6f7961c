"""Many terms by an automaton of literals: the flags are those of each pattern by itself."""

import random
import time

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import dialects
from corpusloom.operators import lexicon
from corpusloom.plans import texts

NEEDED = {
    r"\bprotest\w*": ({"protest"}, True),
    r"\w+tion\b": ({"tion"}, False),
    r"station|square": ({"station", "square"}, True),
    r"\b(the|that) \w+tion(ing|s)?\b": ({"tion"}, False),
    r"(old|new)\w* town": ({" town"}, False),
    r"\b(old|young)": ({"old", "young"}, True),
    r"colou?rs": ({"colo"}, True),
    r"ab+cde": ({"cde"}, False),
    r"a\.b\.c": ({"a.b.c"}, True),
    r"abc{0,2}def": ({"def"}, False),
    r"uru[sš]avanj\w*": ({"avanj"}, False),
    r"\w+": None,
    r"ab|station": None,
    r"(?i)station": None,
    r"(?:station)+": ({"station"}, True),
    r"((a|b)c)station": ({"station"}, False),
    r"(((a|b)c)d)station": None,
    r"(station)?s": None,
    r".abc$": ({"abc"}, False),
}


@pytest.mark.parametrize("pattern", NEEDED)
def test_literals_that_a_pattern_needs(pattern):
    want = NEEDED[pattern]
    assert dialects.needed(pattern) == (want and (frozenset(want[0]), want[1]))


def some_terms(rng, n):
    stems = ["stan", "trg", "most", "grad", "novi", "sad", "škol", "pro", "test", "ulic"]
    tails = ["", r"\w*", r"\w*\b", "(a|u|om)", "[aeu]?", r"\b", r" \w+", "+"]
    shapes = [r"\b{}{}", "{}{}", "({}|xyz){}", r"{}.{{0,3}}{}"]
    one = lambda: rng.choice(shapes).format("".join(rng.sample(stems, rng.randint(1, 2))), rng.choice(tails))
    return [(rng.choice("abc"), " && ".join(one() for _ in range(rng.choice([1, 1, 1, 2])))) for _ in range(n)]


def test_flags_are_those_of_single_patterns(spark):
    rng = random.Random(4)
    terms = lexicon.terms_of(sorted(set(some_terms(rng, 90))) + [("d", r"\b\w\b"), ("d", r"^\s*$"), ("d", r"\d\d"), ("e", "a.b"), ("e", r"[\s-]x"), ("e", "end$")])
    pieces = ["stan", "trg", "most", "grad", "novi", "sad", "škol", "pro", "test", "ulic", "a", "u", "om", " ", " ", "\n", "-x", "\u0085", "٣٣", "42", "_", "ž", "\u2028", "😀", "\u00a0", "xyz", "\r"]
    data = [(i, "".join(rng.choices(pieces, k=rng.randint(0, 25)))) for i in range(400)] + [(400, None), (401, ""), (402, "the end\n"), (403, "the end\r\n"), (404, "end\n\n"), (405, "stan" * 20000)]
    df = spark.createDataFrame(data, "id int, t string").repartition(3)
    want = {r["id"]: r.asDict() for r in lexicon.match(df, "t", terms).collect()}
    got = {r["id"]: r.asDict() for r in lexicon.match_many(df, "t", terms).collect()}
    assert got == want and sum(r["candidate"] for r in want.values()) > 100
    assert lexicon.match_many(df, "t", terms).dtypes == lexicon.match(df, "t", terms).dtypes


def test_results_of_a_batch_leave_in_slices():
    import pyarrow as pa

    terms = lexicon.terms_of([("a", "station"), ("b", r"\bsquare\b"), ("a", "town")])
    data = [None, "", "station " * 5000, "a square, a town", "none"] * 200
    got = list(lexicon.finding(terms, ["a", "b"]).func(iter([pa.array(data)])))
    assert len(got) > 5  # a batch's results at once would grow with its texts
    found = {"s": {"hits": [1, 0], "terms": ["a: station"]}, "a": {"hits": [1, 1], "terms": ["b: \\bsquare\\b", "a: town"]}}
    assert pa.concat_arrays(got).to_pylist() == [found.get((x or "n")[:1], {"hits": [0, 0], "terms": []}) for x in data]


def test_same_flags_on_the_documents(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.lower("text").alias("t"))
    want, got = (sorted(map(tuple, f(d, "t", texts.TERMS).drop("t").collect())) for f in (lexicon.match, lexicon.match_many))
    assert got == want


def test_texts_are_read_once(spark, sf, capsys):
    texts.lexicon_many_per_term(spark, sf).explain()
    assert capsys.readouterr().out.count("ArrowEvalPython") == 1


def test_time_hardly_grows_with_terms(sf):
    import duckdb

    data = [x.lower() for (x,) in duckdb.sql(f"SELECT text FROM '{sf}/documents.parquet'").fetchall() if x]
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghijklmnoprstuvz", k=8)) for _ in range(3000)]
    seconds = []
    for n in (30, 3000):
        find = lexicon.Finder(tuple(rf"\b{w}\w*" for w in words[:n]))
        begin = time.process_time()
        for x in data:
            find(x)
        seconds.append(time.process_time() - begin)
    assert seconds[1] < 10 * seconds[0] + 0.1

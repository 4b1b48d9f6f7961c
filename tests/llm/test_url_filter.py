import random

from corpusloom.llm import queries as q
from corpusloom.llm import url_filter as u
from tests.llm.oracle import compare


def test_query_equals_its_sql(spark):
    assert compare(spark, "op10", q.QUERIES["op10_url_filter"], q.ORACLE_SQL["op10_url_filter"], "/root/testdata/sf0.1") == 2500


def brute(text, terms):
    found = set()
    for t in terms:
        for i in range(len(text) - len(t) + 1):
            edge = lambda c: not (c.isascii() and c.isalnum())
            if text[i : i + len(t)] == t and (i == 0 or edge(text[i - 1])) and (i + len(t) == len(text) or edge(text[i + len(t)])):
                found.add(t)
    return found


def test_hits_equal_brute_force():
    rng = random.Random(2)
    strict, soft = ("ab", "abc"), ("a", "bc", "c-a")
    for _ in range(2000):
        text = "".join(rng.choice("abc-.é1") for _ in range(rng.randrange(12)))
        assert u.hits(text, strict, soft) == (brute(text, strict), brute(text, soft))
    assert u.hits("abc", (), ()) == (set(), set())


def test_edge_cases(spark):
    urls = {
        None: ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "casino": ("", "", None, "allow"),
        "http://": ("", "", None, "allow"),
        "HTTP://A.Example.COM/en/x?y#z": ("a.example.com", "/en/x", "example.com/en/", "block"),
        "http://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://x.www.example.com/en/casino": ("x.www.example.com", "/en/casino", "www.example.com/en/", "allow"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "http://a.com": ("a.com", "", None, "allow"),
        "http://b.net/fr": ("b.net", "/fr", None, "allow"),
        "http://b.net/fr/?q=casino": ("b.net", "/fr/", "net/fr/", "block"),
        "http://b.org?casino": ("b.org", "", None, "allow"),
        "http://casino.org/": ("casino.org", "/", None, "block"),
        "http://casinos.org/": ("casinos.org", "/", None, "allow"),
        "http://b.org/Free": ("b.org", "/Free", None, "allow"),
        "http://b.org/Free-free": ("b.org", "/Free-free", None, "allow"),
        "http://b.org/free/bets": ("b.org", "/free/bets", None, "block"),
        "a://b://c/d": ("b:", "//c/d", None, "allow"),
        "http://o.org/" + "x" * 200_000 + "/casino": ("o.org", "/" + "x" * 200_000 + "/casino", None, "block"),
        "x\ny://n.org/\nq": ("n.org", "/\nq", None, "allow"),
    }
    rows = [(i, url, "r") for i, url in enumerate([*urls, "http://casino.org/"])]
    df = spark.createDataFrame(rows, "page_id long, url string, rule string")
    got = q.op10(spark, df).orderBy("page_id").collect()
    for (_, url, _), r in zip(rows, got):
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == urls[url], url
    assert q.op10(spark, df.where("page_id < 0")).count() == 0
    assert u.judge(df).columns == ["page_id", "url", "rule", "judged"]


def test_vocabulary_from_a_table(spark):
    rows = [("Alpha", True, None), ("beta", False, 1.5), ("beta", False, 0.5), ("gamma", False, None), ("delta", False, 3.0), ("", True, 1.0), (None, True, 1.0), ("delta", None, None)]
    strict, soft = u.vocabulary(spark.createDataFrame(rows, "term string, strict boolean, weight double"))
    assert strict == {"alpha": 1.0} and soft == {"beta": 1.5, "gamma": 1.0, "delta": 3.0}
    urls = ["http://x.org/beta", "http://x.org/beta-gamma", "http://x.org/beta-beta", "http://x.org/delta", "http://ALPHA.org/"]
    df = spark.createDataFrame([(x, 0, 1) for x in urls], "url string, judged_parts int, JUDGED_TERMS int")
    out = u.judge(df, rules=(), strict=strict, soft=soft)
    assert out.columns == ["url", "judged_parts", "JUDGED_TERMS", "judged"]
    assert [r["judged"]["verdict"] for r in out.collect()] == ["allow", "block", "allow", "block", "block"]

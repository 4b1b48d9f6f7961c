import random
import re
from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import dates, dialects, text as tx, urls, vectors


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


def utc(*x):
    return datetime(*x, tzinfo=timezone.utc).astimezone().replace(tzinfo=None)


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("Љубав и Његош у Џепу", "Ljubav i Njegoš u Džepu"),
        ("студенти у блокади, ђак ћути", "studenti u blokadi, đak ćuti"),
        ("already Latin", "already Latin"),
        ("", ""),
    ],
)
def test_to_latin(spark, a, b):
    assert one(spark, tx.to_latin(F.col("a")), a=a) == b


def test_scripts(spark):
    share = tx.cyrillic_share(F.col("a"))
    for a, want, kind in [("абв", 1.0, "cyrl"), ("абcd", 0.5, "mixed"), ("abcd", 0.0, "latn"), ("12 !", 0.0, "latn"), ("", 0.0, "latn")]:
        assert one(spark, share, a=a) == want
        assert one(spark, tx.script(share), a=a) == kind


def test_hash_ignores_case_marks_and_white_space(spark):
    a, b, c = (one(spark, tx.body_hash(F.col("a")), a=x) for x in ("Ein  Text,\nhier!", "ein text hier", "ein text hie"))
    assert a == b != c and len(a) == 32


def test_paragraphs(spark):
    body = "one\n\n  \ntwo 😀\nthree"
    offsets = one(spark, tx.paragraph_offsets(F.col("a")), a=body)
    assert [body[x:y] for x, y in offsets] == ["one", "two 😀", "three"]
    assert one(spark, tx.paragraphs(F.col("a"), tx.paragraph_offsets(F.col("a"))), a=body) == ["one", "two 😀", "three"]
    assert one(spark, tx.paragraph_offsets(F.col("a")), a="") == []


def test_line_rules_hold_in_both_scripts(spark):
    body = "Прва\n Пратите нас на мрежама \ndruga\nBonus video\ntreća"
    kept = tx.kept_lines(F.col("a"), [r"Pratite nas.*"], [r"Bonus video"])
    assert one(spark, kept, a=body) == "Прва\ndruga"
    assert one(spark, tx.kept_lines(F.col("a"), [r"Say \"yes\", no"], []), a='Say "yes", no\nb') == "b"


def test_headline_is_dropped_once(spark):
    f = tx.without_headline(F.col("a"), F.col("b"))
    assert one(spark, f, a="\n \nThe Title!\ntext", b="the title") == "text"
    assert one(spark, f, a="text", b="") == "text"
    assert one(spark, f, a="", b="x") == ""


def test_article_and_input(spark):
    parts = F.array(F.lit("a "), F.lit("  "), F.lit("b"))
    assert one(spark, tx.article(F.lit("T"), F.lit("2024-11-02"), F.lit(None), parts), x=1) == "Title: T\nDate: 2024-11-02\nLead: \n\n[p1] a\n[p2] b"
    f = tx.embedding_input(F.col("t"), F.col("l"), F.col("b"), 3)
    assert one(spark, f, t="", l="lead", b="abcdef") == "title: none | text: lead\nabc"
    assert one(spark, f, t="T", l="", b="") == "title: T | text: "


@pytest.mark.parametrize(("a", "b"), [("p3, p10 - p12 and more", "p3, p10-p12"), ("headline; lead", "headline, lead"), ("leads, p", None), (None, None)])
def test_pointers(spark, a, b):
    assert one(spark, tx.evidence_pointers(F.col("a").cast("string")), a=a) == b


def test_similarity(spark):
    assert one(spark, tx.similarity(F.col("a"), F.col("b")), a="abcd", b="bcde") == pytest.approx(0.75)
    assert one(spark, tx.similarity(F.col("a"), F.lit(None).cast("string")), a="abcd") is None


def test_canonical_urls(spark):
    c = urls.canonical(F.col("a"))
    assert one(spark, c, a=" HTTPS://WWW.Hill.TEST/Vesti/A?utm_source=x&id=1&FBCLID=2#top") == "https://www.hill.test/Vesti/A?id=1"
    assert one(spark, c, a="http://x.org/?a=&b=~*%20c") == "http://x.org/?a=&b=~%2A+c"


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("http://x.org/p?", "http://x.org/p"),
        ("HTTP://X.org:80/P?a&b=1=2&&UTM_x=3&c=%e9%zz%", "http://x.org:80/P?a=&b=1%3D2&c=%EF%BF%BD%25zz%25"),
        ("//Host/Path#f?x=1", "//host/Path"),
        ("no address?q=a+b", "no address?q=a+b"),
        ("https://x.org?utm_medium=1#t", "https://x.org"),
        ("https://x.org/a?name=%75tm_x&ok=ž", "https://x.org/a?name=utm_x&ok=%C5%BE"),
        ("https://x.org/a?%75tm_x=1", "https://x.org/a"),
        ("", ""),
        (None, None),
    ],
)
def test_canonical_urls_by_parts(spark, a, b):
    assert one(spark, urls.canonical(F.col("a").cast("string")), a=a) == b


def test_links_with_attributes_in_any_order(spark):
    page = """<LINK href='https://a/1' title="x" rel="Canonical"><link rel=stylesheet href="https://a/2"><link rel="alternate canonical" href="https://a/3"/><link rel="canonical">"""
    assert one(spark, tx.links(F.col("a"), "canonical"), a=page) == ["https://a/1", "https://a/3"]
    assert one(spark, tx.links(F.col("a"), "canonical"), a="no links") == []


def test_numbers_of_segments(spark):
    f = urls.numbers(F.col("a"))
    for a, want in [("https://x.rs/1234-a/999/5678.html/v12345/67890", ["1234", "5678", "67890"]), ("https://x.rs/12a4/1234_5", []), ("bad", [])]:
        assert one(spark, f, a=a) == want


def test_sections_and_numbers(spark):
    for a, want in [("https://www.sea.test/lat/sport/fudbal/1/x.html", "sport"), ("https://x.rs/LAT/ci/Vesti/", "vesti"), ("https://x.rs/", ""), ("https://x.rs/latin/a", "latin")]:
        assert one(spark, urls.section(F.col("a")), a=a) == want
    for a, want in [("https://x.rs/a/12345/b", 12345), ("https://x.rs/a/1234/b", None), ("https://x.rs/a/123456789", None), ("nonsense", None)]:
        assert one(spark, urls.article_number(F.col("a")), a=a) == want


def test_soft_404(spark):
    f = urls.soft_404(F.col("a"), F.col("b").cast("string"))
    assert one(spark, f, a="https://x.rs/v/12345/t", b="https://x.rs/v/")
    for a, b in [("https://x.rs/v/12345/t", "https://x.rs/w/12345-t"), ("https://x.rs/v/t", "https://x.rs/"), ("https://x.rs/v/12345/t", None), ("https://x.rs/v/12345/t", "https://x.rs/v/12345/t")]:
        assert not one(spark, f, a=a, b=b)


def test_page_dates(spark):
    f = dates.page_date(F.col("a"), "Europe/Belgrade")
    cases = {
        '<script>{"datePublished":"2025-01-15T10:30:00+01:00"}</script>': utc(2025, 1, 15, 9, 30),
        '<meta property="article:published_time" content="2025-01-15T10:30:00+0100">': utc(2025, 1, 15, 9, 30),
        '{"datePublished": "2025-01-15"} <meta itemprop="datePublished" content="2025-02-01T00:00:00Z">': utc(2025, 2, 1),
        '<p class="storyDate">\n  четвртак, 14.11.2024,&nbsp;\n   05:55&nbsp;->&nbsp;06:01\n</p>': utc(2024, 11, 14, 4, 55),
        '<p class="storyDate">subota, 05.04.2025, 21:10</p>': utc(2025, 4, 5, 19, 10),
        "<p>05.04.2025, 21:10</p>": None,
    }
    for page, want in cases.items():
        assert one(spark, f, a=page) == want, page


def test_mail_and_iso_dates(spark):
    assert one(spark, dates.mail_date(F.col("a")), a="Sat, 02 Nov 2024 10:00:00 -0000") == utc(2024, 11, 2, 10)
    assert one(spark, dates.mail_date(F.col("a")), a="Sat, 02 Nov 2024 10:00:00 +0100") == utc(2024, 11, 2, 9)
    assert one(spark, dates.mail_date(F.col("a")), a="junk") is None
    assert one(spark, dates.iso(F.col("a")), a="2025-01-08T10:00:00+01:00") == utc(2025, 1, 8, 9)
    assert one(spark, dates.iso(F.col("a")), a="x") is None


def test_beacon(spark):
    t = F.lit("2020-07-22 15:17:30").cast("timestamp")
    n = dates.round_of(t, 1595431050)
    assert one(spark, n, x=1) == 1 and one(spark, dates.time_of(n, 1595431050), x=1) == utc(2020, 7, 22, 15, 17, 30)
    assert one(spark, dates.beacon_holds(F.lit("00ff"), F.sha2(F.lit(bytes([0, 255])), 256)), x=1)
    import hashlib

    assert one(spark, dates.seed_of(F.lit("ab"), "sample"), x=1) == str(int(hashlib.sha256(b"\xab" + b"sample").hexdigest()[:16], 16))


def test_dialects():
    assert dialects.parts("a && b") == ["a", "b"]
    with pytest.raises(ValueError):
        dialects.parts("a && ")
    with pytest.raises(ValueError):
        dialects.re2(r"a\bb")


def test_vectors(spark):
    v = F.array(F.lit(3.0), F.lit(4.0))
    assert one(spark, vectors.unit(v), x=1) == [0.6, 0.8]
    assert one(spark, vectors.dot(v, v), x=1) == 25.0
    for a, want in [([1.0, 2.0], True), ([1.0], False), ([1.0, float("nan")], False), ([1.0, float("inf")], False), ([1.0, None], False)]:
        assert spark.createDataFrame([(a,)], "a array<double>").select(vectors.valid(F.col("a"), 2).alias("x")).first()["x"] is want


def test_windows(spark):
    rows = spark.sql("SELECT * FROM VALUES (timestamp'2024-10-31 23:59:59'), (timestamp'2024-11-01'), (timestamp'2025-04-30 23:59:59'), (timestamp'2025-05-01') AS t(a)")
    assert rows.where(dates.within(F.col("a"), date(2024, 11, 1), date(2025, 4, 30))).count() == 2


@pytest.mark.parametrize("pattern", [r"\bfoo\w*\b", r"\b(un|ni)t (a|b)?\b", r"\w+\b", r"a\b|\bb", r"\b\W", r"x\b.\b", r"\b(a|\.b)", r"(ab|c)?d\b", r"\b\w*x", r"[ab]\bc?", r"a{0,2}\b", r"\b(?:15|16) \w+"])
def test_boundaries_mean_what_they_mean_in_python(spark, pattern):
    """Against Python's own \\b and \\w, over texts with letters, digits, marks and other scripts."""
    rng = random.Random(pattern)
    texts = ["".join(rng.choice("abcdfnutox15 .é_чß-") for _ in range(rng.randrange(12))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(F.col("t").rlike(dialects.java(pattern))).collect()]
    assert got == [re.search(pattern, t) is not None for t in texts]

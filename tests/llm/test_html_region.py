import html
import random
import re

import pytest

from corpusloom.llm import html_region as h
from corpusloom.llm import queries as q


def sample_page(rng, n):
    words = lambda k: " ".join(rng.choice(["alpha", "beta", "gamma &amp; delta", "r&eacute;sum&#233;"]) for _ in range(k))
    body = "".join(f"<p>{words(rng.randint(3, 20))}</p>" for _ in range(n))
    return (
        f"<!DOCTYPE html><html><head><title>{words(4)}</title><script>if (a<b) x('</p>')</script></head><body><nav><ul>"
        + f"<li><a href='/x'>{words(1)}</a></li>" * rng.randint(2, 6)
        + f"</ul></nav><!-- ad > --><div class=\"ad\">{words(rng.randint(3, 12))}</div><article><h1>{words(5)}</h1>{body}</article><footer>{words(15)}</footer></body></html>"
    )


def between(page):
    inner = page[page.index("<article>") + 9 : page.index("</article>")]
    blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inner.replace("<br>", " ")))
    return " ".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)


def test_best_run_equals_brute_force():
    rng = random.Random(4)
    for _ in range(500):
        pieces = [("#p", " ".join("w" * rng.randint(0, 4))) if rng.random() < 0.5 else (rng.choice("abc"), None) for _ in range(rng.randint(0, 10))]
        weights = {"#p": 1.0, "a": -1.3, "b": -0.2, "c": -3.1}
        page = h.Page(pieces)
        score = lambda a, b: sum(weights[k] * (1 if t is None else len(t.split())) for k, t in pieces[a:b])
        most = max((score(a, b) for a in range(len(pieces) + 1) for b in range(a, len(pieces) + 1)), default=0)
        a, b = h.best_run(page, weights)
        assert score(a, b) == pytest.approx(max(most, 0))


def test_learned_weights_find_the_article():
    rng = random.Random(1)
    weights = h.train([sample_page(rng, rng.randint(1, 6)) for _ in range(60)])
    assert all(v < 0 for k, v in weights.items() if not k.startswith("#")) and all(v > 0 for k, v in weights.items() if k.startswith("#"))
    for _ in range(60):
        page = sample_page(rng, rng.randint(1, 6))
        assert h.extract(page, weights) == between(page)
        # the article's tag isn't needed to find it
        assert h.extract(page.replace("<article>", "<main>").replace("</article>", "</main>"), weights | {"main": weights["article"], "/main": weights["/article"]}) == between(page)


def test_what_is_left_out_inside_the_content():
    w = h.DEFAULT_WEIGHTS
    page = "<body><article><h1>Head line</h1><p>One two<br>three<b>four</b> five&nbsp;six</p><!-- no --><aside>side note</aside><p>seven eight nine</p><div class='reader-comments'><p>first! <i>lol</i></p></div><script>var x='<p>';</script><p>ten eleven twelve thirteen fourteen fifteen sixteen</p>" + "<p>more words here</p>" * 40 + "</article></body>"
    page2 = page.replace("</article>", "<form><input><label>mail</label></form><p>the end of all this</p></article>")
    text = h.text_of(h.read(page2), h.labelled(h.read(page2)))
    assert text.startswith("Head line One two threefour five six seven eight nine ten eleven") and text.endswith("here the end of all this")
    assert "side" not in text and "lol" not in text and "var" not in text and "mail" not in text
    assert h.extract("", w) == "" and h.extract(None, w) == "" and h.extract("<p></p>", w) == "" and h.extract("plain words", w) == "plain words"
    assert h.extract("<p>open <b>never closed", w) == "open never closed"
    assert h.extract("<p>two words</p><script>never closed", w) == "two words" == h.extract("<p>two words<!-- never", w)
    assert h.extract("a < b and c", w) == "a < b and c"


def test_query(spark):
    rng = random.Random(7)
    pages = [(i, f"http://x/{i}", sample_page(rng, 3), "t") for i in range(40)]
    rows = [*pages, (100, None, None, None), (101, "u", "", "t"), (102, "u", "<p>" + "word " * 300_000, "t"), pages[0]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, main_text string")
    got = q.op9(spark, df).collect()
    by = {r["page_id"]: r for r in got}
    assert len(got) == len(rows) and all(by[i]["text"] == between(p) for i, _, p, _ in pages)
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert by[100]["text"] == by[101]["text"] == "" and by[102]["n_chars"] == 5 * 300_000 - 1
    assert q.op9(spark, df.where("page_id < 0")).count() == 0
    assert h.fit(df.where("page_id > 99")) == h.DEFAULT_WEIGHTS


def test_pages_of_the_test_tables(spark):
    sf = "/root/testdata/sf0.1"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    wrong = [r["page_id"] for r in q.QUERIES["op9_html_region"](spark, sf).collect() if r["text"] != between(pages[r["page_id"]])]
    assert not wrong


def test_long_pages_are_learned_from_within_the_bound(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(h, "train", lambda pages: seen.append(pages) or {})
    pages = [f"<article><p>{'word ' * n} {n}</p></article>" for n in (10, 100, 60_000, 20)]
    df = spark.createDataFrame([(p,) for p in [*pages, pages[2], pages[2], None, "<p>none</p>"]], "html string").repartition(3)
    h.fit(df)
    assert sorted(seen[-1], key=len) == sorted(pages, key=len)
    h.fit(df, bound=2)
    first = seen[-1]
    h.fit(df.coalesce(1), bound=2)
    assert seen[-1] == first and len(first) == 2
    h.fit(df, bound_chars=1)
    assert len(seen[-1]) == 1


PARAGRAPHS = [" ".join(f"{w}{i}" for i in range(40)) for w in ("first", "second", "third")]
WHOLE = " ".join(PARAGRAPHS)


def in_article(*blocks):
    return f"<html><body><nav><a href=/>home</a></nav><article>{''.join(blocks)}</article><footer>the end</footer></body></html>"


@pytest.fixture(scope="module")
def learned():
    rng = random.Random(1)
    return h.train([sample_page(rng, rng.randint(1, 6)) for _ in range(60)])


@pytest.mark.parametrize("name", ["share-price", "social-history", "banner", "related", "menu-planning", "x", "adjust", "comment-free", "footer"])
def test_paragraphs_whose_class_only_looks_like_an_aside(learned, name):
    first, second, third = PARAGRAPHS
    for page in (in_article(f"<p>{first}</p><p class='{name}'>{second}</p><p>{third}</p>"), in_article(f"<p>{first}<p class={name}>{second}<p>{third}")):
        assert h.extract(page, learned) == WHOLE


@pytest.mark.parametrize("name", ["ad", "ads", "advert-box", "reader-comments", "comment_list", "cookie-notice", "newsletter-signup", "banner", "related-posts", "share-buttons", "sidebar-left", "wide ad"])
def test_containers_that_are_asides(learned, name):
    first, second, third = PARAGRAPHS
    page = in_article(f"<p>{first}</p><p>{second}</p><div class='{name}'><p>Buy <b>this</b><ul><li>one<li>two</ul></div><p>{third}</p>")
    assert h.extract(page, learned) == WHOLE
    assert h.extract(page, learned, h.Asides(frozenset(), frozenset())) != WHOLE


@pytest.mark.parametrize(
    "body",
    [
        "<p>{0}<p class=ad>Buy<p>{1}<p>{2}",
        "<p>{0}<p class=ad>Buy <b>now</b><h2>{1}</h2>{2}",
        "<p>{0}<p class=ad>Buy<ul><li>{1}</ul><p>{2}",
        "<div><p>{0}<p class=ad>Buy</div>{1}<p>{2}",
        "<ul><li>{0}<li class=ad>Buy<li>{1}</ul><p>{2}",
        "<ul><li>{0}<li class=ad>Buy<ol><li>now<li>here</ol> more<li>{1}</ul><p>{2}",
        "<ul><li>{0}<li class=ad>Buy</ul><p>{1}</p>{2}",
        "<dl><dt class=ad>Buy<dd>{0}<dt>{1}<dd class=ad>it<dt>{2}</dl>",
        "<table><tr><td>{0}<td class=ad>Buy<td>{1}<tr class=ad><td>Buy<td>now<tr><td>{2}</table>",
        "<table><tbody class=ad><tr><td>Buy<tbody><tr><td>{0}<td>{1}</table>{2}",
        "<table><tr><td class=ad><table><tr><td>Buy<tr><td>now</table>it<td>{0}</table>{1}<p>{2}",
        "<p>{0}<span class=ad>Buy</span> {1}<p>{2}",
        "<p>{0}</b></i><aside>Buy<p>now<div>it</div></aside>{1}</section><p>{2}",
    ],
)
def test_end_tags_that_are_left_out(body):
    page = h.read(in_article(body.format(*PARAGRAPHS)))
    assert h.text_of(page, h.labelled(page)) == WHOLE


def test_the_test_pages_without_the_end_tags_that_may_be_left_out(spark):
    sf = "/root/testdata/sf0.01"
    pages = [r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    weights = h.train(pages[:200])
    for p in pages:
        assert h.extract(re.sub("</(p|li)>", "", p), weights) == h.extract(p, weights)

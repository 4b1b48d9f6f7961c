import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import xpath
from corpusloom.operators import pages

HAS = "contains(concat(' ',normalize-space(@class),' '),' {} ')"


class Node:
    def __init__(self, name, attrs):
        self.name, self.attrs, self.children = name, attrs, []


def some_tree(rng, depth=0):
    attrs = {}
    if rng.random() < 0.6:
        attrs["class"] = rng.choice(["x", "y", " x  y ", "xy", "", "y z"])
    if rng.random() < 0.3:
        attrs["id"] = rng.choice(["x", "n1"])
    n = Node(rng.choice(["div", "p", "span", "article"]), attrs)
    n.children = [some_tree(rng, depth + 1) for _ in range(rng.choice([0, 1, 2, 4]) if depth < 4 else 0)]
    return n


def squeezed(x):
    return " ".join(x.split())


#: Path: its steps as (anywhere, name, tests in order); a test takes a node and its place among those that passed before.
PATHS = {
    "//div": [(True, "div", [])],
    "/div/p": [(False, "div", []), (False, "p", [])],
    ".//*": [(True, "*", [])],
    "//div//div/p": [(True, "div", []), (True, "div", []), (False, "p", [])],
    "//p[2]": [(True, "p", [lambda n, at: at == 2])],
    "//div/*[3]": [(True, "div", []), (False, "*", [lambda n, at: at == 3])],
    "//div[@class]": [(True, "div", [lambda n, at: n.attrs.get("class")])],
    "//*[@id='x']//span": [(True, "*", [lambda n, at: n.attrs.get("id") == "x"]), (True, "span", [])],
    "//p[@class!='x'][2]": [(True, "p", [lambda n, at: n.attrs.get("class") not in (None, "x"), lambda n, at: at == 2])],
    "//p[position()=2][@class = \"x\"]": [(True, "p", [lambda n, at: at == 2, lambda n, at: n.attrs.get("class") == "x"])],
    f"//div[{HAS.format('x')}]": [(True, "div", [lambda n, at: "x" in n.attrs.get("class", "").split()])],
    f"//article[{HAS.format('y')}]//div[ {HAS.format('x')} ]": [(True, "article", [lambda n, at: "y" in n.attrs.get("class", "").split()]), (True, "div", [lambda n, at: "x" in n.attrs.get("class", "").split()])],
    "//*[starts-with(@class,'x') or @id='n1' and not(@class)]": [(True, "*", [lambda n, at: n.attrs.get("class", "").startswith("x") or n.attrs.get("id") == "n1" and not n.attrs.get("class")])],
    "//span[(@id or @class) and not(contains(@class,'y'))]": [(True, "span", [lambda n, at: (n.attrs.get("id") or n.attrs.get("class")) and "y" not in n.attrs.get("class", "")])],
    "//*[@id=normalize-space(@class)]": [(True, "*", [lambda n, at: "id" in n.attrs and n.attrs["id"] == squeezed(n.attrs.get("class", ""))])],
}


def plain(root, steps):
    """Nodes by going through the tree step by step."""

    def below(n):
        for c in n.children:
            yield c
            yield from below(c)

    top = Node("", {})
    top.children = [root]
    found = [top]
    for anywhere, name, tests in steps:
        step = []
        for parent in [x for n in found for x in ([n, *below(n)] if anywhere else [n])]:
            left = [c for c in parent.children if name in ("*", c.name)]
            for test in tests:
                left = [c for at, c in enumerate(left, 1) if test(c, at)]
            step += left
        found = list(dict.fromkeys(step))
    return set(map(id, found))


@pytest.mark.parametrize("path", PATHS)
def test_paths_against_brute_force(path):
    rng = random.Random(path)
    some = 0
    for _ in range(60):
        root, matcher, found = some_tree(rng), xpath.Matcher(path), set()

        def walk(n):
            if matcher.start(n.name, n.attrs):
                found.add(id(n))
            for c in n.children:
                walk(c)
            matcher.end()

        walk(root)
        assert found == plain(root, PATHS[path])
        some += len(found)
    assert some or path == "//*[@id=normalize-space(@class)]"


@pytest.mark.parametrize("path", ["", "div", "//", "//div[", "//div[last()]", "//div[text()='x']", "//a/@href", "//div[@a='x]", "//div[contains(@a)]", "//div[p]", "//div | //p", "//div]"])
def test_what_is_not_known_is_an_error(path):
    with pytest.raises(ValueError):
        xpath.compiled(path)


PAGE = """<body><div class="top main-story box"><h1>Head</h1><p>First one.<p>Second <b>one</b>.<div class="main-story-more"><p>Third.</div></div>
<article class="main-story"><p>Not this.<br>Nor this.</p></article><article id=a2 class="wide  tall"><div class="sm:m-1 xl:m-2"><p>Inner text.</p><form><div class="xl:m-2">sign up</div></form></div></article></body>"""


@pytest.mark.parametrize(
    ("rule", "want"),
    [
        (f"//div[{HAS.format('main-story')}]", ["First one.", "Second one.", "Third."]),
        (f"//article[{HAS.format('tall')}]//div[{HAS.format('xl:m-2')}]", ["Inner text."]),
        ("//article[@id='a2']", ["Inner text."]),
        ("/body/article[1]/p", ["Not this. Nor this."]),
        ("//div/p[2]", ["Second one."]),
        ("//form/div", ["Not this. Nor this."]),  # in an element that holds no text: as if it weren't there
        ("//section", ["Not this. Nor this."]),
        ("article.main-story", ["Not this. Nor this."]),
    ],
)
def test_containers_of_a_page(rule, want):
    assert pages.read(PAGE, rule)[2] == want


def test_records_by_paths_of_a_registry(spark, tmp_path):
    from corpusloom.sources import registries

    paths = {"a": f"//div[{HAS.format('main-story')}]", "b": f"//article[{HAS.format('tall')}]//div[{HAS.format('xl:m-2')}]"}
    (tmp_path / "r.csv").write_text("outlet_id,rule,value,reason\n" + "".join(f'{o},container,"{p}",teasers\n' for o, p in paths.items()) + "a,drop_line,First.*,label\n")
    df = spark.createDataFrame([(o, PAGE, "https://x.org/a") for o in "abc"] + [("a", None, None)], "outlet string, html string, url string")
    got = {r["outlet"]: r["body"] for r in pages.records(df, outlet="outlet", rules=registries.line_rules(spark, str(tmp_path / "r.csv"))).where("error IS NULL").collect()}
    assert got == {"a": "Second one.\nThird.", "b": "Inner text.", "c": "Not this. Nor this."}


def test_share_of_text_that_a_rendered_page_shows(spark):
    from corpusloom.operators import quality

    df = spark.createDataFrame([(["One two, three.", "Четири пет", " "], "ONE TWO three ... Četiri  pet!"), (["one", "more"], "one"), ([], "x"), (["..."], "x"), (None, "x"), (["a"], None)], "p array<string>, r string")
    got = [r[0] for r in df.select(quality.visible_share(F.col("p"), F.col("r"))).collect()]
    assert got == [1.0, 0.5, None, None, None, 0.0]

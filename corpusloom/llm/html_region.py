"""Main text of HTML pages by a maximum-scoring subsequence.

A page is a sequence of words and tags. A word scores a positive weight, a tag a negative one, both learned from
labelled pages; the contiguous run with the largest sum is the page's content, found in one linear scan. Tags are told
apart by name, by whether they open or close, and by their class; a tag that was never seen has its name's weight, or
else the weight of an unknown tag. Words are told apart by the block element that they stand in.

Labelled pages are those with exactly one ``article`` element; its words are the content. A sample of at most
``bound`` of them, the first by a hash, whatever their length, as long as they have at most ``bound_chars`` characters
together (one page at least), trains the weights: a structured perceptron lowers the weights of what the best
run wrongly takes in and raises (tags to LEAST, words to 1, at most) those of what it wrongly leaves out. While
training, words outside the content count three times and words inside half, so that the weights also hold for
adverts and footers three times as long. Tags that mostly stand inside the content keep the smallest weight.

The run's text leaves out comments, the elements in DROPPED, and elements that a class, id or role marks as no part of the
article (``Asides``). Labelled pages don't say which parts within an article are adverts, so these words are given and not
learned; the caller may give others. A class counts as a whole: ``ad`` and ``ads`` mark any element, ``banner`` or
``related`` only containers (a paragraph of that class is text), and a class of several parts counts if all its parts are
such words or words of layout (``related-posts``, but not ``share-price``). Elements end where HTML ends them: at their end
tag, at that of an element around them, and where their end tag may be left out, at the next element that ends them (``p``
at a block, ``li`` at the next ``li`` of its list, cells and rows at the next). Character references are decoded, white
space in a block becomes one space, blocks are joined by one space.

Pages may be of any length, and are searched whole; a page is worked on in one piece, so a task needs memory for its
longest page. Copies of a page get equal texts, and count once in training.

Defined results: a null or empty page, and one without words, has the empty text. Of several runs with the largest sum
the first and shortest is taken. Tags, comments and scripts that never end reach to the page's end. Without a
labelled page DEFAULT_WEIGHTS hold. Other columns pass through untouched.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import text_udf

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|iframe)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-z][a-z0-9:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<bad>/?[a-z])[^>]*(?:>|\Z)",
    re.S | re.I,
)
CLASS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Tags inside a block; all others end it. A line break counts as white space.
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("nav footer aside form script style noscript template textarea iframe button select head title svg".split())
CONTAINERS = frozenset("article div dl fieldset header main ol section table ul".split())
#: Elements that are one token with all that is in them.
RAW = frozenset("script style noscript template textarea iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEAST, LEAST_WORD = -0.01, 0.01


@dataclass(frozen=True)
class Asides:
    """Words in a class, id or role that mark what is no part of an article: ``marks`` on any element, ``boxes`` on
    containers; ``layout`` may stand beside them in a word of several parts."""

    marks: frozenset[str] = frozenset("ad ads advert adverts advertisement advertisements comment comments cookie cookies disclaimer disqus nav navbar navigation newsletter notice notices popup promo promos sidebar sponsored".split())
    boxes: frozenset[str] = frozenset("banner breadcrumb breadcrumbs footer menu related share sharing social subscribe".split())
    layout: frozenset[str] = frozenset("area article articles bar block body bottom box button buttons container content footer form header icons inner item items left links list main outer page panel post posts reader right section signup site slot text thread top unit user widget wrap wrapper".split())

    def holds(self, name: str, classes: list[str]) -> bool:
        if name in DROPPED:
            return True
        known = self.marks | self.boxes if name in CONTAINERS else self.marks
        for c in classes:
            parts = [x for x in re.split(r"[-_]+", c) if x]
            if any(x in known for x in parts) and all(x in self.marks or x in self.boxes or len(parts) > 1 and x in self.layout for x in parts):
                return True
        return False


#: The elements that a start tag ends if they are open, and those beyond which it does not look for them.
CELLS, ROWS = ("td", "th"), ("tr", "thead", "tbody", "tfoot", "caption", "colgroup")
ENDED_BY = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select", "datalist")), "optgroup": (("option", "optgroup"), ("select",))}
ENDED_BY |= {c: (CELLS, ("table",)) for c in CELLS} | {"tr": ((*CELLS, "tr"), ("table",))} | {r: ((*CELLS, *ROWS), ("table",)) for r in ROWS if r != "tr"}
#: A paragraph ends at these.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
P_STOPS = ("button", "caption", "object", "table", "td", "th")


class Open:
    """The block elements that are open, innermost last, with a value each."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.values: list = []

    def _end(self, names: tuple[str, ...], stops: tuple[str, ...]) -> None:
        """Ends the outermost of the named elements that is nearer than any of the stops, and what is in it."""
        at = None
        for i in range(len(self.names) - 1, -1, -1):
            if self.names[i] in stops:
                break
            if self.names[i] in names:
                at = i
        if at is not None:
            del self.names[at:], self.values[at:]

    def start(self, name: str, value) -> None:
        if name in ENDS_P and "p" in self.names:
            self._end(("p",), P_STOPS)
        if name in ENDED_BY:
            self._end(*ENDED_BY[name])
        if name not in VOID:
            self.names.append(name)
            self.values.append(value)

    def end(self, name: str) -> None:
        if name in self.names:
            while self.names.pop() != name:
                self.values.pop()
            self.values.pop()


#: Keys of the tags and of the words that no labelled page had.
UNKNOWN, ANY_WORD = "?", "#"
DEFAULT_WEIGHTS = {UNKNOWN: -1.0, ANY_WORD: 1.0, "#footer": 0.1, "#li": 0.1, "#title": 0.1} | {t: LEAST for t in "p /p b /b i /i em /em strong /strong br h2 /h2 h3 /h3".split()} | {t: -60.0 for t in "article /article nav /nav footer /footer aside /aside header /header /head /title div /div".split()} | {t: -8.0 for t in "li /li a /a".split()}


@dataclass
class Page:
    """Pieces in order: (key, None) for a tag, ("#" and the block element around it, text) for the text between tags."""

    pieces: list[tuple[str, str | None]] = field(default_factory=list)


def key_of(m: re.Match) -> str:
    if m["raw"]:
        return m["raw"].lower()
    if not m["name"]:
        return "!"
    name = m["name"].lower()
    if m["close"]:
        return "/" + name
    words = [w for x in CLASS.findall(m["rest"]) for w in "".join(x).lower().split()]
    return ".".join([name, *sorted(set(words))]) if words else name


def read(page: str | None) -> Page:
    out, at = Page(), 0
    if not page:
        return out
    around = Open()
    for m in TOKEN.finditer(page):
        if m.start() > at:
            out.pieces.append(("#" + (around.values[-1] if around.values else ""), page[at : m.start()]))
        key = key_of(m)
        out.pieces.append((key, None))
        at = m.end()
        name = key.lstrip("/").split(".")[0]
        if key != "!" and not m["raw"] and name not in INLINE:
            if m["close"]:
                around.end(name)
            else:
                around.start(name, key)
    if at < len(page):
        out.pieces.append(("#" + (around.values[-1] if around.values else ""), page[at:]))
    return out


def weight(weights: dict[str, float], key: str) -> float:
    if key in weights:
        return weights[key]
    name = key.split(".")[0]
    if name in weights:
        return weights[name]
    return weights.get(ANY_WORD, 1.0) if key.startswith("#") else weights.get(UNKNOWN, -1.0)


def best_run(page: Page, weights: dict[str, float], inside: tuple[int, int] | None = None) -> tuple[int, int]:
    """[begin, end) of the pieces with the largest sum; empty if there is no word. With ``inside``, words outside that
    range count three times and those inside half."""
    best, run, begin, found = 0.0, 0.0, 0, (0, 0)
    for i, (key, text) in enumerate(page.pieces):
        gain = weight(weights, key)
        if text is not None:
            gain *= len(text.split())
            if inside is not None:
                gain *= 0.5 if inside[0] <= i < inside[1] else 3.0
        if run <= 0:
            run, begin = 0.0, i
        run += gain
        if run > best:
            best, found = run, (begin, i + 1)
    return found


def labelled(page: Page) -> tuple[int, int] | None:
    """[begin, end) of the content of a page with exactly one article: from its first to its last words."""
    opens = [i for i, (k, _) in enumerate(page.pieces) if k.split(".")[0] == "article"]
    closes = [i for i, (k, _) in enumerate(page.pieces) if k == "/article"]
    if len(opens) != 1 or len(closes) != 1 or closes[0] < opens[0]:
        return None
    words = [i for i in range(opens[0], closes[0]) if page.pieces[i][1] is not None and page.pieces[i][1].split()]
    return (words[0], words[-1] + 1) if words else None


def train(pages: list[str], rounds: int = 60, rate: float = 0.5) -> dict[str, float]:
    """Weights of the tags of labelled pages."""
    data = [(p, span) for p in map(read, sorted(pages)) if (span := labelled(p))]
    if not data:
        return dict(DEFAULT_WEIGHTS)
    keys = {k for p, _ in data for k, _ in p.pieces}
    weights = {k: 1.0 if k.startswith("#") else LEAST for k in keys}
    inside, everywhere = (Counter(k for p, (a, b) in data for k, _ in p.pieces[a * cut : b if cut else None]) for cut in (1, 0))
    inner = {k for k in keys if not k.startswith("#") and 2 * inside[k] > everywhere[k]}  # these keep LEAST
    for _ in range(rounds):
        wrong = 0
        for p, gold in data:
            got = best_run(p, weights, gold)
            if got == gold:
                continue
            wrong += 1
            change: dict[str, float] = {}
            for (a, b), sign in ((gold, rate), (got, -rate)):
                for k, text in p.pieces[a:b]:
                    if k in inner:
                        continue
                    change[k] = change.get(k, 0.0) + sign * (1 if text is None else len(text.split()) / 50)
            for k, d in change.items():
                if k.startswith("#"):
                    weights[k] = min(1.0, max(LEAST_WORD, weights[k] + min(0.2, max(-0.2, d))))
                else:
                    weights[k] = min(LEAST, weights[k] + d)
        if not wrong:
            break
    tags = [k for k in keys if not k.startswith("#")]
    for name in {k.split(".")[0] for k in tags}:
        if name not in weights:
            weights[name] = min(v for k, v in weights.items() if k.split(".")[0] == name)
    return weights | {UNKNOWN: sum(weights[k] for k in tags) / len(tags), ANY_WORD: 1.0}


def text_of(page: Page, span: tuple[int, int], asides: Asides = Asides()) -> str:
    """The text of the pieces in the span. Asides that were open before it count only if they begin right before it and
    end in it; what else is open there ends elements in the span, but hides nothing."""
    blocks, current, around, known = [], [], Open(), {}
    led_in: list[str] = []  # asides that began right before the span
    for i, (key, text) in enumerate(page.pieces[: span[1]]):
        inside = i >= span[0]
        if text is not None:
            if inside and True not in around.values:
                current.append(text)
            elif not inside and text.strip():
                led_in.clear()
            continue
        name, *classes = key.lstrip("/").split(".")
        if inside and key == "br":
            current.append(" ")
        elif inside and key != "!" and name not in INLINE:
            blocks.append("".join(current))
            current = []
        if key.startswith("/"):
            around.end(name)
        elif key != "!" and name not in RAW:
            if key not in known:
                known[key] = asides.holds(name, classes)
            if name not in INLINE or known[key]:
                around.start(name, known[key] if inside else f"before {i}")
                if not inside and known[key] and name not in VOID:
                    led_in.append(f"before {i}")
        while led_in and led_in[-1] not in around.values:
            led_in.pop()
            if inside:  # all so far stood in it
                blocks, current = [], []
    blocks.append("".join(current))
    squeezed = (" ".join(html.unescape(b).split()) for b in blocks)
    return " ".join(b for b in squeezed if b)


def extract(page: str | None, weights: dict[str, float], asides: Asides = Asides()) -> str:
    p = read(page)
    return text_of(p, best_run(p, weights), asides)


def fit(df: DataFrame, page: str = "html", bound: int = 400, bound_chars: int = 40_000_000) -> dict[str, float]:
    """Weights from at most ``bound`` different labelled pages of at most ``bound_chars`` characters together (one page
    may have more), brought to the driver."""
    known = df.select(F.col(page).cast("string").alias("p"), F.xxhash64(F.col(page).cast("string")).alias("h")).where(F.col("p").contains("<article"))
    chosen, held = [], 0
    for r in known.groupBy("h").agg(F.max(F.length("p")).alias("n")).orderBy("h").limit(bound).collect():
        held += r["n"]
        if chosen and held > bound_chars:
            break
        chosen.append(r["h"])
    pages = known.where(F.col("h").isin(chosen)).groupBy("h").agg(F.min("p").alias("p")) if chosen else known.limit(0)
    return train([r["p"] for r in pages.orderBy("h").collect()])


def with_text(df: DataFrame, weights: dict[str, float], page: str = "html", into: str = "main_text", asides: Asides = Asides()) -> DataFrame:
    """df with a column of the page's main text."""
    return df.withColumn(into, text_udf(lambda pages: pa.array([extract(p, weights, asides) for p in pages], pa.string()), "string")(F.col(page).cast("string")))

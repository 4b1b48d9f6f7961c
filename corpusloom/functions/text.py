"""Text as column expressions: scripts, hashes, paragraphs, rendering."""

from __future__ import annotations

import html

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.matching import ratio

#: Serbian Cyrillic letters and their Latin forms, digraphs first.
DIGRAPHS = {"Љ": "Lj", "Њ": "Nj", "Џ": "Dž", "љ": "lj", "њ": "nj", "џ": "dž"}
CYRILLIC = "АБВГДЂЕЖЗИЈКЛМНОПРСТЋУФХЦЧШ"
LATIN = "ABVGDĐEŽZIJKLMNOPRSTĆUFHCČŠ"
#: A white space character, with (?U).
SPACE = r"[\s\x1c-\x1f]"


def to_latin(text: Column) -> Column:
    for a, b in DIGRAPHS.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.translate(text, CYRILLIC + CYRILLIC.lower(), LATIN + LATIN.lower())


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def cyrillic_share(text: Column) -> Column:
    """Characters of the Cyrillic block per letter; 0 without letters."""
    letters = F.regexp_replace(text, r"[^\p{L}\p{Nl}\p{No}]", "")
    return _share(F.length(F.regexp_replace(text, r"[^Ѐ-ӿ]", "")), F.length(letters))


def script(share: Column) -> Column:
    return F.when(share > 0.6, "cyrl").when(share > 0.1, "mixed").otherwise("latn")


def stripped(text: Column) -> Column:
    """Without white space at its ends."""
    return F.regexp_replace(text, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def blank(text: Column) -> Column:
    return ~text.rlike(r"(?U)[^\s\x1c-\x1f]")


def squeezed(text: Column) -> Column:
    """White space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, rf"(?U){SPACE}+", " "))


def normalised(text: Column) -> Column:
    """Lower case, marks as blanks, white space squeezed."""
    return squeezed(F.regexp_replace(F.lower(text), r"(?U)[^\p{L}\p{N}_\s]", " "))


def body_hash(text: Column) -> Column:
    return F.left(F.sha2(normalised(text), 256), F.lit(32))


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def paragraph_offsets(text: Column) -> Column:
    """array<array<int>> of [begin, end) in characters of the lines that aren't blank.

    Line ends are found by their places: a running sum of lengths would have to be carried through an array, at a cost
    that grows with the square of the lines."""

    @F.arrow_udf("array<array<int>>")
    def offsets(batch: pa.Array) -> pa.Array:
        out = []
        for x in batch.to_pylist():
            at, found = 0, []
            for line in x.split("\n") if x is not None else ():
                if line and not line.isspace():
                    found.append([at, at + len(line)])
                at += len(line) + 1
            out.append(None if x is None else found)
        return pa.array(out, pa.list_(pa.list_(pa.int32())))

    return offsets(text)


def paragraphs(text: Column, offsets: Column) -> Column:
    """The text's parts at the offsets."""
    return F.transform(offsets, lambda o: F.substring(text, o[0] + 1, o[1] - o[0]))


def kept_lines(text: Column, drop: list[str], end: list[str]) -> Column:
    """Lines of the text up to the first that fully matches a pattern of ``end``, without those that fully match one of
    ``drop``. Patterns are held against the line's Latin form, stripped."""
    form = lambda x: to_latin(stripped(x))
    found = lines(text)
    if end:
        marks = F.transform(found, lambda x: F.when(form(x).rlike("^(?:" + "|".join(end) + ")$"), 1).otherwise(0))
        first = F.array_position(marks, 1)
        found = F.when(first > 0, F.slice(found, F.lit(1), (first - 1).cast("int"))).otherwise(found)
    if drop:
        found = F.filter(found, lambda x: ~form(x).rlike("^(?:" + "|".join(drop) + ")$"))
    return F.regexp_replace(F.array_join(found, "\n"), r"^\n+|\n+$", "")


def without_headline(body: Column, title: Column) -> Column:
    """The body without blank lines at its head and without a first line that repeats the title."""
    full = lines(body)
    first = F.array_position(F.transform(full, lambda x: (~blank(x)).cast("int")), 1)
    rest = F.when(first > 0, F.slice(full, first.cast("int"), F.size(full))).otherwise(F.array().cast("array<string>"))
    repeats = (F.size(rest) > 0) & (normalised(F.get(rest, F.lit(0))) == normalised(title)) & (normalised(title) != "")
    return F.array_join(F.when(repeats, F.slice(rest, F.lit(2), F.size(rest))).otherwise(rest), "\n")


def numbered(parts: Column) -> Column:
    """Parts that aren't empty as "[p1] ...", numbered from 1, a line each."""
    full = F.filter(F.transform(parts, stripped), lambda x: x != "")
    return F.array_join(F.transform(full, lambda x, i: F.concat(F.lit("[p"), (i + 1).cast("string"), F.lit("] "), x)), "\n")


def article(title: Column, day: Column, lead: Column, parts: Column) -> Column:
    """What a coder or a model reads of an article: never where it is from."""
    head = [F.concat(F.lit(f"{name}: "), F.coalesce(value.cast("string"), F.lit(""))) for name, value in (("Title", title), ("Date", day), ("Lead", lead))]
    body = numbered(parts)
    return F.concat(F.concat_ws("\n", *head), F.lit("\n"), F.when(body != "", F.concat(F.lit("\n"), body)).otherwise(F.lit("")))


def embedding_input(title: Column, lead: Column, body: Column, most: int = 8000) -> Column:
    """"title: T | text: lead, newline, body", the body cut to ``most`` characters; empty parts are left out."""
    nonempty = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    text = F.concat_ws("\n", nonempty(lead), nonempty(F.left(F.coalesce(body, F.lit("")), F.lit(most))))
    return F.concat(F.lit("title: "), F.coalesce(nonempty(title), F.lit("none")), F.lit(" | text: "), text)


def evidence_pointers(evidence: Column) -> Column:
    """Pointers p3, p10-p12, headline, lead, in order, joined by ", "; null if there are none."""
    found = F.regexp_extract_all(evidence, F.lit(r"(\bp\d+(?:\s*-\s*p\d+)?\b|\bheadline\b|\blead\b)"), F.lit(1))
    return F.nullif(F.array_join(F.transform(found, lambda x: F.regexp_replace(x, r"\s+", "")), ", "), F.lit(""))


def signature(*parts: Column) -> Column:
    """MD5 of the parts; null counts as empty."""
    joined = [x for p in parts for x in (F.lit("\x1f"), F.coalesce(p.cast("string"), F.lit("")))][1:]
    return F.md5(F.concat(*joined))


def searchable(title: Column, lead: Column, body: Column) -> Column:
    return F.lower(F.concat(title, F.lit("\n"), lead, F.lit("\n"), body))


@F.arrow_udf(T.DoubleType())
def similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    """Ratcliff-Obershelp ratio of whole texts; null if either is null."""
    return pa.array([None if x is None or y is None else ratio(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())


@F.arrow_udf(T.StringType())
def unescaped(a: pa.Array) -> pa.Array:
    """Character references decoded."""
    return pa.array([None if x is None else html.unescape(x) for x in a.to_pylist()], pa.string())


def without_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", " ")


def tags(page: Column, name: str) -> Column:
    """The start tags of a name."""
    return F.regexp_extract_all(page, F.lit(rf"(?i)<{name}\b[^>]*>"), F.lit(0))


def attribute(tag: Column, names: str) -> Column:
    """The value of the first quoted attribute of a start tag that has one of the names; empty if there is none."""
    quoted = F.regexp_extract(tag, rf"""(?i)\s(?:{names})\s*=\s*("[^"]*"|'[^']*')""", 1)
    return F.substring(quoted, F.lit(2), F.greatest(F.length(quoted) - 2, F.lit(0)))


def links(page: Column, relation: str) -> Column:
    """The addresses of a page's link elements of a relation, in order, whatever the order of their attributes."""
    wanted = F.filter(tags(page, "link"), lambda x: F.array_contains(F.split(F.lower(attribute(x, "rel")), r"\s+"), relation))
    return F.filter(F.transform(wanted, lambda x: attribute(x, "href")), lambda x: x != "")

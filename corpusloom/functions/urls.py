"""URLs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Beginnings of query parameters that only track the reader.
TRACKING = ("utm_", "fbclid", "gclid", "mc_cid", "mc_eid")
#: First path segments that name a script and not a section.
SCRIPTS = ("lat", "ci", "sr", "scc")


def decoded(text: Column) -> Column:
    """Text of a query part: + is a blank, % and two hex digits are a byte; any other % stands for itself."""
    return F.url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def encoded(text: Column) -> Column:
    """Text as a query part; letters, digits and _ . - ~ stay as they are."""
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def _parameter(pair: Column) -> Column:
    """name and value of name=value; without = the value is empty."""
    at = F.instr(pair, "=")
    name, value = F.when(at > 0, F.left(pair, at - 1)).otherwise(pair), F.when(at > 0, F.substring(pair, at + 1, F.length(pair))).otherwise("")
    return F.struct(decoded(name).alias("name"), decoded(value).alias("value"))


def canonical(url: Column) -> Column:
    """One form for a page's URLs: scheme and host in lower case, no fragment, no tracking parameters, query encoded
    anew. The path keeps its case."""
    whole = F.regexp_replace(url, r"^\s+|\s+$", "")
    address = F.get(F.split(whole, "#", 2), F.lit(0))
    halves = F.split(address, r"\?", 2)
    before, query = F.get(halves, F.lit(0)), F.coalesce(F.get(halves, F.lit(1)), F.lit(""))
    site = F.regexp_extract(before, "^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/]*)?", 0)
    parameters = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), _parameter)
    tracks = lambda name: F.exists(F.array(*map(F.lit, TRACKING)), lambda t: F.startswith(F.lower(name), t))
    kept = F.transform(F.filter(parameters, lambda x: ~tracks(x["name"])), lambda x: F.concat(encoded(x["name"]), F.lit("="), encoded(x["value"])))
    return F.concat(F.lower(site), F.substring(before, F.length(site) + 1, F.length(before)), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def host(url: Column) -> Column:
    """Host in lower case without a leading www.; empty for what is no URL."""
    return F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))), r"^www\.", "")


def path(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))


def segments(url: Column) -> Column:
    """The path's parts between slashes, without empty ones."""
    return F.filter(F.split(path(url), "/"), lambda x: x != "")


def section(url: Column) -> Column:
    """First segment of the path that names no script, in lower case; empty if there is none."""
    named = F.filter(F.transform(segments(url), F.lower), lambda x: ~x.isin(*SCRIPTS))
    return F.coalesce(F.get(named, F.lit(0)), F.lit(""))


def article_number(url: Column) -> Column:
    """The first segment of the path that is a number of five to eight digits; null if there is none."""
    digits = F.filter(segments(url), lambda x: F.length(x).between(5, 8) & (F.translate(x, "0123456789", "") == ""))
    return F.get(digits, F.lit(0)).cast("bigint")


def numbers(url: Column) -> Column:
    """All article numbers in the path: four digits or more at the head of a segment, with nothing, a dash or a point
    behind them."""
    heads = F.transform(segments(url), lambda x: F.get(F.split(x, "[-.]", 2), F.lit(0)))
    return F.filter(heads, lambda x: (F.length(x) >= 4) & (F.translate(x, "0123456789", "") == ""))


def soft_404(requested: Column, final: Column) -> Column:
    """The requested path carries an article number, and the final one shares none."""
    a = numbers(requested)
    return F.coalesce((requested != final) & (final != "") & (F.size(a) > 0) & ~F.arrays_overlap(a, numbers(final)), F.lit(False))


def suffixes(h: Column) -> Column:
    """The host and its parents of two labels or more, longest first."""
    labels = F.split(h, r"\.")
    n = F.size(labels)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(labels, i, n), ".")))


def is_candidate(hosts: list[Column], domains: list[str], top: str = ".rs") -> Column:
    """Any of the hosts is in the top-level domain, or is or lies under a registered domain."""
    known = F.array(*map(F.lit, domains)) if domains else F.array().cast("array<string>")
    return F.exists(F.array(*[F.coalesce(h, F.lit("")) for h in hosts]), lambda h: F.endswith(h, F.lit(top)) | F.arrays_overlap(suffixes(h), known))

"""URL filter: allow and block rules for hosts and paths, then a weighted vocabulary.

An Aho-Corasick automaton finds the vocabulary's terms in the lower-cased host and path in one pass. A hit counts
only with a boundary on either side (the text's end, or a character that is no ASCII letter or digit). One strict
term rejects a URL, and so do soft terms whose weights, each different term once, sum up to ``soft_needed``. The vocabulary
is a table of terms (``vocabulary``), in lower case, of which MOST_TERMS are allowed, as it goes to every task; STRICT
and SOFT (each of weight 1) are what the query takes.

The host is what stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; the path is
what follows, up to ``?`` or ``#``. A rule fits its host and all its subdomains if the path starts with the rule's. Of
the rules that fit, the longest (host and path together) decides; rules of one length can't fit one URL both unless
they are equal. The verdict is the rule's, or else the vocabulary's.

Defined results: a null URL, or one without ``://``, has an empty host and path, no rule, and the verdict ``allow``.
Repeated rows get equal results. URLs may be of any length. Other columns pass through untouched; a column of the name
``into`` is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import text_udf, unused

STRICT = ("casino", "porn", "xxx", "viagra", "malware", "phishing")
SOFT = ("ads", "bet", "bets", "bonus", "cheap", "deal", "deals", "farm", "free", "loan", "pills", "poker", "spam", "track", "win")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Terms of a vocabulary at most.
MOST_TERMS = 200_000


def vocabulary(terms: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """(strict, soft) terms with their weights, from a table (term, strict boolean, weight double). A term that is there
    more than once is strict if it is so once, and has its largest weight; a null weight is 1. Terms that are null or
    empty are left out; more than MOST_TERMS are an error."""
    term = F.translate(F.col("term"), UPPER, LOWER).alias("term")
    rows = terms.where("term IS NOT NULL AND term <> ''").groupBy(term).agg(F.bool_or(F.coalesce("strict", F.lit(False))).alias("strict"), F.max(F.coalesce("weight", F.lit(1.0))).alias("weight")).limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms")
    return tuple({r["term"]: r["weight"] for r in sorted(rows) if r["strict"] == kind} for kind in (True, False))


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest fitting rule as struct(name, verdict), or null."""
    found = F.lit(None).cast("struct<name:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = F.endswith(F.concat(F.lit("."), host), F.lit("." + r.host)) & F.startswith(path, F.lit(r.path))
        found = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


@lru_cache(maxsize=4)
def automaton(strict: tuple[str, ...], soft: tuple[str, ...]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for term in soft:
        a.add_word(term, (term, False))
    for term in strict:
        a.add_word(term, (term, True))
    if len(a):
        a.make_automaton()
    return a


def inside(c: str) -> bool:
    return c.isascii() and c.isalnum()


def hits(text: str, strict: tuple[str, ...], soft: tuple[str, ...]) -> tuple[set[str], set[str]]:
    """The different (strict, soft) terms that stand in the text with boundaries."""
    a = automaton(strict, soft)
    found: tuple[set[str], set[str]] = (set(), set())
    if not len(a):
        return found
    for end, (term, is_strict) in a.iter(text):
        begin = end - len(term)
        if (begin < 0 or not inside(text[begin])) and (end + 1 == len(text) or not inside(text[end + 1])):
            found[0 if is_strict else 1].add(term)
    return found


def counter(strict: dict[str, float], soft: dict[str, float]):
    """Text column to struct(strict, soft, weight): how many different terms of each kind stand in it, and the soft ones'
    weight."""
    names = tuple(strict), tuple(soft)

    def count(texts: list[str | None]) -> pa.Array:
        found = [hits(t, *names) if t else ((), ()) for t in texts]
        sizes = [pa.array([len(x[k]) for x in found], pa.int32()) for k in (0, 1)]
        return pa.StructArray.from_arrays([*sizes, pa.array([float(sum(soft[t] for t in x[1])) for x in found], pa.float64())], ["strict", "soft", "weight"])

    return text_udf(count, "struct<strict:int,soft:int,weight:double>")


def weighed(terms: dict[str, float] | tuple[str, ...]) -> dict[str, float]:
    return terms if isinstance(terms, dict) else dict.fromkeys(terms, 1.0)


def judge(df: DataFrame, url: str = "url", into: str = "judged", rules: tuple[Rule, ...] = RULES, strict: dict[str, float] | tuple[str, ...] = STRICT, soft: dict[str, float] | tuple[str, ...] = SOFT, soft_needed: float = 2) -> DataFrame:
    """df with a struct column: host, path, rule (null if none), verdict, strict and soft hits. ``strict`` and ``soft``:
    terms with their weights, or terms of weight 1."""
    host, path = host_and_path(F.col(url).cast("string"))
    parts, terms = unused(f"{into}_parts", df), unused(f"{into}_terms", df)
    df = df.withColumn(parts, F.struct(host.alias("host"), path.alias("path")))
    h, p = F.col(parts)["host"], F.col(parts)["path"]
    df = df.withColumn(terms, counter(weighed(strict), weighed(soft))(F.translate(F.concat(h, p), UPPER, LOWER)))
    n = F.col(terms)
    rejected = (n["strict"] > 0) | (n["weight"] >= soft_needed)
    rule = rule_of(h, p, rules)
    fields = F.struct(
        h.alias("host"),
        p.alias("path"),
        rule["name"].alias("rule"),
        F.coalesce(rule["verdict"], F.when(rejected, "block").otherwise("allow")).alias("verdict"),
        n["strict"].alias("strict_hits"),
        n["soft"].alias("soft_hits"),
    )
    return df.withColumn(into, fields).drop(parts, terms)


def oracle_sql(strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT, soft_needed: int = 2, rules: tuple[Rule, ...] = RULES) -> str:
    def found(term: str) -> str:
        return f"regexp_matches(t, '(^|[^a-z0-9]){term}([^a-z0-9]|$)')::INT"

    def total(terms: tuple[str, ...]) -> str:
        return " + ".join(map(found, terms)) or "0"

    def fits(r: Rule) -> str:
        return f"WHEN ends_with('.' || host, '.{r.host}') AND starts_with(path, '{r.path}')"

    order = sorted(rules, key=lambda r: (-len(r.name), r.name))
    return f"""
WITH rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
),
joined AS (SELECT *, translate(host || path, '{UPPER}', '{LOWER}') AS t FROM parts),
hits AS (SELECT *, {total(strict)} AS strict_hits, {total(soft)} AS soft_hits FROM joined)
SELECT page_id, host, path,
  CASE {" ".join(f"{fits(r)} THEN '{r.name}'" for r in order)} END AS rule,
  CASE {" ".join(f"{fits(r)} THEN '{r.verdict}'" for r in order)} WHEN strict_hits > 0 OR soft_hits >= {soft_needed} THEN 'block' ELSE 'allow' END AS verdict,
  strict_hits::INT AS strict_hits, soft_hits::INT AS soft_hits
FROM hits"""

"""Nomination of documents by lists of search terms."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import dialects
from corpusloom.functions import text as tx
from corpusloom.functions.slices import text_udf


@dataclass(frozen=True)
class Term:
    list: str
    pattern: str

    def column(self, text: Column) -> Column:
        """All parts are found in the (lower-case) text."""
        return reduce(lambda a, b: a & b, (text.rlike(dialects.java(p)) for p in dialects.parts(self.pattern)))

    def sql(self, text: str) -> str:
        return "(" + " AND ".join(f"regexp_matches({text}, '{dialects.re2(p)}')" for p in dialects.parts(self.pattern)) + ")"


def terms_of(rows: list[tuple[str, str]]) -> list[Term]:
    terms = [Term(a, b) for a, b in rows]
    for t in terms:
        dialects.parts(t.pattern)
    return terms


def version(terms: list[Term]) -> str:
    """A name for the terms in their order."""
    return "lex-" + hashlib.sha256("\n".join(f"{t.list}:{t.pattern}" for t in terms).encode()).hexdigest()[:10]


#: Terms whose flags are bits of one number.
PER_MASK = 60


def match(df: DataFrame, text: str, terms: list[Term]) -> DataFrame:
    """df with hit_<list> (number of terms found), terms ("list: term" of those found, by list) and candidate (any
    found). A null text has no hits. Each pattern is held against a text once: all else is made from bits."""
    lists = list(dict.fromkeys(t.list for t in terms))
    terms = sorted(terms, key=lambda t: lists.index(t.list))
    flag = lambda t, i: F.when(t.column(F.col(text)), F.lit(1 << i % PER_MASK)).otherwise(F.lit(0)).cast("bigint")
    masks = {f"_m{k}": reduce(lambda a, b: a.bitwiseOR(b), [flag(t, i) for i, t in enumerate(terms) if i // PER_MASK == k], F.lit(0).cast("bigint")) for k in range(-(-len(terms) // PER_MASK) or 1)}
    df = df.withColumns(masks)
    bit = lambda i: F.col(f"_m{i // PER_MASK}").bitwiseAND(F.lit(1 << i % PER_MASK)) != 0
    # joined and split, not filtered by a lambda, so that it is generated code
    joined = F.concat_ws("\x01", *[F.when(bit(i), f"{t.list}: {t.pattern}") for i, t in enumerate(terms)])
    found = F.when(reduce(lambda p, q: p & q, [F.col(m) == 0 for m in masks]), F.array().cast("array<string>")).otherwise(F.split(joined, "\x01"))
    hits = {}
    for x in lists:
        own = [sum(1 << i % PER_MASK for i, t in enumerate(terms) if t.list == x and i // PER_MASK == k) for k in range(len(masks))]
        hits[f"hit_{x}"] = sum((F.bit_count(F.col(f"_m{k}").bitwiseAND(F.lit(o))).cast("bigint") for k, o in enumerate(own) if o), F.lit(0).cast("bigint"))
    candidate = reduce(lambda p, q: p | q, [F.col(m) != 0 for m in masks])
    return df.withColumns(hits | {"terms": found, "candidate": candidate}).drop(*masks)


#: Terms of a list that is held by every task.
MOST_TERMS = 50_000
#: Bytes of text that are matched with many terms at once.
MATCHED_BYTES = 1 << 20


class Finder:
    """Finds many terms in a text. An automaton reads the text once and says which literals it has; a term is tried only
    where a literal that it needs stands, so the time grows with what is found and hardly with the number of terms. Terms
    that need no literal are tried on every text."""

    def __init__(self, patterns: tuple[str, ...]):
        import ahocorasick
        import regex

        self.parts = [[regex.compile(dialects.python(p), regex.V1) for p in dialects.parts(x)] for x in patterns]
        self.always: list[int] = []
        #: Terms of one part that begins with its literal: they are tried at the literal's place.
        self.there: list[bool] = [False] * len(patterns)
        by_literal: dict[str, list[int]] = {}
        for i, x in enumerate(patterns):
            # all parts must be found, so the literals of any one of them will do: those that are longest
            known = [n for n in map(dialects.needed, dialects.parts(x)) if n]
            if not known:
                self.always.append(i)
                continue
            literals, first = max(known, key=lambda n: min(map(len, n[0])))
            self.there[i] = first and len(self.parts[i]) == 1
            for literal in literals:
                by_literal.setdefault(literal, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for literal, terms in by_literal.items():
            self.automaton.add_word(literal, (len(literal), tuple(terms)))
        if by_literal:
            self.automaton.make_automaton()
        else:
            self.automaton = None

    def __call__(self, text: str | None) -> list[int]:
        """The terms found, in order."""
        if text is None:
            return []
        found, tried = set(), set(self.always)
        for end, (length, terms) in self.automaton.iter(text) if self.automaton else ():
            for i in terms:
                if not self.there[i]:
                    tried.add(i)
                elif i not in found and self.parts[i][0].match(text, end + 1 - length):
                    found.add(i)
        found.update(i for i in tried if all(p.search(text) for p in self.parts[i]))
        return sorted(found)


@lru_cache(maxsize=4)
def _finder(patterns: tuple[str, ...]) -> Finder:
    return Finder(patterns)


def finding(terms: list[Term], lists: list[str]) -> Callable[[Column], Column]:
    """A function of a text column: hits of each list, and the terms found. It takes an Arrow batch in slices."""
    patterns, names = tuple(t.pattern for t in terms), pa.array([f"{t.list}: {t.pattern}" for t in terms], pa.string())
    of = np.array([lists.index(t.list) for t in terms], np.int64)

    def make():
        find = _finder(patterns)

        def look(texts: list[str | None]) -> pa.Array:
            each = [find(x) for x in texts]
            sizes = np.array(list(map(len, each)), np.int64)
            found = np.fromiter(chain.from_iterable(each), np.int64, sizes.sum())
            hits = np.bincount(np.repeat(np.arange(len(each)), sizes) * len(lists) + of[found], minlength=len(each) * len(lists))
            starts = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
            columns = [pa.ListArray.from_arrays(starts(np.full(len(each), len(lists))), pa.array(hits, pa.int64())), pa.ListArray.from_arrays(starts(sizes), names.take(pa.array(found)))]
            return pa.StructArray.from_arrays(columns, ["hits", "terms"])

        return look

    return text_udf(None, "struct<hits:array<bigint>,terms:array<string>>", make, MATCHED_BYTES)


def match_many(df: DataFrame, text: str, terms: list[Term]) -> DataFrame:
    """What ``match`` gives, for hundreds or thousands of terms: a task builds one Finder, and texts go through it in slices
    of Arrow batches, so what a task holds doesn't grow with its batch. For a few dozen terms ``match`` is the better way, as
    it stays in generated code."""
    if len(terms) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms")
    lists = list(dict.fromkeys(t.list for t in terms))
    look = finding(sorted(terms, key=lambda t: lists.index(t.list)), lists)
    # said to be nondeterministic, since what Spark infers from a later explode would else run it twice
    rows = df.withColumn("_found", look.asNondeterministic()(F.col(text)))
    return rows.withColumns({f"hit_{x}": F.get("_found.hits", F.lit(i)) for i, x in enumerate(lists)} | {"terms": F.col("_found.terms"), "candidate": F.size("_found.terms") > 0}).drop("_found")


def searchable(docs: DataFrame, lemmas: DataFrame | None = None, key: str = "event_id", into: str = "searched") -> DataFrame:
    """Documents without error (key, title, lead, body) with the lower-case text that terms are looked for in: title, lead
    and body, and after them the lemmas of the three (``lemmas``: key, lemmas_title, lemmas_lead, lemmas_body) where there
    are any. A document keeps its row whether it has lemmas or not; of several lemma rows of a key the greatest counts."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    text = tx.searchable(blank("title"), blank("lead"), blank("body"))
    rows = docs.where("error IS NULL") if "error" in docs.columns else docs
    if lemmas is None:
        return rows.withColumn(into, text)
    names = [c for c in ("lemmas_title", "lemmas_lead", "lemmas_body") if c in lemmas.columns]
    more = lemmas.groupBy(F.col(key).alias("_key")).agg(F.max(F.lower(F.concat_ws("\n", *names))).alias("_lemmas"))
    joined = rows.join(more, F.col(key) == F.col("_key"), "left").withColumn(into, F.concat_ws("\n", text, F.nullif(F.col("_lemmas"), F.lit(""))))
    return joined.drop("_key", "_lemmas")


def report(matched: DataFrame, by: str, lists: list[str]) -> DataFrame:
    """Documents, candidates and hits of each list, by group and in all (null group), in one pass."""
    counts = [F.count("*").alias("docs"), F.count_if("candidate").alias("candidates")] + [F.count_if(F.col(f"hit_{x}") > 0).alias(f"docs_{x}") for x in lists]
    return matched.rollup(by).agg(*counts)


def per_term(matched: DataFrame, terms: list[Term]) -> DataFrame:
    """(term, docs) of the terms that documents have, most first: one row of counts, turned into a row a term. Nothing is
    exploded, so no pattern stands in a filter before it, and the few rows are put in order by one task."""
    names = [f"{t.list}: {t.pattern}" for t in terms]
    counts = matched.agg(*[F.count_if(F.array_contains("terms", n)).alias(f"n{i}") for i, n in enumerate(names)])
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("term"), F.col(f"n{i}").alias("docs")) for i, n in enumerate(names)])).alias("x")
    return counts.select(pairs).select("x.*").where("docs > 0").sortWithinPartitions(F.desc("docs"), "term")


def per_term_many(matched: DataFrame) -> DataFrame:
    """(term, docs) of the terms that documents have, counted by a shuffle of (term, count), for lists of many terms."""
    return matched.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("docs"))


def only_through(matched: DataFrame, name: str) -> DataFrame:
    """One row: candidates, and those that have no term of the list ``name``, or that and more terms than one."""
    has = F.col(f"hit_{name}") > 0
    return matched.agg(F.count_if("candidate").alias("candidates"), F.count_if(F.col("candidate") & ~has).alias("without"), F.count_if(F.col("candidate") & has & (F.size("terms") > 1)).alias("among_others"))

"""What filters that are applied one after the other take from each other.

Every row has a flag for each filter (set where the row fails it), a part and some marks (as: good by its label). For
every part and every order of the filters the audit says what each step keeps and removes, how many of those that fail
its filter an earlier step had taken already, and how many marked rows go with it.

The flags are packed: of each batch of a partition's rows, NumPy makes a bitset for each filter and each mark, in which
the rows of a part lie side by side and begin at a word of their own. What is left after a set of filters is the bitset
of the rows AND NOT theirs; as the order within the set doesn't matter, 2 ** k sets answer for all k! orders. Counts are
popcounts of words, summed over the words of a part, over the batches of a partition and, by Spark, over the partitions.
A task sends k * 2 ** (k - 1) rows a part, so neither the number of rows nor a part with a third of them matters.

Defined results: null flags and marks count as not set, a null part is the empty string. Repeated rows count each time.
Every part has a row for each order and step, zeros included; an empty table has none. Further columns are left alone.

The flags of the query: words are maximal runs of other than ASCII white space, empty and null texts have none. Copies are
told by SHA-256, in one aggregation of digests; of each text the smallest id is no copy. Rows without an id are no
copies and have no label; a label that is repeated marks a document if one of its rows does. A text of any length is
split into words in one piece, so a task needs some twenty times its longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import stored

#: Filters at most: k! orders of k steps are returned for each part.
MOST_FILTERS = 8
#: Parts whose counts a task holds at once.
HELD_PARTS = 4096
WORD_BITS = 64


def prefixes(k: int) -> list[tuple[int, int]]:
    """(set of filters that came before, filter) of every step that any order has; the set as bits."""
    return [(before, f) for before in range(1 << k) for f in range(k) if not before >> f & 1]


class Bitsets:
    """The bitsets of one batch. ``column``: a boolean array to words; the rows of part p are in words begin[p] on."""

    def __init__(self, part: np.ndarray, parts: int):
        count = np.bincount(part, minlength=parts)
        words = -(-count // WORD_BITS)
        self.begin = np.cumsum(words) - words
        self.length = int(words.sum()) * WORD_BITS
        order = np.argsort(part, kind="stable")
        within = np.arange(len(part)) - np.repeat(np.cumsum(count) - count, count)
        self.place = np.empty(len(part), np.int64)
        self.place[order] = self.begin[part[order]] * WORD_BITS + within

    def column(self, flags: np.ndarray) -> np.ndarray:
        bits = np.zeros(self.length, bool)
        bits[self.place] = flags
        return np.packbits(bits).view(np.uint64)

    def popcounts(self, words: np.ndarray) -> np.ndarray:
        """Set bits of each part; every part of a batch has rows, so none of the sums is of nothing."""
        return np.add.reduceat(np.bitwise_count(words).astype(np.int64), self.begin)


def counted(part: np.ndarray, parts: int, filters: list[np.ndarray], marks: list[np.ndarray]) -> np.ndarray:
    """[part, step of prefixes(), (kept, removed, removed with each mark)] of one batch."""
    sets = Bitsets(part, parts)
    failing = [sets.column(f) for f in filters]
    marked = [sets.column(m) for m in marks]
    left = [sets.column(np.ones(len(part), bool))]
    for chosen in range(1, 1 << len(filters)):
        last = chosen.bit_length() - 1
        left.append(left[chosen ^ 1 << last] & ~failing[last])
    out = []
    for before, f in prefixes(len(filters)):
        gone = left[before] & failing[f]
        out.append([sets.popcounts(x) for x in (left[before | 1 << f], gone, *(gone & m for m in marked))])
    return np.array(out).transpose(2, 0, 1)


def prefix_counts(flags: DataFrame, filters: list[str], part: str, marks: list[str]) -> DataFrame:
    """(part, before, filter, kept, removed, lost_<mark>...) of every part and step; before is a set of filters as bits."""
    if not 1 <= len(filters) <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters, not {len(filters)}")
    steps, values = prefixes(len(filters)), ["kept", "removed", *(f"lost_{m}" for m in marks)]
    names = ["part", "before", "filter", *values]

    def rows(held: dict[str, np.ndarray]) -> pa.RecordBatch:
        table = np.concatenate(list(held.values()))
        columns = [pa.array(np.repeat(np.array(list(held), object), len(steps)), pa.string())]
        columns += [pa.array(np.tile([s[i] for s in steps], len(held)), pa.int32()) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array(c, pa.int64()) for c in table.T)], names=names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column(0).dictionary_encode()
            bits = [c.to_numpy(zero_copy_only=False).astype(bool) for c in batch.columns[1:]]
            got = counted(coded.indices.to_numpy(), len(coded.dictionary), bits[: len(filters)], bits[len(filters) :])
            for name, table in zip(coded.dictionary.to_pylist(), got):
                held[name] = held[name] + table if name in held else table
            if len(held) >= HELD_PARTS:
                yield rows(held)
                held = {}
        if held:
            yield rows(held)

    needed = flags.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), *[F.coalesce(F.col(c).cast("boolean"), F.lit(False)) for c in [*filters, *marks]])
    schema = "part string, before int, filter int, " + ", ".join(f"`{v}` bigint" for v in values)
    return needed.mapInArrow(count, schema).groupBy("part", "before", "filter").agg(*[F.sum(v).alias(v) for v in values])


def audit(flags: DataFrame, filters: list[str], part: str, marks: list[str]) -> DataFrame:
    """A row for every part, order of the filters and step: part, filter_order (names joined), step from 1, kept, removed,
    redundant, unique_fails, lost_<mark>..., and shapley, what its filter removes in all orders together."""
    k = len(filters)
    lost = [f"lost_{m}" for m in marks]
    # a few rows for each part, which are read twice
    counts = stored(prefix_counts(flags, filters, part, marks), "prefix-counts")
    orders = [("".join(filters[f] for f in order), i + 1, sum(1 << f for f in order[:i]), f) for order in permutations(range(k)) for i, f in enumerate(order)]
    steps = flags.sparkSession.createDataFrame(orders, "filter_order string, step int, before int, filter int")
    # each set of filters before this one is met in so many orders
    times = F.element_at(F.lit([factorial(n) * factorial(k - 1 - n) for n in range(k)]), F.bit_count("before") + 1)
    whole_filter = counts.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("before") == 0, F.col("removed"))).alias("failing"),
        F.sum(F.when(F.bit_count("before") == k - 1, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * times).alias("shapley"),
    )
    joined = counts.join(whole_filter, ["part", "filter"]).join(F.broadcast(steps), ["before", "filter"])
    return joined.select("part", "filter_order", "step", "kept", "removed", (F.col("failing") - F.col("removed")).alias("redundant"), "unique_fails", *lost, "shapley")


WORDS_APART = r"[\x20\x09-\x0D]+"


def text_flags(text: Column) -> dict[str, Column]:
    """The four of the query's filters that look at one text alone."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, WORDS_APART), "")
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 10 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def document_flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A to E, quality, toxic) of every document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), *[c.alias(n) for n, c in text_flags(F.col("text")).items()])
    own = stored(own, "filter-flags")  # texts are read once; from here on a row has some 60 bytes
    named = own.where("doc_id IS NOT NULL")
    first = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.max(F.coalesce(F.col(m) == 1, F.lit(False))).alias(m) for m in ("quality", "toxic")])
    # joined by the id, which no group of copies shares
    both = named.join(first, ["doc_id", "digest"], "left").join(marks, "doc_id", "left").withColumn("E", F.col("first").isNull())
    nameless = own.where("doc_id IS NULL").withColumns({"E": F.lit(False), "quality": F.lit(False), "toxic": F.lit(False)})
    columns = ["part", *"ABCDE", "quality", "toxic"]
    return both.select(columns).unionByName(nameless.select(columns))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
l AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        (len(words) < 100)::int + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::int
        + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::int + 8 * regexp_matches(t, '[#$%&*|]')::int
        + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::int AS fails
    FROM w LEFT JOIN l USING (doc_id)
),
g AS (SELECT part, fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
letters(name, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
    SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
),
steps AS (SELECT filter_order, s::int AS step, bits[s] AS bit, coalesce(list_sum(bits[1:s - 1]), 0)::int AS earlier FROM orders, range(1, 6) AS r(s)),
counts AS (
    SELECT part, filter_order, step, bit,
        coalesce(sum(n) FILTER (WHERE fails & (earlier | bit) = 0), 0)::bigint AS kept,
        coalesce(sum(n) FILTER (WHERE fails & earlier = 0 AND fails & bit > 0), 0)::bigint AS removed,
        coalesce(sum(n) FILTER (WHERE fails & earlier > 0 AND fails & bit > 0), 0)::bigint AS redundant,
        coalesce(sum(n) FILTER (WHERE fails = bit), 0)::bigint AS unique_fails,
        coalesce(sum(n) FILTER (WHERE fails & earlier = 0 AND fails & bit > 0 AND good), 0)::bigint AS good_lost,
        coalesce(sum(n) FILTER (WHERE fails & earlier = 0 AND fails & bit > 0 AND toxic), 0)::bigint AS toxic_lost
    FROM g, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, bit)::bigint AS shapley
FROM counts
"""

"""A mix of sources at target weights: which words of which documents each output shard takes.

The documents of a source, in the order of a hash, are one line of words, cut into blocks of ``block_words`` (the last one
may be shorter). A source's target says how many of its words the mix takes; whole passes over the line come first, then a
part of one. A pass takes the blocks in the order of a permutation of its own, the last block of the line at its end, and
stops at the very word at which its target is reached. So a source's quota is a number of blocks, in the order of its
passes, and no word is taken more often than there are passes.

Output shards are the leaves of a tree. At each node the blocks of all sources that fall to it are split between its
halves by a multivariate hypergeometric draw, as if all blocks were shuffled and dealt out; a shard so gets exact
numbers of blocks of each source, and what falls to the shards before it says where in each source's order its blocks
begin. So shards draw disjoint runs without knowing of each other: a task computes the tree only above its own shards,
with a seed for each node. Blocks in a shard are shuffled there.

Which documents a block holds follows from running sums of words, found by ranges, so a source may be of any size;
blocks, not sources, are what draws and documents are joined on. Only the sources themselves, a row each and
``MOST_SOURCES`` at most (an error tells of more), reach the driver and are broadcast.

Targets: the mix has ``share`` of all words, dealt to the sources by weight; a source stops at ``passes`` times its words,
and what is over goes to the others by weight until none is above.

Defined results: sizes are maximal runs of other than ASCII white space; null and empty texts have no words and nothing
is taken of them. Sources are in code point order, null last. Rows that repeat an id stand for themselves; of rows equal
in id and text, which share an order, each has the result of one of them. Without words all targets are 0. Reruns and
other partitionings give the same mix, other seeds others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import stored
from corpusloom.llm.running import running

MOST_SOURCES = 100_000
#: Words of a block at least, blocks that are drawn at most (NumPy's draws need fewer than 1e9), blocks of a shard.
BLOCK_WORDS, MOST_BLOCKS, SHARD_BLOCKS = 512, 500_000_000, 4096


def n_words(text: Column) -> Column:
    """Maximal runs of other than ASCII white space."""
    return F.coalesce(F.size(F.array_remove(F.split(text.cast("string"), r"[\x20\x09-\x0D]+"), "")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, passes: int = 2) -> list[float]:
    """Words to take of each source; weights repeat."""
    out, left = [0.0] * len(sizes), share * sum(sizes)
    if left > passes * sum(sizes):
        raise ValueError(f"{share} of all words can't be had in {passes} passes")
    open_ = [i for i, n in enumerate(sizes) if n]
    weight = lambda i: weights[i % len(weights)]
    while open_:
        unit = left / sum(map(weight, open_))
        over = [i for i in open_ if unit * weight(i) > passes * sizes[i]]
        if not over:
            return [unit * weight(i) if i in {*open_} else t for i, t in enumerate(out)]
        for i in over:
            out[i] = float(passes * sizes[i])
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if not out[i]]
    return out


@dataclass(frozen=True)
class Plan:
    """What each source gives. ``quota``: blocks of each pass, by source; all are small arrays."""

    names: list[str | None]
    sizes: np.ndarray
    targets: np.ndarray
    block: int
    seed: int
    shards: int
    words: np.ndarray = field(repr=False)  # [pass, source]
    quota: np.ndarray = field(repr=False)  # [pass, source]


def plan(names: list[str | None], sizes: list[int], weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, passes: int = 2, block_words: int | None = None, shard_blocks: int = SHARD_BLOCKS, seed: int = 12) -> Plan:
    """``block_words``: by default the smallest of BLOCK_WORDS, doubled, with which MOST_BLOCKS suffice."""
    goal = np.array(targets(sizes, weights, share, passes), float)
    size = np.array(sizes, np.int64)
    take = np.minimum(np.rint(goal).astype(np.int64), passes * size)
    words = np.array([np.clip(take - p * size, 0, size) for p in range(passes)])
    block = block_words or BLOCK_WORDS
    while not block_words and int((-(-words // block)).sum()) > MOST_BLOCKS:
        block *= 2
    quota = -(-words // block)
    if quota.sum() >= 1_000_000_000:
        raise ValueError(f"{quota.sum()} blocks are drawn; take larger ones")
    return Plan(names, size, goal, block, seed, -(-int(quota.sum()) // shard_blocks), words, quota)


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def permuted(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Where a permutation of range(n) sends x: a Feistel network over the next power of four, walked until it is inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def through(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in range(4):
            left, right = right, left ^ (mixed(right, seed * 4 + k) & mask)
        return left << np.uint64(half) | right

    out = through(x.astype(np.uint64))
    while (outside := out >= n).any():
        out[outside] = through(out[outside])
    return out.astype(np.int64)


def seed_of(p: Plan, *path: int) -> int:
    return int(np.random.SeedSequence([p.seed, *path]).generate_state(1)[0])


def quotas(p: Plan, low: int, high: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, blocks of each source, blocks of each source in the shards before) of the shards from low to high."""
    total = p.quota.sum(axis=0)
    blocks = int(total.sum())

    def split(a: int, b: int, own: np.ndarray, before: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if b <= low or a >= high:
            return
        if b - a == 1:
            yield a, own, before
            return
        mid = (a + b) // 2
        left = np.random.default_rng([p.seed, a, b]).multivariate_hypergeometric(own, mid * blocks // p.shards - a * blocks // p.shards, method="marginals")
        yield from split(a, mid, left, before)
        yield from split(mid, b, own - left, before + left)

    if p.shards:
        yield from split(0, p.shards, total, np.zeros_like(total))


def drawn(p: Plan, low: int, high: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Of each shard from low to high: shard, place in it, source, pass, block and words of it that are taken."""
    for shard, own, before in quotas(p, low, high):
        source = np.repeat(np.arange(len(own)), own)
        at = np.arange(len(source)) - np.repeat(np.cumsum(own) - own, own) + before[source]  # in the source's order
        turn, block, words = np.zeros(len(at), np.int64), np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        for t in range(1, len(p.quota)):
            turn += at >= p.quota[:t].sum(axis=0)[source]
        within = at - np.concatenate([np.zeros((1, len(own)), np.int64), np.cumsum(p.quota, axis=0)])[turn, source]
        words[:] = np.minimum((within + 1) * p.block, p.words[turn, source]) - within * p.block
        for s in np.flatnonzero(own):
            whole = int(p.sizes[s]) // p.block  # the shorter block at the end of the line comes last
            for t in range(len(p.quota)):
                here = np.flatnonzero((source == s) & (turn == t))
                inside = here[within[here] < whole]
                block[here] = whole
                if len(inside):
                    block[inside] = permuted(within[inside], whole, seed_of(p, 1, s, t))
        place = np.random.default_rng([p.seed, 2, shard]).permutation(len(at))
        yield np.full(len(at), shard), place, source, turn, block, words


DRAWS = ("shard", "place", "number", "turn", "block", "words")


def draws(spark, p: Plan) -> DataFrame:
    """(shard, place, number, turn, block, words): every block that a shard takes, by tasks that work on some shards each."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shards = batch.column(0).to_numpy()
            if len(shards):
                for columns in drawn(p, int(shards.min()), int(shards.max()) + 1):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=DRAWS)

    # shards of a task follow each other, so that they share the upper part of the tree
    tasks = min(max(p.shards, 1), max(spark.sparkContext.defaultParallelism, -(-p.shards // 16)))
    return spark.range(0, p.shards, 1, tasks).mapInArrow(rows, ", ".join(f"{c} bigint" for c in DRAWS))


@dataclass(frozen=True)
class Mix:
    """``rows``: (doc_id, h, number, size, before) of every document, before: words of its source that stand before it.
    ``sources``: (number, source, source_size, target)."""

    plan: Plan
    rows: DataFrame
    sources: DataFrame


def prepare(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> Mix:
    spark = df.sparkSession
    t = F.col(text).cast("string")
    sized = stored(df.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(doc_id), t).alias("h"), F.col(source).cast("string").alias("source"), n_words(t).alias("size")), "sized")
    found = sized.groupBy("source").agg(F.sum("size").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    p = plan([r["source"] for r in found], [r["n"] for r in found], **how)
    known = [(i, r["source"], r["n"], float(p.targets[i])) for i, r in enumerate(found)]
    sources = spark.createDataFrame(known, "number int, source string, source_size bigint, target double")
    numbered = sized.join(F.broadcast(sources.select("number", F.col("source").alias("_s"))), F.col("source").eqNullSafe(F.col("_s"))).select("doc_id", "h", "number", "size")
    return Mix(p, running(numbered, "number", ["h", "doc_id", "size"], "size"), sources)


def pieces(mix: Mix) -> DataFrame:
    """(doc_id, h, number, size, before, shard, place, turn, begin, end): the words [begin, end) of a document that a shard
    takes at a place, for every place that takes some; pieces of one place are in the order of before."""
    b = F.lit(mix.plan.block)
    cut = mix.rows.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("before") / b), F.floor((F.col("before") + F.col("size") - 1) / b))))
    first = F.col("block") * b
    begin, end = F.greatest(first - F.col("before"), F.lit(0)), F.least(first + F.col("words") - F.col("before"), F.col("size"))
    # a range of shards looks small to the planner, but the draws grow with the input: they are never broadcast
    joined = cut.join(draws(mix.rows.sparkSession, mix.plan).hint("merge"), ["number", "block"])
    return joined.select("doc_id", "h", "number", "size", "before", "shard", "place", "turn", begin.alias("begin"), end.alias("end")).where("begin < end")


def taken(mix: Mix) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document."""
    # a document with words is told from others by where it stands in its source
    got = pieces(mix).groupBy("number", "before", "size").agg(F.sum(F.col("end") - F.col("begin")).alias("taken"))
    rows = mix.rows.join(got, ["number", "before", "size"], "left")
    return rows.join(F.broadcast(mix.sources), "number").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def shard_texts(df: DataFrame, mix: Mix, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(shard, place, at, doc_id, text): what the shards hold, words set apart by one space, dealt out by shard and in order
    within it; at: the piece's place in its block."""
    t = F.col(text).cast("string")
    texts = df.select(F.col(doc_id).alias("_d"), F.xxhash64(F.col(doc_id), t).alias("_h"), t.alias("_t")).dropDuplicates(["_d", "_h"])
    words = F.array_remove(F.split("_t", r"[\x20\x09-\x0D]+"), "")
    cut = F.array_join(F.slice(words, F.col("begin").cast("int") + 1, (F.col("end") - F.col("begin")).cast("int")), " ")
    joined = pieces(mix).join(texts, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h")))
    return joined.select("shard", "place", F.col("before").alias("at"), "doc_id", cut.alias("text")).repartition("shard").sortWithinPartitions("shard", "place", "at")

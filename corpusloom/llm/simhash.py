"""SimHash near-duplicates, found by a grid over popcounts of a fingerprint's segments.

A text's A-Z are lower-cased; words are runs of characters other than blank and U+0009 to U+000D; every run of three
words, repeats included, is hashed by XXH64 (seed 42) of its words joined by blanks. A text with fewer words is hashed
whole; one without words has fingerprint zero. A bit of the fingerprint is 1 if it is in over half of the hashes.

Two fingerprints link if at most ``DISTANCE`` (3) bits differ. Map a fingerprint to the popcounts of its 32 segments of
two bits: no pair is further apart in Manhattan distance there than in bits. If the whole distance is at most 3, one of
the two halves (16 counts each) is at a distance of at most 1. So each half is a cell of a grid; a fingerprint looks in
its own cell and in those where one count is larger by one (the other fingerprint looks for the smaller ones). What
meets in a cell is verified by its differing bits.

Copies count once: the grid holds each distinct fingerprint with its smallest doc_id. A cell where too many pairs would
meet (a large group of texts that differ a little) is worked on in blocks of bounded size instead, which give back a
spanning forest of their links and not all of them. No link is lost, and no group is gathered anywhere. Components go
back to the rows by a join on the fingerprint; those that over one row in ``RARE`` has are at most RARE in number, and are
broadcast, so that no task gets all copies of a text.

Defined results: a null text counts as an empty one, and texts without words are linked like any others. Rows with a
null doc_id get a fingerprint; they link others only through a row with an id, and their component_id is null if
nothing they equal or link to has an id. Repeated doc_ids are kept. Texts may be of any length and are hashed whole.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import checkpointed, text_udf
from corpusloom.llm.components import components

WORDS = re.compile(rb"[^ \t-\r]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SHINGLE, SEED, DISTANCE = 3, 42, 3
#: A cell in which more pairs than this would meet is worked on in blocks.
HOT_PAIRS = 20_000
#: Fingerprints of a block.
BLOCK = 2048
#: A fingerprint of more than one row in so many isn't shuffled with its rows.
RARE = 1000


def hashes(text: str) -> list[int]:
    words = WORDS.findall(text.encode("utf-8", "surrogatepass").translate(LOWER))
    if not words:
        return []
    h = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return [h(b" ".join(words), SEED)]
    return [h(a + b" " + b + b" " + c, SEED) for a, b, c in zip(words, words[1:], words[2:])]


def fingerprints(texts: list[str | None]) -> np.ndarray:
    """The texts' fingerprints as unsigned 64-bit integers."""
    out = np.zeros(len(texts), np.uint64)
    flat: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if t:
            got = hashes(t)
            flat += got
            counts[i] = len(got)
    full = np.flatnonzero(counts)
    if len(full):
        ends = np.cumsum(counts[full])
        h = np.array(flat, np.uint64)
        ones = np.zeros((len(full), 64), np.int64)
        # 64 bits side by side in each row of bytes; summed in slices, so that long texts need no more memory
        for a in range(0, len(h), 1 << 18):
            part = h[a : a + (1 << 18)]
            bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            owner = np.searchsorted(ends, np.arange(a, a + len(part)), side="right")
            begin = np.flatnonzero(np.diff(owner, prepend=-1))
            ones[owner[begin]] += np.add.reduceat(bits, begin, axis=0, dtype=np.int64)
        out[full] = np.packbits(2 * ones > counts[full][:, None], axis=1).view(">u8").reshape(-1).astype(np.uint64)
    return out


def with_fingerprints(df: DataFrame, text: str = "text", into: str = "fingerprint") -> DataFrame:
    """df with a bigint column that holds the 64 bits."""
    fn = text_udf(lambda texts: pa.array(fingerprints(texts).view(np.int64), pa.int64()), "bigint")
    return df.withColumn(into, fn(F.col(text).cast("string")))


def cells(fp: str = "fp") -> DataFrame:
    """Array of struct(half, counts): the popcounts of 16 segments of two bits, two bits each in a number."""
    halves = []
    for half in (0, 1):
        v = F.expr(f"shiftrightunsigned({fp}, {32 * half}) & 4294967295L")
        ones = v.bitwiseAND(F.lit(0x55555555)) + F.shiftright(v, 1).bitwiseAND(F.lit(0x55555555))
        halves.append(F.struct(F.lit(half).alias("half"), ones.alias("counts")))
    return F.array(*halves)


def spanning(base: np.ndarray, probe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) between fingerprints that join just what the links between base and probe join."""
    tile = 512
    linked = np.zeros((len(probe), len(base)), bool)
    for a in range(0, len(probe), tile):
        linked[a : a + tile] = np.bitwise_count(probe[a : a + tile, None] ^ base[None, :]) <= DISTANCE
    rows, cols = linked.any(axis=1), linked.any(axis=0)
    probe, base, linked = probe[rows], base[cols], linked[np.ix_(rows, cols)]
    if not len(probe):
        return base[:0], base[:0]
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    of_base, of_probe = base.copy(), probe.copy()
    while True:
        # labels run back and forth until none falls
        for a in range(0, len(probe), tile):
            of_probe[a : a + tile] = np.minimum(of_probe[a : a + tile], np.where(linked[a : a + tile], of_base[None, :], none).min(axis=1))
        fell = of_base.copy()
        for a in range(0, len(probe), tile):
            fell = np.minimum(fell, np.where(linked[a : a + tile], of_probe[a : a + tile, None], none).min(axis=0))
        if (fell == of_base).all():
            break
        of_base = fell
    return np.concatenate([base, probe]), np.concatenate([of_base, of_probe])


def links(distinct: DataFrame) -> DataFrame:
    """Links (x, y) between the distinct fingerprints ``fp``; for hot cells a spanning forest of them."""
    base = distinct.select("fp", F.explode(cells()).alias("c")).select("fp", "c.half", "c.counts")
    larger = F.expr("transform(filter(sequence(0, 15), i -> (shiftright(counts, 2 * i) & 3L) < 2), i -> counts + shiftleft(1L, 2 * i))")
    probe = base.select("fp", "half", F.explode(F.concat(F.array("counts"), larger)).alias("cell"), "counts")
    probe = probe.select("fp", "half", "cell", (F.col("cell") == F.col("counts")).alias("own"))
    base = base.withColumnRenamed("counts", "cell")

    sizes = base.groupBy("half", "cell").agg(F.count("*").alias("n"))
    seekers = probe.groupBy("half", "cell").agg(F.count("*").alias("m"))
    hot = checkpointed(sizes.where("n > 1").join(seekers, ["half", "cell"]).where(F.col("n") * F.col("m") > HOT_PAIRS))

    b = base.join(hot.select("half", "cell"), ["half", "cell"], "left_anti").withColumnRenamed("fp", "y")
    p = probe.withColumnRenamed("fp", "x")
    near = F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= DISTANCE
    found = p.join(b, (p["half"] == b["half"]) & (p["cell"] == b["cell"]) & near & (~p["own"] | (p["x"] < b["y"]))).select("x", "y")
    if hot.isEmpty():
        return found

    # a block of the cell's fingerprints meets a block of those that look there
    blocks = hot.select("half", "cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("nb"), F.ceil(F.col("m") / BLOCK).cast("int").alias("mb"))
    deal = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    left = base.join(blocks, ["half", "cell"]).select("half", "cell", deal("nb").alias("i"), F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("j"), "fp", F.lit(True).alias("is_base"))
    right = probe.join(blocks, ["half", "cell"]).select("half", "cell", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("i"), deal("mb").alias("j"), "fp", F.lit(False).alias("is_base"))

    def meet(batches: Iterator[pa.Table] | pa.Table) -> pa.Table:
        t = batches
        fp, is_base = t.column("fp").to_numpy().view(np.uint64), t.column("is_base").to_numpy(zero_copy_only=False).astype(bool)
        x, y = spanning(fp[is_base], fp[~is_base])
        return pa.table({"x": x.view(np.int64), "y": y.view(np.int64)})

    forest = left.unionByName(right).groupBy("half", "cell", "i", "j").applyInArrow(meet, "x bigint, y bigint").where("x <> y")
    return found.unionByName(forest)


def cluster(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint as 16 hexadecimal digits, component_id: the smallest key reachable over links)."""
    rows = checkpointed(with_fingerprints(df.select(F.col(key), F.col(text).alias("text")), "text", "fp").select(key, "fp"))
    distinct = checkpointed(rows.groupBy("fp").agg(F.min(key).alias("least"), F.count("*").alias("n")))
    # nodes are fingerprints; their order is made that of the smallest keys afterwards
    joined = components(links(distinct).select(F.col("x").alias("a"), F.col("y").alias("b")))
    smallest = joined.join(distinct, joined["node"] == distinct["fp"]).groupBy("component").agg(F.min("least").alias("component_id"))
    moved = joined.join(smallest, "component").select(F.col("node").alias("fp"), "component_id")
    named = checkpointed(distinct.join(moved, "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id")))
    most = (named.agg(F.sum("n")).first()[0] or 0) // RARE + 1
    frequent = F.broadcast(named.where(F.col("n") > most).select("fp", "component_id"))
    rare = rows.join(frequent, "fp", "left_anti").join(named.where(F.col("n") <= most), "fp")
    found = rows.join(frequent, "fp").select(key, "fp", "component_id").unionByName(rare.select(key, "fp", "component_id"))
    return found.select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

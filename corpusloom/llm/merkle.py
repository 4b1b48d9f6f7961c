"""A Merkle manifest of a table: a digest of every row, a tree over each source's rows, a tree over the sources, and for
every row the siblings that prove that it belongs to the root.

H is the lowercase hex SHA-256 of its inputs one after the other, digests as hex text. A leaf is H of the row's columns,
each ``-`` if null, else its UTF-8 byte count, ``:`` and the value. While a tree has several nodes, every ``FANOUT``
consecutive ones become their H (the last run may be shorter, of one node even); what remains is the source's subroot.
Subroots, by source, null first and then bytewise, likewise give the root.

The trees are built by Pregel-style supersteps on RDDs. Upward, every node sends its digest to its parent; a parent whose
children have all arrived (it knows how many there are from the number of nodes of its level) hashes them and sends on.
All sources' trees rise together, a superstep a level; a tree that is done waits with its one node. Downward, every node
sends each child the digests left and right of it, level by level, under what came from above; the last ones to get a
message hold up to FANOUT leaves each, so the paths are never copied to single leaves. There the proofs are hashed and
the root is computed anew from each row as it is now.

Nodes are dealt out by source and place, so a source may be of any size; a task gets at most FANOUT children for a node.
Where a row stands in its source comes from running sums over ranges. Digests are 32 bytes on their way. Lineage begins
at the stored leaves and has two shuffles a level, so lost executors cost what they held. A row's siblings are some
480 bytes a level, for which memory a task has once for each run and not for each row.

Defined results: null ids come first in their source. Of rows with equal ids the one with the smaller leaf comes first;
rows that are equal in all stand side by side, and each has the proof of one of them. Equal leaves of different places
have different proofs. An empty table has no rows. Columns that aren't among those hashed are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import stored
from corpusloom.llm.running import running

FANOUT = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes of a level that a task is dealt at least.
TASK_NODES = 16_384
TOP = -1
PROVEN = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

#: Siblings of a node at one level, left and right of it, digests end to end; None where a tree waits with its one node.
Level = tuple[bytes, bytes] | None


def leaf(columns: list[Column]) -> Column:
    """H of the values, as 32 bytes."""
    text = [c.cast("string") for c in columns]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256))


def h(digests: bytes) -> bytes:
    return hashlib.sha256(digests.hex().encode()).digest()


def spread(key: tuple[int, int]) -> int:
    """A hash of (tree, place) by which nodes are dealt out."""
    x = (key[0] * 0x9E3779B97F4A7C15 + key[1] * 0xC2B2AE3D27D4EB4F) & 0xFFFFFFFFFFFFFFFF
    return (x ^ x >> 31) * 0xD6E8FEB86659FD93 >> 17 & 0x7FFFFFFF


def levels_of(nodes: int) -> int:
    """Levels above the lowest that a tree over so many nodes has, one at least."""
    n = 1
    while nodes > FANOUT:
        nodes, n = -(-nodes // FANOUT), n + 1
    return n


def to_parent(node: tuple) -> tuple:
    (tree, place), (of, digest, payload) = node
    return (tree, place // FANOUT), (place % FANOUT, of, digest, payload)


def arrived(children) -> list[tuple]:
    """A parent's children in order; all must be there, and their level says how many that are."""
    found = sorted(children, key=lambda c: c[0])
    if [c[0] for c in found] != list(range(len(found))):
        raise RuntimeError("a node is missing, or two have one place")
    return found


def hashed(run: tuple) -> tuple:
    (tree, place), children = run
    of = children[0][1]
    if len(children) != min(FANOUT, of - place * FANOUT):
        raise RuntimeError(f"{len(children)} of {min(FANOUT, of - place * FANOUT)} children have arrived")
    return (tree, place), (-(-of // FANOUT), h(b"".join(c[2] for c in children)) if of > 1 else children[0][2], None)


def upward(nodes: RDD, most: int, total: int, least: int) -> tuple[list[RDD], RDD]:
    """nodes: ((tree, place), (nodes of its level, digest, payload)); most: nodes of the largest tree, total: of all.
    Returns the runs of children of every level, ((tree, place of the parent), children), and the tops."""
    levels = []
    for _ in range(levels_of(most)):
        total = max(1, total // FANOUT)
        runs = nodes.map(to_parent).groupByKey(max(least if not levels else 1, -(-total // TASK_NODES)), spread).mapValues(arrived)
        levels.append(runs)
        nodes = runs.map(hashed)
    return levels, nodes


def siblings(children: list[tuple]) -> Iterator[tuple[tuple, Level]]:
    for i, c in enumerate(children):
        yield c, (b"".join(x[2] for x in children[:i]), b"".join(x[2] for x in children[i + 1 :])) if c[1] > 1 else None


def downward(levels: list[RDD], tops: RDD, last: Callable) -> RDD:
    """tops: ((tree, 0), what comes from above: (known digests, levels from the lowest up)). ``last`` makes rows of the
    lowest runs, (run, (children, what comes from above))."""

    def on(item: tuple) -> Iterator[tuple]:
        (tree, place), (children, (known, above)) = item
        for c, own in siblings(children):
            yield (tree, place * FANOUT + c[0]), (known, (own, *above))

    for runs in reversed(levels[1:]):
        tops = joined(runs, tops).flatMap(on)
    return joined(levels[0], tops).flatMap(last)


def joined(runs: RDD, messages: RDD) -> RDD:
    """Every run with the one message for it: (children, message). Runs stay where they are."""
    n = runs.getNumPartitions()
    both = runs.mapValues(lambda children: (0, children)).union(messages.partitionBy(n, spread).mapValues(lambda message: (1, message)))
    return both.groupByKey(n, spread).mapValues(lambda found: tuple(v for _, v in sorted(found, key=lambda x: x[0])))


def climb(digest: bytes, levels: tuple[Level, ...]) -> bytes:
    for level in levels:
        if level is not None:
            digest = h(level[0] + digest + level[1])
    return digest


def proofs(item: tuple) -> Iterator[tuple]:
    """The rows of a run: payload is (id, leaf of the row as it is now)."""
    _, (children, ((subroot, root), above)) = item
    upper = b"".join(x for level in above if level for x in level)
    for (_, _, digest, (doc_id, now)), own in siblings(children):
        folded = climb(now, (own, *above))
        yield doc_id, digest.hex(), subroot.hex(), root.hex(), h(b"".join(own or ()) + upper).hex(), folded.hex(), folded == root


def prove(leaves: DataFrame) -> DataFrame:
    """PROVEN columns of leaves (doc_id, source, leaf, now): now is the leaf of the row as it is found today."""
    spark = leaves.sparkSession
    leaves = stored(leaves, "leaves")
    counts = leaves.groupBy("source").agg(F.count("*").alias("of")).withColumns({"one": F.lit(1).cast("long"), "all": F.lit(0)})
    sources = running(counts, "all", ["source"], "one", into="tree").select(F.col("source").alias("_s"), "of", "tree")
    n_sources, most, total = sources.agg(F.count("*"), F.coalesce(F.max("of"), F.lit(0)), F.coalesce(F.sum("of"), F.lit(0))).first()
    if not total:
        return spark.createDataFrame([], PROVEN)
    numbered = leaves.join(sources, F.col("source").eqNullSafe(F.col("_s"))).select("tree", "of", "doc_id", "leaf", "now", F.lit(1).cast("long").alias("one"))
    placed = running(numbered, "tree", ["doc_id", "leaf"], "one", into="place").select("tree", "place", "of", "leaf", "doc_id", "now")
    nodes = placed.rdd.map(lambda r: ((r[0], r[1]), (r[2], bytes(r[3]), (r[4], bytes(r[5])))))
    least = spark.sparkContext.defaultParallelism
    levels, subroots = upward(nodes, most, total, least)
    top_levels, root = upward(subroots.map(lambda x: ((TOP, x[0][0]), (n_sources, x[1][1], None))), n_sources, n_sources, 1)

    def to_source(item: tuple) -> Iterator[tuple]:
        (_, place), (children, (top, above)) = item
        for c, own in siblings(children):
            yield (place * FANOUT + c[0], 0), ((c[2], top), (own, *above))

    from_top = downward(top_levels, root.map(lambda x: (x[0], (x[1][1], ()))), to_source)
    return spark.createDataFrame(downward(levels, from_top, proofs), PROVEN, verifySchema=False)


#: The letters that tampering in the query changes.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def document_leaves(docs: DataFrame) -> DataFrame:
    """The leaves of all documents; of those with an id whose CRC-32 5 divides, A to Z in the text are now lower-cased."""
    original = leaf([F.col(c) for c in COLUMNS])
    tampered = leaf([F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in COLUMNS])
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), original.alias("leaf"), F.when(changed, tampered).alias("now"))
    return found.withColumn("now", F.coalesce("now", "leaf"))


def oracle_sql(levels: int = 6, top_levels: int = 3) -> str:
    """The same rows in SQL, for at most 16 ** levels rows a source and 16 ** top_levels sources."""
    value = lambda c: f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"
    row = lambda text: "sha256(" + " || ".join(value(text if c == "text" else c) for c in COLUMNS) + ")"
    parts = [
        f"d AS (SELECT doc_id, source, {row('text')} AS leaf, {row(f"translate(text, '{UPPER}', '{LOWER}')")} AS changed FROM documents)",
        "n0 AS (SELECT dense_rank() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS size, doc_id, leaf AS digest, "
        "CASE WHEN crc32_is_fifth THEN changed ELSE leaf END AS now FROM (SELECT *, coalesce(doc_id IN (SELECT doc_id FROM fifth), false) AS crc32_is_fifth FROM d))",
    ]
    # CRC-32 of decimal ids: a table of bytes, then a step for each digit
    parts[:0] = [
        "crc_bits(byte, word, n) AS (SELECT i::bigint, i::bigint, 0 FROM range(256) AS r(i) UNION ALL SELECT byte, CASE WHEN word & 1 = 1 THEN xor(word >> 1, 3988292384) ELSE word >> 1 END, n + 1 FROM crc_bits WHERE n < 8)",
        "crc_table AS (SELECT byte, word FROM crc_bits WHERE n = 8)",
        "crc(doc_id, digits, n, value) AS (SELECT DISTINCT doc_id, doc_id::varchar, 0, 4294967295::bigint FROM documents WHERE doc_id IS NOT NULL UNION ALL "
        "SELECT doc_id, digits, n + 1, xor(value >> 8, word) FROM crc JOIN crc_table ON byte = xor(value & 255, ascii(digits[n + 1])::bigint) WHERE n < length(digits))",
        "fifth AS (SELECT doc_id FROM crc WHERE n = length(digits) AND xor(value, 4294967295) % 5 = 0)",
    ]

    def rise(name: str, n: int) -> None:
        for k in range(n):
            parts.append(f"{name}runs{k} AS (SELECT tree, place // 16 AS place, any_value(size) AS size, list(digest ORDER BY place) AS run FROM {name}{k} GROUP BY tree, place // 16)")
            parts.append(f"{name}{k + 1} AS (SELECT tree, place, (size + 15) // 16 AS size, CASE WHEN size > 1 THEN sha256(array_to_string(run, '')) ELSE run[1] END AS digest FROM {name}runs{k})")

    rise("n", levels)
    parts.append(f"t0 AS (SELECT 0 AS tree, tree AS place, count(*) OVER () AS size, digest FROM n{levels})")
    rise("t", top_levels)
    parts.append("f0 AS (SELECT tree, place, doc_id, digest AS leaf, now AS folded, '' AS proof FROM n0)")

    def fold(source: str, target: str, runs: str, more: str = "") -> None:
        inner = f"(SELECT f.*, r.run, r.size, (f.place % 16)::int AS spot FROM {source} f JOIN {runs} r ON r.tree = f.tree AND r.place = f.place // 16)"
        around = "array_to_string(list_concat(list_concat(run[1:spot], {0}), run[spot + 2:]), '')"
        parts.append(
            f"{target} AS (SELECT tree, place // 16 AS place, doc_id, leaf, CASE WHEN size > 1 THEN sha256({around.format('[folded]')}) ELSE folded END AS folded, "
            f"CASE WHEN size > 1 THEN proof || {around.format('[]::varchar[]')} ELSE proof END AS proof{more} FROM {inner})"
        )

    for k in range(levels):
        fold(f"f{k}", f"f{k + 1}", f"nruns{k}")
    parts.append(f"g0 AS (SELECT 0 AS tree, f.tree AS place, doc_id, leaf, folded, proof, n.digest AS subroot FROM f{levels} f JOIN n{levels} n ON n.tree = f.tree)")
    for k in range(top_levels):
        fold(f"g{k}", f"g{k + 1}", f"truns{k}", ", subroot")
    body = ",\n".join(parts)
    return f"WITH RECURSIVE {body}\nSELECT doc_id, leaf, subroot, t.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = t.digest AS verified FROM g{top_levels}, t{top_levels} t"

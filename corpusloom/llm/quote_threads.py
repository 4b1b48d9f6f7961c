"""Quotation linking: replies find the messages that they quote.

A line's quote level is the number of > marks it begins with. Lines of one level in a row are a block, cut into
paragraphs at blank lines. Every paragraph and every line, lower-cased and with its white space squeezed, is hashed.
What a message wrote itself (level 0) is an original; the first message of a conversation to write it owns it. Quoted
passages (level 1 and up) are joined to the owners of equal originals, if those are earlier in the conversation.

A message replies to the owner of a passage quoted at its lowest linked level; of several, to the latest. Replies are
followed up to the message that replies to nothing, the root of its thread. In the order (conversation, root, turn)
every message follows the one that it replies to: ``position`` numbers a thread's messages in that order, and
``conversations`` builds the threads from it, a message's text being what it wrote itself, without quotes and without
the line that announces one.

A conversation may hold any share of all messages: only equal (conversation, hash) and (conversation, turn) meet, each
with one owner on one side, and nothing gathers a conversation. Messages are numbered by ranges of the order, each range
by itself, and from the ranges' counts; a built thread is cut into parts of a bounded number of messages.

Defined results: null and empty texts quote nothing and have an empty text. Rows with a null conversation or turn, and
rows that quote no known passage, reply to nothing and are their own root; without a turn a row is in the thread of null,
without a conversation in one of the conversation null. Rows that repeat (conversation, turn) are kept, count as one
message when it is linked, and follow each other in the order of their texts' hashes. Texts may be of any length; one is
parsed whole. Other columns pass through untouched, whatever their names; a column of the name ``into`` is replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import checkpointed, stored, text_udf, unused

MARKS = re.compile(r"[ \t]*((?:>[ \t]?)+)")
#: A line that announces a quote, in the languages of the tables.
ANNOUNCES = re.compile(r"(?:on\b.*\bwrote|am\b.*\bschrieb.*|le\b.*\ba écrit|el\b.*\bescribió)\s*:", re.I)


def levels(text: str) -> Iterator[tuple[int, list[str]]]:
    """(quote level, lines without marks) of each block."""

    def cut(line: str) -> tuple[int, str]:
        m = MARKS.match(line)
        return (m[1].count(">"), line[m.end() :]) if m else (0, line)

    for level, lines in groupby(map(cut, text.split("\n")), key=lambda x: x[0]):
        yield level, [line for _, line in lines]


def keys(lines: list[str]) -> list[bytes]:
    """Hashes of the paragraphs and lines, in order, each once."""
    squeezed = [" ".join(x.lower().split()) for x in lines]
    paragraphs = [" ".join(x) for full, x in groupby(squeezed, key=bool) if full]
    return list(dict.fromkeys(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=16).digest() for x in [*paragraphs, *squeezed] if x))


def parse(text: str | None) -> tuple[str, list[bytes], list[tuple[int, bytes]]]:
    """(own text, hashes of what it holds, (level, hash) of what is quoted)."""
    if not text:
        return "", [], []
    blocks = list(levels(text))
    own: list[str] = []
    originals: list[bytes] = []
    quoted: list[tuple[int, bytes]] = []
    for i, (level, lines) in enumerate(blocks):
        if level:
            quoted += [(level, k) for k in keys(lines)]
            continue
        if i + 1 < len(blocks):
            said = [n for n, x in enumerate(lines) if x.strip()]
            if said and ANNOUNCES.fullmatch(lines[said[-1]].strip()):
                lines = lines[: said[-1]]
        originals += keys(lines)
        own.append("\n".join(lines).strip("\n"))
    return "\n".join(x for x in own if x), list(dict.fromkeys(originals)), list(dict.fromkeys(quoted))


PARSED = "struct<own:string,originals:array<binary>,quoted:array<struct<level:int,hash:binary>>>"
KIND = pa.struct([("own", pa.string()), ("originals", pa.list_(pa.binary())), ("quoted", pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.binary())])))])


def parser():
    """Text column to PARSED."""

    def run(texts: list[str | None]) -> pa.Array:
        rows = map(parse, texts)
        return pa.array([{"own": a, "originals": b, "quoted": [{"level": n, "hash": h} for n, h in c]} for a, b, c in rows], KIND)

    return text_udf(run, PARSED)


def links(parsed: DataFrame) -> DataFrame:
    """(c, t, level, hash, owner) for every quoted passage of (c, t, p) with an earlier owner."""
    known = parsed.where("c IS NOT NULL AND t IS NOT NULL")
    quoted = known.select("c", "t", F.explode("p.quoted").alias("q")).select("c", "t", "q.level", "q.hash").distinct()
    wanted = quoted.select("c", "hash").distinct()
    owners = known.select("c", "t", F.explode("p.originals").alias("hash")).groupBy("c", "hash").agg(F.min("t").alias("owner")).join(wanted, ["c", "hash"], "left_semi")
    return quoted.join(owners, ["c", "hash"]).where("owner < t").select("c", "t", "level", "hash", "owner")


def roots(parents: DataFrame) -> DataFrame:
    """(c, t, parent, root, depth) from (c, t, parent): every round doubles the length of way that is known."""
    ways = checkpointed(parents.select("c", "t", "parent", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth")))
    while True:
        further = ways.select("c", F.col("t").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        longer = checkpointed(ways.join(further, ["c", "root"], "left"))
        if longer.where("next IS NOT NULL").isEmpty():
            return ways
        ways = longer.select("c", "t", "parent", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))


def numbered(rows: DataFrame, thread: list[str], order: list[str], into: str) -> DataFrame:
    """rows with their number, from 0, in their thread. A range of the order numbers its own rows; what a thread has in the
    ranges before is summed up from their counts, of which a thread has no more than there are ranges."""
    place, at = unused("_range", rows), unused("_at", rows)
    ranges = rows.repartitionByRange(*thread, *order).sortWithinPartitions(*thread, *order)
    dealt = checkpointed(ranges.withColumn(place, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id()))
    counts = dealt.groupBy(*thread, place).agg(F.count("*").alias("_n"), F.min(at).alias("_first"))
    before = counts.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(thread)], F.col(place).alias("_place"), "_first", F.coalesce(F.sum("_n").over(Window.partitionBy(*thread).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    same = F.col(place) == F.col("_place")
    for i, c in enumerate(thread):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return dealt.join(before, same).withColumn(into, F.col("_before") + F.col(at) - F.col("_first")).select(*rows.columns, into)


def thread(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", text: str = "text", into: str = "reply") -> DataFrame:
    """messages with a struct column: text without quotes, parent and root turn, replies up to the root, position in the
    thread, quoted and linked passages."""
    kept = [c for c in messages.columns if c != into]
    # texts are parsed once; all columns of the caller's go along in one struct, so no name can clash
    whole = messages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(conversation).alias("c"), F.col(turn).alias("t"), parser()(F.col(text).cast("string")).alias("p"))
    parsed = stored(whole.withColumn("id", F.monotonically_increasing_id()), "messages")
    found = checkpointed(links(parsed))
    parents = found.groupBy("c", "t").agg(F.max_by("owner", F.struct(-F.col("level"), F.col("owner"))).alias("parent"), F.count("*").alias("n_linked"))
    known = roots(parents.select("c", "t", "parent")).join(parents.select("c", "t", "n_linked"), ["c", "t"])
    slim = parsed.select("id", "c", "t", F.xxhash64("p.own").alias("tie")).join(known, ["c", "t"], "left").withColumn("root", F.coalesce("root", "t"))
    placed = numbered(slim, ["c", "root"], ["t", "tie", "id"], "position").drop("c", "t", "tie")
    reply = F.struct(
        F.col("p.own").alias("own_text"),
        F.col("parent").alias("parent_turn"),
        F.col("root").alias("root_turn"),
        F.coalesce("depth", F.lit(0).cast("long")).alias("depth"),
        "position",
        F.size("p.quoted").cast("long").alias("n_quoted"),
        F.coalesce("n_linked", F.lit(0).cast("long")).alias("n_linked"),
    )
    return parsed.join(placed, "id").select(*[F.col("row")[c].alias(c) for c in kept], reply.alias(into))


def conversations(threaded: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", reply: str = "reply", most: int = 1000) -> DataFrame:
    """A row for each thread of ``thread``'s result: (conversation, root_turn, part, messages), the messages (position, turn,
    parent_turn, role, text) in reply order and without quotes. A thread of more than ``most`` messages goes on in further
    parts, so that no group is larger."""
    r = F.col(reply)
    message = F.struct(r["position"].alias("position"), F.col(turn).alias("turn"), r["parent_turn"].alias("parent_turn"), F.col(role).alias("role"), r["own_text"].alias("text"))
    rows = threaded.select(F.col(conversation).alias("conversation"), r["root_turn"].alias("root_turn"), F.floor(r["position"] / most).alias("part"), message.alias("m"))
    return rows.groupBy("conversation", "root_turn", "part").agg(F.array_sort(F.collect_list("m")).alias("messages"))


def reply_ordered(threaded: DataFrame, conversation: str = "conv_id", turn: str = "turn", reply: str = "reply") -> DataFrame:
    """Messages in the order in which every one follows what it replies to, for writing them out in it."""
    return threaded.orderBy(conversation, F.col(reply)["root_turn"], F.col(reply)["position"])

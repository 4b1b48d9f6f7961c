"""Token ids in directly addressable codes, written to and read from files of their own format.

A segment's ids are split into chunks of eight bits. Level 0 has the lowest chunk of every id, and a bitmap that says
which ids continue; level 1 has the next chunk of those, and so on. A rank directory (ones before every 512 bits)
turns a position in one level into the position in the next, so that any id is read with one look at each level it has
and without decoding anything else.

A segment is a file, little-endian: "DAC2", u32 part, u32 number in the part, u64 ids of the part before it, u64 ids n,
u64 documents d, u64 documents without a key (they come first), u8 levels; u64 chunks of each level; d keys (i64, 0 for
none); d ends (u64: ids of the segment's documents up to and with this one); then for each level its chunks, and, but for
the last level, ceil(chunks / 512) * 64 bytes of bitmap (least significant bit first) and ceil(chunks / 512) u32 of rank
directory. All places follow from the header, so ``token_at`` reads an id of a stored file with one byte, one block of
bitmap and one rank for each level. A segment holds fewer than 2**32 ids. A file ends with one byte of line end, which is
Spark's and no part of the format. A file's folder is named after the segment's part, number, ids before and ids, so
segments are found without opening any.

Documents are dealt out by ranges of their id (ties by a hash of the text), so segments follow each other in ascending
order, in the folder that all executors share. What a document's ids are preceded by is known from the sums of the
partitions before its own, which are the only thing that reaches the driver.

Defined results: a null text is encoded as an empty one, which leaves the end id only. Rows with a null id come first.
Repeated ids are kept, in an order given by the text's hash. Texts may be of any length: they are worked on in windows
that end at white space. A document is never cut, so a segment has at least one document and ends with the first that
fills it. Columns other than key and text are left out.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import arrow_slices, shared_dir
from corpusloom.llm.part_cache import ByteCache

MAGIC = b"DAC2"
BITS_PER_RANK = 512
BLOCK = BITS_PER_RANK // 8
HEAD = struct.Struct("<4sIIQQQQB")
#: Ids of a segment, about. A task needs some 40 bytes for each.
SEGMENT_IDS = 1 << 21
#: Distinct parts that a task keeps the ids of.
CACHED_PARTS = 1_500_000
#: Bytes of text that are cut into parts at once, and parts that are looked up at once.
WINDOW, LOOKED_UP = 4 << 20, 400_000


def encode(ids: np.ndarray, keys: list[int | None] | None = None, ends: np.ndarray | None = None, part: int = 0, number: int = 0, before: int = 0) -> bytes:
    """A segment of unsigned ids; by default of one document without a key."""
    keys = [None] if keys is None else keys
    ends = np.array([len(ids)]) if ends is None else ends
    rest = ids.astype(np.uint32 if not len(ids) or int(ids.max()) < 1 << 32 else np.uint64)
    sizes, levels = [], []
    while True:
        more = rest > 255
        sizes.append(len(rest))
        levels.append(rest.astype(np.uint8).tobytes())  # the lowest eight bits
        if not more.any():
            break
        bitmap = np.zeros(-(-len(rest) // BITS_PER_RANK) * BLOCK, np.uint8)
        packed = np.packbits(more, bitorder="little")
        bitmap[: len(packed)] = packed
        ones = np.bitwise_count(bitmap).reshape(-1, BLOCK).sum(axis=1, dtype=np.int64)
        levels += [bitmap.tobytes(), (np.cumsum(ones) - ones).astype("<u4").tobytes()]
        rest = rest[more] >> rest.dtype.type(8)
    nulls = sum(k is None for k in keys)
    head = HEAD.pack(MAGIC, part, number, before, len(ids), len(keys), nulls, len(sizes)) + struct.pack(f"<{len(sizes)}Q", *sizes)
    return b"".join([head, np.array([k or 0 for k in keys], "<i8").tobytes(), ends.astype("<u8").tobytes(), *levels])


class Segment:
    """Reads a segment by ``read(place, bytes)``, or without copying it if it is in memory."""

    def __init__(self, data: bytes | Callable[[int, int], bytes]):
        self.read = data if callable(data) else lambda at, n: memoryview(data)[at : at + n]
        head = self.read(0, HEAD.size)
        if bytes(head[:4]) != MAGIC:
            raise ValueError("no segment")
        _, self.part, self.number, self.before, self.n, self.documents, self.nulls, count = HEAD.unpack(head)
        self.sizes = struct.unpack(f"<{count}Q", self.read(HEAD.size, 8 * count))
        self.keys_at = HEAD.size + 8 * count
        self.places, at = [], self.keys_at + 16 * self.documents
        for n in self.sizes:
            blocks = -(-n // BITS_PER_RANK)
            self.places.append((at, at + n, at + n + blocks * BLOCK))
            at += n + blocks * (BLOCK + 4)

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        """The id at a position, from one chunk of each level that it has."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for level, (chunks, bitmap, ranks) in enumerate(self.places):
            value |= self.read(chunks + i, 1)[0] << shift
            if level + 1 == len(self.places):
                break
            block, bit = divmod(i, BITS_PER_RANK)
            bits = int.from_bytes(self.read(bitmap + block * BLOCK, BLOCK), "little")
            if not bits >> bit & 1:
                break
            i = int.from_bytes(self.read(ranks + 4 * block, 4), "little") + (bits & ((1 << bit) - 1)).bit_count()
            shift += 8
        return value

    def keys(self) -> list[int | None]:
        """The keys of the documents."""
        known = np.frombuffer(self.read(self.keys_at, 8 * self.documents), "<i8")
        return [None] * self.nulls + known[self.nulls :].tolist()

    def ends(self) -> np.ndarray:
        return np.frombuffer(self.read(self.keys_at + 8 * self.documents, 8 * self.documents), "<u8").astype(np.int64)

    def all(self) -> np.ndarray:
        """All ids."""
        kind = np.uint32 if len(self.sizes) <= 4 else np.uint64
        value = np.zeros(0, kind)
        for level in reversed(range(len(self.sizes))):
            n, (chunks, bitmap, ranks) = self.sizes[level], self.places[level]
            here = np.frombuffer(self.read(chunks, n), np.uint8).astype(kind)
            if level + 1 < len(self.sizes):
                bits = np.frombuffer(self.read(bitmap, ranks - bitmap), np.uint8)
                here[np.unpackbits(bits, count=n, bitorder="little").view(bool)] |= value << kind(8)
            value = here
        return value


#: What a byte is to a word tokenizer. No part begins inside a run of one kind, nor beside ANY and QUOTE.
BLANK, LETTER, DIGIT, MARK, ANY, QUOTE = range(6)
KIND = np.full(256, ANY, np.uint8)
KIND[:128] = MARK
KIND[[9, 10, 11, 12, 13, 32]] = BLANK
KIND[48:58] = DIGIT
KIND[65:91] = KIND[97:123] = LETTER
#: A quote may begin a contraction, a < a special token; what stands between blanks with one of these is left whole.
KIND[[39, 60]] = QUOTE
#: Parts that are one word to the tokenizer, for certain.
ONE_WORD = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[!-&(-/:;=-@\[-`{-~]+")


def cut(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of the parts of texts that stand end to end in UTF-8 and begin at ``starts``.

    Parts end at white space and between ASCII letters (or those of Latin-1), digits and marks. The tokenizer's words end
    there too, its normalisation joins nothing over a boundary with an ASCII character behind it, and letters of Latin-1
    have no other form, so the ids of a text are those of its parts."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = LETTER
    solid = kind != BLANK
    word = np.empty(len(data), bool)  # begins after white space
    word[0] = True
    np.logical_not(solid[:-1], out=word[1:])
    word[starts[starts < len(data)]] = True
    word &= solid
    a, b = kind[:-1], kind[1:]
    new = word.copy()
    new[1:] |= ((a != b) | (b == DIGIT)) & (a < ANY) & (b < ANY) & (b != BLANK)
    begin = np.flatnonzero(new)
    last = np.empty(len(data), bool)
    last[-1] = True
    last[:-1] = ~solid[1:] | word[1:]
    stop = np.flatnonzero(last & solid) + 1
    of = np.cumsum(word[begin]) - 1
    quotes = np.flatnonzero(kind == QUOTE)
    if len(quotes):
        whole = np.zeros(len(stop), bool)
        whole[np.searchsorted(stop, quotes, side="right")] = True
        keep = word[begin] | ~whole[of]
        begin, of = begin[keep], of[keep]
    end = stop[of]
    inner = of[1:] == of[:-1]
    end[:-1][inner] = begin[1:][inner]
    return begin, end


def windows(data: np.ndarray, starts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of the texts' bytes of about ``most`` bytes, which end with a text or at white space."""
    at = 0
    while at < len(data):
        stop = min(at + most, len(data))
        if stop < len(data):
            i = int(np.searchsorted(starts, stop, side="right")) - 1
            if starts[i] > at:
                stop = int(starts[i])
            else:  # within a long text
                ahead = int(starts[i + 1]) if i + 1 < len(starts) else len(data)
                blank = np.flatnonzero(KIND[data[at:stop]] == BLANK)
                while not len(blank) and stop < ahead:
                    stop = min(stop + most, ahead)
                    blank = np.flatnonzero(KIND[data[stop - most : stop]] == BLANK) + (stop - most - at)
                if len(blank):
                    stop = at + int(blank[-1]) + 1
        yield at, stop
        at = stop


class WordEncoder:
    """The tokenizers library, by parts of words, each distinct one encoded once."""

    def __init__(self, model_file: str, most: int = CACHED_PARTS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(model_file)
        names = self.library.get_vocab(with_added_tokens=False)
        self.ends_word = np.zeros(self.library.get_vocab_size() + 1, bool)
        self.ends_word[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self.cache = ByteCache(self._learn, most)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, fresh: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Parts that are one word are encoded together, as the last id of a word tells where it ends."""
        simple = [i for i, p in enumerate(fresh) if ONE_WORD.fullmatch(p)]
        counts, held = np.zeros(len(fresh), np.int64), [[]] * len(fresh)
        if simple:
            lines = [" ".join([fresh[i] for i in simple[k : k + 500]]) for k in range(0, len(simple), 500)]
            ids = np.array([i for x in self._encode(lines) for i in x], np.int32)
            stop = np.flatnonzero(self.ends_word[ids]) + 1
            if len(stop) != len(simple):
                simple = []
        if simple:
            counts[simple] = np.diff(stop, prepend=0)
            if len(simple) == len(fresh):
                return ids, counts
        known = set(simple)
        other = [i for i in range(len(fresh)) if i not in known]
        for i, got in zip(other, self._encode([fresh[i] for i in other])):
            held[i], counts[i] = got, len(got)
        out = np.empty(int(counts.sum()), np.int32)
        own = np.zeros(len(fresh), bool)
        own[simple] = True
        if simple:
            out[np.repeat(own, counts)] = ids
        out[np.repeat(~own, counts)] = [x for i in other for x in held[i]]
        return out, counts

    def encode(self, texts: pa.Array | list[str | None], last: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, each text's followed by ``last``; number of each text's)."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        if not len(texts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        if texts.null_count:
            texts = texts.fill_null("")
        _, places, raw = texts.buffers()
        places = np.frombuffer(places, np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(raw or b"", np.uint8)[places[0] : places[-1]]
        edges = places - places[0]
        ids, counts = [], np.zeros(len(texts), np.int64)
        for a, b in windows(data, edges[:-1], WINDOW):
            begin, end = cut(data[a:b], edges[(edges >= a) & (edges < b)] - a)
            sizes = []
            for k in range(0, len(begin), LOOKED_UP):
                got, before = self.cache.ids_of(self.cache.rows_at(data[a:b], begin[k : k + LOOKED_UP], end[k : k + LOOKED_UP]))
                ids.append(got)
                sizes.append(np.diff(before))
            if sizes:
                upto = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
                edge = np.clip(edges, a, b) - a
                counts += np.diff(upto[np.searchsorted(begin, edge)])
        whole = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        return np.insert(whole, np.cumsum(counts), last), counts + 1


@lru_cache(maxsize=2)
def encoder(model_file: str) -> WordEncoder:
    return WordEncoder(model_file)


def write(df: DataFrame, model_file: str, key: str = "doc_id", text: str = "text", last: int = 1, partitions: int | None = None, most: int | None = None) -> str:
    """Writes the segments of df's texts, in ascending order of the key and of about ``most`` ids each, to a new folder
    of the shared one, and returns that folder."""
    spark, most = df.sparkSession, most or SEGMENT_IDS
    rows = df.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    order = ["k", F.xxhash64("t")]
    dealt = (rows.repartitionByRange(partitions, *order) if partitions else rows.repartitionByRange(*order)).sortWithinPartitions(*order)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, before = TaskContext.get().partitionId(), 0, 0
        model = encoder(model_file)
        keys: list = []
        ids, counts = [], []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, before, held
            whole = np.concatenate(ids)
            code = encode(whole, keys, np.cumsum(np.concatenate(counts)), part, number, before)
            name = f"{part}-{number}-{before}-{len(whole)}"
            number, before, held = number + 1, before + len(whole), 0
            keys.clear(), ids.clear(), counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([code], pa.binary())], names=["segment", "codes"])

        for batch in batches:
            batch_keys, at = batch.column(0).to_pylist(), 0
            for texts in arrow_slices(batch.column(1)):
                got, n = model.encode(texts, last)
                ends = np.cumsum(n)
                start = 0
                while start < len(texts):
                    # the texts up to the first that fills the segment
                    stop = min(len(texts), int(np.searchsorted(ends, most - held + (ends[start - 1] if start else 0))) + 1)
                    a = int(ends[start - 1]) if start else 0
                    ids.append(got[a : int(ends[stop - 1])])
                    counts.append(n[start:stop])
                    keys.extend(batch_keys[at + start : at + stop])
                    held += int(ends[stop - 1]) - a
                    if held >= most:
                        yield flush()
                    start = stop
                at += len(texts)
        if keys:
            yield flush()

    # the text writer puts a value's bytes down as they are, and each segment has a folder to itself
    folder = f"{shared_dir(spark)}/token-segments-{uuid.uuid4().hex}"
    dealt.mapInArrow(segments, "segment string, codes binary").select("segment", F.col("codes").cast("string")).write.partitionBy("segment").option("compression", "none").text(folder)
    return folder


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """The segments of a folder: path, part, number, start (all ids before the segment), n_ids, and content, which is read
    only where it is used. A sum for each part reaches the driver."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(folder)
    name = F.split(F.regexp_extract("path", r"segment=([0-9-]+)/", 1), "-")
    rows = files.select("path", *[F.get(name, F.lit(i)).cast("bigint").alias(c) for i, c in enumerate(("part", "number", "before", "n_ids"))], "content")
    totals = sorted((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    begin = np.cumsum([0, *(n for _, n in totals)])
    known = spark.createDataFrame([(p, int(b)) for (p, _), b in zip(totals, begin)], "part bigint, earlier bigint")
    return rows.join(F.broadcast(known), "part").select("path", "part", "number", (F.col("earlier") + F.col("before")).alias("start"), "n_ids", "content")


def token_at(spark: SparkSession, folder: str, position: int) -> int:
    """The id at a position of the whole store: one file is opened, and of it the header and, for each level, a byte, a
    block of bitmap and a rank are read."""
    at = F.lit(position)
    found = stored(spark, folder).where((F.col("start") <= at) & (at < F.col("start") + F.col("n_ids"))).select("path", "start").first()
    if not found:
        raise IndexError(position)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(found["path"])
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(path)

    def read(place: int, n: int) -> bytes:
        stream.seek(place)
        return bytes(stream.readNBytes(n))

    try:
        return Segment(read)[position - found["start"]]
    finally:
        stream.close()


DOCUMENTS = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of a folder's segments: its key, the ids of all documents before it, its number of ids and the CRC-32
    of those as little-endian unsigned 32-bit integers."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, content in zip(batch.column("start").to_pylist(), batch.column("content")):
                segment = Segment(content.as_buffer())
                raw = memoryview(segment.all().astype("<u4", copy=False)).cast("B")
                ends = segment.ends()
                begins = np.concatenate([[0], ends[:-1]])
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
                columns = [segment.keys(), begins + start, ends - begins, sums]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return stored(spark, folder).select("start", "content").mapInArrow(documents, DOCUMENTS)

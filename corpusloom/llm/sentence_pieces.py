"""SentencePiece encoding that keeps offsets, and decoding.

The model file's own normalisation is done here, so that it can say where each byte came from: at every position the
longest prefix in the compiled character map (a double-array trie) is replaced, the source position of every byte of
the replacement is recorded, white space is removed and escaped as the model asks. The pieces of the normalised text
are then projected to byte spans of the original text. The merges themselves are the sentencepiece library's.

A piece of a byte-pair model never reaches over the start of a run of escaped spaces unless some piece of the
vocabulary does. For a vocabulary without such pieces (checked when the model is loaded) a text is cut at those
starts, each distinct part is encoded once by the library and kept, and the ids are the same as those of the whole
text. Other models are given whole texts.

Defined results: a null text encodes as an empty one, which has no pieces and decodes to "". Equal texts, equal
results. Texts of any length are encoded whole. Other columns pass through untouched.
"""

from __future__ import annotations

import hashlib
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import text_udf
from corpusloom.llm.part_cache import PartCache

SPACE = "▁"
#: Distinct parts of texts that a task keeps the ids of.
CACHED_PARTS = 250_000
#: Bytes of text that a task encodes at once; as Python objects, parts and ids take some fifty times as much.
SLICE_BYTES = 1 << 20
#: Ids that are decoded at once, about.
SLICE_IDS = 1 << 19
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def fields(data: bytes) -> list[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message's fields."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    out, at = [], 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        else:
            n = {1: 8, 5: 4}[kind]
            value, at = data[at : at + n], at + n
        out.append((key >> 3, value))
    return out


class CharacterMap:
    """The compiled map: a double-array trie of sources, and the replacements, each ended by a zero byte."""

    def __init__(self, blob: bytes):
        n = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", n // 4, 4).tolist() if n else []
        self.replacements = blob[4 + n :]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes]:
        """(length of the longest source that starts here, its replacement); (0, b"") if there is none."""
        units, found, value = self.units, 0, 0
        if not units:
            return 0, b""
        node = self._offset(units[0])
        for i in range(at, len(data)):
            b = data[i]
            node ^= b
            if node >= len(units) or (units[node] & 0x800000FF) != b:
                break
            unit = units[node]
            node ^= self._offset(unit)
            if unit & 256:
                found, value = i + 1 - at, units[node] & 0x7FFFFFFF
        if not found:
            return 0, b""
        return found, self.replacements[value : self.replacements.index(b"\0", value)]


class Normalizer:
    def __init__(self, charsmap: bytes = b"", dummy_prefix: bool = True, squeeze: bool = True, escape: bool = True, suffix: bool = False, symbols: tuple[bytes, ...] = ()):
        self.map = CharacterMap(charsmap)
        self.dummy_prefix, self.squeeze, self.suffix, self.symbols = dummy_prefix, squeeze, suffix, sorted(symbols, key=len, reverse=True)
        self.space = SPACE.encode() if escape else b" "
        self.plain = not self.map.units and not squeeze and not symbols

    def _prefix(self, data: bytes, at: int) -> tuple[int, bytes]:
        for s in self.symbols:
            if data.startswith(s, at):
                return len(s), s
        n, text = self.map.longest(data, at)
        if n:
            return n, text
        b = data[at]
        n = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
        return n, data[at : at + n]

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """(normalised bytes, source position of each of them and of the end)."""
        if not data:
            return b"", np.zeros(1, np.int64)
        width = len(self.space)
        if self.plain:
            raw = np.frombuffer(data, np.uint8)
            align = np.repeat(np.arange(len(raw)), np.where(raw == 32, width, 1))
            out = data.replace(b" ", self.space)
            if self.dummy_prefix and not self.suffix:
                out, align = self.space + out, np.concatenate([np.zeros(width, np.int64), align])
            elif self.dummy_prefix:
                out, align = out + self.space, np.concatenate([align, np.full(width, len(raw))])
            return out, np.append(align, len(raw))
        at, out, align = 0, bytearray(), []
        if self.squeeze:
            while at < len(data):
                n, text = self._prefix(data, at)
                if text != b" ":
                    break
                at += n
            if at == len(data):
                return b"", np.array([at])

        def add(x: bytes) -> None:
            out.extend(x)
            align.extend([at] * len(x))

        if self.dummy_prefix and not self.suffix:
            add(self.space)
        spaced = self.squeeze
        while at < len(data):
            n, text = self._prefix(data, at)
            if spaced:
                text = text.lstrip(b" ")
            if text:
                add(text.replace(b" ", self.space))
                spaced = text.endswith(b" ")
            at += n
            if not self.squeeze:
                spaced = False
        if self.squeeze:
            while out.endswith(self.space):
                at = align[len(out) - width]
                del out[-width:], align[-width:]
        if self.dummy_prefix and self.suffix:
            add(self.space)
        return bytes(out), np.array([*align, at])


class Codec:
    def __init__(self, model_file: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        with open(model_file, "rb") as f:
            message = fields(f.read())
        pieces = [dict(fields(v)) for k, v in message if k == 1]
        texts, kinds = [p[1].decode() for p in pieces], [p.get(3, NORMAL) for p in pieces]
        trainer, spec = (dict(fields(next((v for k, v in message if k == n), b""))) for n in (2, 3))
        symbols = tuple(t.encode() for t, k in zip(texts, kinds) if k == USER)
        self.normalizer = Normalizer(spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1)), bool(trainer.get(24, 0)), symbols)
        self.lengths = np.array([1 if k == BYTE else len(t.encode()) for t, k in zip(texts, kinds)], dtype=np.int64)
        crossing = re.compile(f"[^{SPACE}]{SPACE}")
        self.divisible = (
            trainer.get(3, 1) == 2  # byte pairs
            and self.normalizer.plain
            and self.normalizer.dummy_prefix
            and not self.normalizer.suffix
            and bool(spec.get(5, 1))
            and SPACE in texts
            and BYTE in kinds
            and not any(crossing.search(t) for t, k in zip(texts, kinds) if k in (NORMAL, UNUSED))
        )
        self.parts = re.compile(f"{SPACE}+[^{SPACE}]*")
        self.single = texts.index(SPACE) if SPACE in texts else None
        self.decimal = list(map(str, range(len(texts))))
        self.cache = PartCache(self._learn, CACHED_PARTS)

    def _learn(self, fresh: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = self.library.encode([x[1:].replace(SPACE, " ") for x in fresh], num_threads=1)
        got = [[self.single] if x == SPACE else ids for x, ids in zip(fresh, got)]
        return np.array([i for ids in got for i in ids], np.int32), np.array(list(map(len, got)), np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, number of each text's)."""
        if not self.divisible:
            got = self.library.encode(texts, num_threads=1) if texts else []
            return np.array([i for x in got for i in x], np.int64), np.array(list(map(len, got)), np.int64)
        parts: list[str] = []
        stops = []
        for t in texts:
            if t:
                parts += self.parts.findall(SPACE + t.replace(" ", SPACE))
            stops.append(len(parts))
        ids, before = self.cache.ids_of(self.cache.rows(parts))
        return ids, np.diff(before[stops], prepend=0)

    def spans(self, texts: list[str], ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin, end) in bytes of the original text of every piece. A piece that stands for added white space only is empty."""
        begins, ends = np.empty(len(ids), np.int64), np.empty(len(ids), np.int64)
        at = 0
        for text, n in zip(texts, counts):
            n = int(n)
            if n:
                _, align = self.normalizer(text.encode())
                if self.divisible:
                    sizes = self.lengths[ids[at : at + n]]
                else:  # unknown pieces have the length of their own text
                    own = self.library.encode(text, out_type=str)
                    sizes = np.where(np.isin(ids[at : at + n], [self.library.unk_id()]), [len(x.encode()) for x in own], self.lengths[ids[at : at + n]])
                stop = np.cumsum(sizes)
                ends[at : at + n] = align[stop]
                begins[at : at + n] = align[stop - sizes]
            at += n
        return begins, ends

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The library's decoding of each text's ids."""
        if not len(counts):
            return []
        stop = np.cumsum(counts)
        return self.library.decode([ids[b - n : b].tolist() for b, n in zip(stop, counts)], num_threads=1)


@lru_cache(maxsize=2)
def codec(model_file: str) -> Codec:
    """One codec for each process and model."""
    return Codec(model_file)


def encode(df: DataFrame, model_file: str, text: str = "text", into: str = "pieces") -> DataFrame:
    """df with a struct column: the ids, and the byte span of each piece in the original text."""

    def make():
        c = codec(model_file)

        def run(texts: list[str | None]) -> pa.Array:
            whole = [t or "" for t in texts]
            ids, counts = c.encode(whole)
            begins, ends = c.spans(whole, ids, counts)
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x, pa.int32())) for x in (ids, begins, ends)]
            return pa.StructArray.from_arrays(lists, ["ids", "begins", "ends"])

        return run

    return df.withColumn(into, text_udf(None, "struct<ids:array<int>,begins:array<int>,ends:array<int>>", make, SLICE_BYTES)(F.col(text).cast("string")))


def decode(df: DataFrame, model_file: str, ids: str, into: str = "decoded") -> DataFrame:
    """df with the text of a column of ids; null for null."""

    @F.arrow_udf("string")
    def run(batch: pa.Array) -> pa.Array:
        c, texts, at = codec(model_file), [], 0
        ends = np.cumsum(pc.list_value_length(batch).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        while at < len(batch):
            # rows of about SLICE_IDS ids at once: a batch's ids as Python integers need many times its memory
            begin = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, begin + SLICE_IDS, side="right")))
            texts += [None if x is None else c.library.decode(x) for x in batch.slice(at, stop - at).to_pylist()]
            at = stop
        return pa.array(texts, pa.string())

    return df.withColumn(into, run(F.col(ids)))


def round_trip(df: DataFrame, model_file: str, text: str = "text", into: str = "coded") -> DataFrame:
    """df with a struct column: the ids, the byte span of each piece in the original text, and the text that the ids
    decode to, in one pass over slices of bounded size."""

    def make():
        c = codec(model_file)

        def run(texts: list[str | None]) -> pa.Array:
            whole = [t or "" for t in texts]
            ids, counts = c.encode(whole)
            begins, ends = c.spans(whole, ids, counts)
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (ids, begins, ends)]
            return pa.StructArray.from_arrays([*lists, pa.array(c.decode(ids, counts), pa.string())], ["ids", "begins", "ends", "decoded"])

        return run

    returns = "struct<ids:array<int>,begins:array<int>,ends:array<int>,decoded:string>"
    return df.withColumn(into, text_udf(None, returns, make, SLICE_BYTES)(F.col(text).cast("string")))


RESULT = "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string,spans_sha256:string>"


def digests(df: DataFrame, model_file: str, text: str = "text", into: str = "digest") -> DataFrame:
    """df with a struct column: number of ids, and SHA-256 of the ids, of the decoded text and of the spans (as pairs
    of little-endian 64-bit integers)."""

    def make():
        c = codec(model_file)

        def run(texts: list[str | None]) -> pa.Array:
            whole = [t or "" for t in texts]
            ids, counts = c.encode(whole)
            decimal = list(map(c.decimal.__getitem__, ids.tolist()))
            begins, ends = c.spans(whole, ids, counts)
            pairs = np.stack([begins, ends], axis=1).astype("<i8") if len(ids) else np.zeros((0, 2), "<i8")
            stop = np.cumsum(counts)
            sha = lambda x: hashlib.sha256(x).hexdigest()
            columns = [
                pa.array(counts, pa.int64()),
                pa.array([sha(",".join(decimal[b - n : b]).encode()) for b, n in zip(stop, counts)], pa.string()),
                pa.array([sha(x.encode()) for x in c.decode(ids, counts)], pa.string()),
                pa.array([sha(pairs[b - n : b].tobytes()) for b, n in zip(stop, counts)], pa.string()),
            ]
            return pa.StructArray.from_arrays(columns, ["n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])

        return run

    return df.withColumn(into, text_udf(None, RESULT, make, SLICE_BYTES)(F.col(text).cast("string")))

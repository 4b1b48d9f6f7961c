import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusloom.llm import queries as q
from corpusloom.llm import token_store as ts

MODEL = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(MODEL)


@pytest.fixture(scope="module")
def own():
    return ts.WordEncoder(MODEL)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 255), st.integers(0, 2**17), st.integers(0, 2**40)), max_size=1500))
def test_segments_give_back_every_id(ids):
    s = ts.Segment(ts.encode(np.array(ids, np.uint64)))
    assert len(s) == len(ids) and s.all().tolist() == ids
    for i in range(0, len(ids), 7):
        assert s[i] == ids[i]
    with pytest.raises(IndexError):
        s[len(ids)]


def test_only_a_segment_is_read():
    with pytest.raises(ValueError):
        ts.Segment(b"nothing")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abT's ,.\n\t́ İΣ<|>endoftext"), st.characters(exclude_categories=["Cs"]))), max_size=4))
def test_words_give_the_ids_of_whole_texts(library, own, texts):
    ids, counts = own.encode(texts, 1)
    want = [library.encode(t, add_special_tokens=False).ids + [1] for t in texts]
    assert ids.tolist() == [i for x in want for i in x] and counts.tolist() == list(map(len, want))


def test_special_tokens_in_texts(library, own):
    for t in ["<|endoftext|>", "a<|startoftext|>b c<|endoftext|>", "<|ENDOFTEXT|> x", "\n\n  \n", "It's  they'll x"]:
        assert own.encode([t], 1)[0].tolist() == library.encode(t, add_special_tokens=False).ids + [1]


def want_of(library, rows):
    start, out = 0, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        out[i] = (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    return out


def test_query_against_the_definition(spark, library, monkeypatch):
    monkeypatch.setattr(ts, "SEGMENT_IDS", 40)
    rows = [(i * 7 % 101 - 3, None if i % 10 == 0 else "" if i % 10 == 1 else f"Some words, {i} of them " * (i % 6)) for i in range(101)] + [(1000, "long " * 60_000)]
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, start int").repartition(5)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in q.op8(spark, docs).collect()}
    assert got == want_of(library, rows)
    assert q.op8(spark, docs.where("doc_id = -99")).count() == 0


def test_repeated_and_null_ids(spark):
    rows = [(None, "a"), (None, "b c"), (1, "x y"), (1, "x y"), (1, "z"), (2, "w")]
    got = q.op8(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] or 0 for r in got) == [0, 0, 1, 1, 1, 2]
    by_start = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in by_start] == np.cumsum([0, *[r["n_tokens"] for r in by_start]])[:-1].tolist()
    assert [r["doc_id"] for r in by_start] == [None, None, 1, 1, 1, 2]


def test_test_tables(spark, library):
    sf = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in q.QUERIES["op8_token_store"](spark, sf).collect()}
    assert got == want_of(library, rows)


def test_single_ids_are_read_from_the_stored_files(spark, library):
    rows = [(i * 7 % 101, f"Some words, {i} of them " * (i % 6)) for i in range(101)] + [(None, "none"), (7, "très, très long\t" * 500)]
    folder = ts.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), MODEL, most=60)
    ids = []
    for _, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, len(r[1]))):
        ids.append(library.encode(t, add_special_tokens=False).ids + [1])
    got = sorted((r["start"], r["n_tokens"]) for r in ts.read(spark, folder).collect())
    assert sum(map(len, ids)) == got[-1][0] + got[-1][1]
    whole = np.concatenate([ts.Segment(bytes(r["content"])).all() for r in ts.stored(spark, folder).orderBy("start").collect()])
    assert len(whole) == sum(map(len, ids)) and sorted(whole.tolist()) == sorted(i for x in ids for i in x)
    for position in [0, 1, 59, 60, 61, len(whole) // 2, len(whole) - 1]:
        assert ts.token_at(spark, folder, position) == whole[position]
    with pytest.raises(IndexError):
        ts.token_at(spark, folder, len(whole))


def test_a_single_id_takes_few_bytes():
    ids = np.random.default_rng(3).integers(0, 1 << 20, 50_000)
    data, seen = ts.encode(ids), []

    def read(at, n):
        seen.append(n)
        return data[at : at + n]

    s = ts.Segment(read)
    opened = sum(seen)
    for i in range(0, 50_000, 997):
        seen.clear()
        assert s[i] == ids[i] and sum(seen) <= 3 * (1 + ts.BLOCK + 4)
    assert opened < 100 and ts.Segment(data).all().tolist() == ids.tolist()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab é\n,1'"), max_size=60), min_size=1, max_size=5), st.integers(1, 9))
def test_windows_end_at_white_space_or_with_a_text(texts, most):
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    starts = np.cumsum([0, *map(len, raw)])[:-1]
    at = 0
    for a, b in ts.windows(data, starts, most):
        assert a == at and b > a
        assert b == len(data) or b in starts or data[b - 1] in (32, 10)
        at = b
    assert at == len(data)


def test_long_texts_in_windows_and_many_parts(library, monkeypatch):
    monkeypatch.setattr(ts, "WINDOW", 50)
    monkeypatch.setattr(ts, "LOOKED_UP", 7)
    small = ts.WordEncoder(MODEL, most=20)
    texts = ["Grüße, ça va? " * 40 + "x" * 300, "", "it's <b>bold</b> " * 30, None, "1234 &&& é” “a”, b"]
    ids, counts = small.encode(texts, 1)
    want = [library.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    assert ids.tolist() == [i for x in want for i in x] and counts.tolist() == list(map(len, want))

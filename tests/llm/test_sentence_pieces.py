import hashlib
import struct

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import queries as q
from corpusloom.llm import sentence_pieces as sp

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  a  b ", "▁x ▁▁ y▁", "\x00a\nb\t c", "😀 語 a", " trailing ", "a" * 3000, "é" * 50 + " " * 70 + "́"]


@pytest.fixture(scope="module")
def codec():
    return sp.Codec(MODEL)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab ▁é\n\t語😀'"), st.characters(exclude_categories=["Cs"]))), max_size=4))
def test_equals_the_library(codec, texts):
    ids, counts = codec.encode(texts)
    want = codec.library.encode(texts) if texts else []
    assert ids.tolist() == [i for x in want for i in x] and counts.tolist() == list(map(len, want))
    assert codec.decode(ids, counts) == [codec.library.decode(x) for x in want]
    begins, ends = codec.spans(texts, ids, counts)
    at = 0
    for text, n in zip(texts, counts):
        raw, a, b = text.encode(), begins[at : at + n], ends[at : at + n]
        # the spans lie side by side and cover the text
        assert n == 0 or (a[0] == 0 and b[-1] == len(raw) and (a[1:] == b[:-1]).all())
        for i, x, y in zip(ids[at : at + n], a, b):
            if not codec.library.is_byte(int(i)):
                # added white space has no source; all other bytes are the piece's own
                assert codec.library.id_to_piece(int(i)).replace("▁", " ").strip(" ") == raw[x:y].decode().replace("▁", " ").strip(" ")
        at += n


def test_kept_parts_are_dropped_without_changing_results(codec, monkeypatch):
    monkeypatch.setattr(codec.cache, "most", 5)
    for text in ODD * 2:
        assert codec.encode([text])[0].tolist() == codec.library.encode(text)


@pytest.mark.parametrize("rule", ["identity", "nfkc", "nmt_nfkc", "nmt_nfkc_cf"])
@pytest.mark.parametrize("squeeze", [True, False])
def test_normalisation_and_alignment_equal_the_library(rule, squeeze):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, escape_whitespaces=True, remove_extra_whitespaces=squeeze)
    spec = dict(sp.fields(dict(sp.fields(library.serialized_model_proto()))[3]))
    own = sp.Normalizer(spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1)))
    for text in [*ODD, "ﬁne ＡＢＣ １２３ ½ ㈱", "  ｶﾞ ｷﾞ  x　y ", "Straße ÅÅ", "  a​b", "ＡＢ  Ｃ　　"]:
        out, align = own(text.encode())
        want, offsets = library.normalize(text, with_offsets=True)
        assert out.decode() == want
        # the library's offsets count characters
        raw, starts = text.encode(), []
        for i, ch in enumerate(want):
            starts.append(len(want[:i].encode()))
        assert [len(raw[: align[s]].decode()) for s in starts] == list(offsets[: len(starts)])


def test_longest_prefix_wins():
    library = sentencepiece.SentencePieceNormalizer(rule_name="nfkc")
    spec = dict(sp.fields(dict(sp.fields(library.serialized_model_proto()))[3]))
    m = sp.CharacterMap(spec[2])
    assert m.longest("ｶﾞ".encode(), 0) == (6, "ガ".encode())
    assert m.longest("ｶx".encode(), 0) == (3, "カ".encode())
    assert m.longest(b"x", 0) == (0, b"") and sp.CharacterMap(b"").longest(b"x", 0) == (0, b"")


def test_query_and_columns(spark, codec):
    rows = [(i, t, "ids") for i, t in enumerate([None, *ODD, ODD[2]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pieces string")
    got = {r["doc_id"]: r for r in q.op5(spark, docs).collect()}
    spans = {r["doc_id"]: r for r in sp.decode(sp.encode(docs, MODEL, into="p"), MODEL, "p.ids").collect()}
    for i, t, _ in rows:
        ids = codec.library.encode(t or "")
        r, s = got[i], spans[i]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(codec.library.decode(ids).encode()).hexdigest()
        assert list(s["p"]["ids"]) == ids and s["decoded"] == codec.library.decode(ids)
        assert r["spans_sha256"] == hashlib.sha256(b"".join(struct.pack("<qq", a, b) for a, b in zip(s["p"]["begins"], s["p"]["ends"]))).hexdigest()
    assert q.op5(spark, docs.where("doc_id < 0")).count() == 0


def test_round_trip_is_encode_and_decode(spark, monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(sp, "SLICE_IDS", 8)
    model = MODEL
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["Hello  world", "", None, "é😀 x\n\ny", " a" * 500, "a"])], "i int, text string")
    coded = {r["i"]: r for r in sp.decode(sp.encode(df, model), model, "pieces.ids").collect()}
    for r in sp.round_trip(df, model).collect():
        assert r["coded"]["ids"] == coded[r["i"]]["pieces"]["ids"] and r["coded"]["decoded"] == coded[r["i"]]["decoded"]


def test_a_task_holds_one_slice_of_results_and_few_parts(codec):
    import pyarrow as pa

    from corpusloom.llm.common import text_udf

    batch = pa.array(["x" * 1000, None, "", "y" * 5000, "z"] * 40)
    run = text_udf(lambda texts: pa.array([len(t or "") for t in texts], pa.int64()), "bigint", most=8000).func
    got = list(run(iter([batch, batch[:0], batch[:3]])))
    assert pa.concat_arrays(got).to_pylist() == [len(t or "") for t in [*batch.to_pylist(), *batch[:3].to_pylist()]]
    assert max(map(len, got)) <= 10  # as whole batches they'd take a task's memory several times
    mine = sp.Codec(MODEL)
    for k in range(0, 600_000, 50_000):
        mine.encode([" ".join(f"w{i}" for i in range(k, k + 50_000))])
        assert len(mine.cache.known) <= 300_000

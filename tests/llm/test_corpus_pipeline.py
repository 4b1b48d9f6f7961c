import hashlib

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as cp
from corpusloom.llm import decontaminate as dc
from tests.llm.test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_names_and_order():
    assert [n.split()[0] for n, _ in cp.STAGES] == ["quality", "language", "SimHash", "benchmark", "SentencePiece"]
    assert "pipeline" in entry.queries()


def test_quality_keeps_the_good(spark, docs):
    kept = cp.keep_quality(spark, docs, SF)
    assert kept.columns == docs.columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    ids = {r["doc_id"] for r in kept.collect()}
    right = [(i in ids) == bool(v) for i, v in labels.items()]
    assert sum(right) / len(right) > 0.95


def test_language_keeps_all_with_letters(spark, docs):
    more = docs.unionByName(spark.createDataFrame([(-1, "12 34 !!", None, None, 8), (-2, None, None, None, None)], docs.schema))
    kept = cp.keep_language(spark, more, SF)
    ids = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == docs.columns and not ids & {-1, -2}
    assert len(ids) > 0.99 * docs.count()


def test_one_of_each_group_stays(spark, docs):
    odd = [(None, "same text here today", None, None, 1), (None, "same text here today", None, None, 1)]
    some = docs.where("doc_id < 300").unionByName(docs.where("doc_id < 3")).unionByName(spark.createDataFrame(odd, docs.schema))
    kept = cp.keep_one_of_each(spark, some, SF)
    rows = sorted(texts_of(docs.where("doc_id < 300")).items())
    groups = plain_components([plain_fingerprint(t) for _, t in rows])
    want = sorted(rows[i][0] for i in {*groups})
    got = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == docs.columns and sorted(x for x in got if x is not None) == want and got.count(None) == 2


def test_contaminated_documents_go(spark, docs):
    kept = cp.drop_contaminated(spark, docs, SF)
    flat = lambda t: " " + " ".join(dc.words_of(t)) + " "
    items = [flat(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    holding = {i for i, t in texts_of(docs).items() if any(x in flat(t) for x in items)}
    ids = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == docs.columns and holding and not ids & holding and docs.count() - len(ids) <= len(holding) + 3


def test_encode(spark, docs):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    some = docs.where("doc_id < 40").unionByName(spark.createDataFrame([(-1, None, None, None, None)], docs.schema))
    texts = texts_of(some)
    for r in cp.encode(spark, some, SF).collect():
        ids = library.encode(texts[r["doc_id"]] or "")
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_encode_gives_the_span_of_every_piece(spark, docs):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    odd = [(-1, None, None, None, None), (-2, "  é😀  x\n▁y ", None, None, None)]
    some = docs.where("doc_id < 40").unionByName(spark.createDataFrame(odd, docs.schema))
    texts = texts_of(some)
    for r in cp.encode(spark, some, SF).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        assert len(r["begins"]) == len(r["ends"]) == len(r["ids"])
        # side by side over the whole text, each over its own piece
        assert [0, *r["ends"]][: len(r["ids"])] == r["begins"] and (r["ends"] or [0])[-1] == len(raw)
        for i, a, b in zip(r["ids"], r["begins"], r["ends"]):
            if not library.is_byte(i):
                assert library.id_to_piece(i).replace("▁", " ").strip(" ") == raw[a:b].decode().replace("▁", " ").strip(" ")


def test_whole_run_and_empty_table(spark, docs):
    out = cp.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
    n = out.count()
    assert 0.5 * docs.count() < n < docs.count() and out.select("doc_id").distinct().count() == n
    none = docs.where("doc_id < 0").withColumn("extra", F.lit(1))
    for _, stage in cp.STAGES:
        assert stage(spark, none, SF).count() == 0

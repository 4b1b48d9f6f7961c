"""The queries of this subpackage by name, with SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, filter_audit, html_region, jpeg, langid_crf, merkle, quality_rules, quote_threads, sentence_pieces, simhash, source_mix, token_store, url_filter
from corpusloom.llm.common import held_out_of, table


def op1(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """A language for every document; learned from the four fifths that are not held out."""
    d = docs.select("doc_id", "text", "lang", held_out_of(F.col("doc_id"), 5, 0).alias("held_out"))
    model = langid_crf.fit(d.where("NOT held_out"))
    return langid_crf.predict(d.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "language.lang_pred", "language.score")


def op2(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A quality score for every document; learned from the two thirds of the labels that are not held out."""
    d = docs.select("doc_id", "text")
    known = labels.where(~held_out_of(F.col("doc_id"), 3, 1))
    ensemble = quality_rules.fit(quality_rules.labelled_sample(d, known, "doc_id", "quality"), "text", "label")
    scored = quality_rules.score(d, ensemble)
    return scored.select("doc_id", held_out_of(F.col("doc_id"), 3, 1).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))


def op3(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """Every message's own text, and what it replies to."""
    c = conversations.select("conv_id", "turn", "role", "text")
    return quote_threads.thread(c).select("conv_id", "turn", "role", "reply.*")


def quote_conversations(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The threads that op3's operator builds: their messages in reply order, without quotes, as one text a part."""
    c = conversations.select("conv_id", "turn", "role", "text")
    built = quote_threads.conversations(quote_threads.thread(c))
    said = F.transform("messages", lambda m: F.concat(F.coalesce(m["role"], F.lit("")), F.lit(": "), F.coalesce(m["text"], F.lit(""))))
    return built.select(F.col("conversation").alias("conv_id"), "root_turn", "part", F.size("messages").cast("long").alias("n_messages"), F.array_join(said, "\n\n").alias("text"))


def op4(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Every document stored as an image and read back."""
    return jpeg.with_digests(docs.select("doc_id", "text")).select("doc_id", "media.*")


def op5(spark: SparkSession, docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """Every document encoded and decoded."""
    model_file = model_file or public_tokenizers.path("piece_bpe_32k.model")
    return sentence_pieces.digests(docs.select("doc_id", "text"), model_file).select("doc_id", "digest.*")


def op6(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for every benchmark item that a document holds."""
    found = decontaminate.with_hits(docs.select("doc_id", "text"), benchmark.select("item_id", "text"))
    return found.select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.*")


def op7(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """A fingerprint and the near-duplicates' smallest id for every document."""
    return simhash.cluster(docs)


def op8(spark: SparkSession, docs: DataFrame, model_file: str | None = None) -> DataFrame:
    """Every document's place and ids, read back from the segments that all documents were written to."""
    return token_store.read(docs.sparkSession, token_store.write(docs, model_file or public_tokenizers.path("word_bpe_49k.json")))


def op9(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """The main text of every page."""
    p = pages.select("page_id", "url", "html")
    return html_region.with_text(p, html_region.fit(p)).select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op10(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """A verdict on every page's URL."""
    return url_filter.judge(pages.select("page_id", "url")).select("page_id", "judged.*")


def op11(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What five filters take from each other, by language and order."""
    flags = filter_audit.document_flags(docs, labels)
    return filter_audit.audit(flags, list("ABCDE"), "part", ["quality", "toxic"]).withColumnsRenamed({"lost_quality": "good_lost", "lost_toxic": "toxic_lost"})


def op12(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """How many words of every document a mix of the sources takes."""
    return source_mix.taken(source_mix.prepare(docs.select("doc_id", "text", "source")))


def op13(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Every document's place in the manifest, proven from what it is after tampering."""
    return merkle.prove(merkle.document_leaves(docs))


QUERIES = {
    "op1_langid_crf": lambda spark, sf_dir: op1(spark, table(spark, sf_dir, "documents")),
    "op2_quality_rules": lambda spark, sf_dir: op2(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op3_quote_threads": lambda spark, sf_dir: op3(spark, table(spark, sf_dir, "conversations")),
    "op4_jpeg": lambda spark, sf_dir: op4(spark, table(spark, sf_dir, "documents")),
    "op5_sentence_pieces": lambda spark, sf_dir: op5(spark, table(spark, sf_dir, "documents")),
    "op6_decontaminate": lambda spark, sf_dir: op6(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op7_simhash": lambda spark, sf_dir: op7(spark, table(spark, sf_dir, "documents")),
    "op8_token_store": lambda spark, sf_dir: op8(spark, table(spark, sf_dir, "documents")),
    "op9_html_region": lambda spark, sf_dir: op9(spark, table(spark, sf_dir, "pages")),
    "op10_url_filter": lambda spark, sf_dir: op10(spark, table(spark, sf_dir, "pages")),
    "op11_filter_audit": lambda spark, sf_dir: op11(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op12_source_mix": lambda spark, sf_dir: op12(spark, table(spark, sf_dir, "documents")),
    "op13_merkle": lambda spark, sf_dir: op13(spark, table(spark, sf_dir, "documents")),
    "quote_conversations": lambda spark, sf_dir: quote_conversations(spark, table(spark, sf_dir, "conversations")),
}

ORACLE_SQL: dict[str, str] = {"op10_url_filter": url_filter.oracle_sql(), "op11_filter_audit": filter_audit.ORACLE_SQL, "op13_merkle": merkle.oracle_sql()}

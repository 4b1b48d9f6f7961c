"""The corpus pipeline: from documents to token ids, in five stages.

Each stage takes what its predecessor kept, as a DataFrame with the columns of ``documents``; all but the last return
those columns. Models are fitted on the stage's own input (and ``labels``), as in the single operators' queries.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, langid_crf, quality_rules, sentence_pieces, simhash
from corpusloom.llm.common import held_out_of, stored, table

#: A text is kept whose language has at least this share of its words.
LEAST_SHARE = 0.5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble thinks likelier good than bad."""
    known = table(spark, sf_dir, "labels").where(~held_out_of(F.col("doc_id"), 3, 1))
    sample = quality_rules.labelled_sample(docs.select("doc_id", "text"), known, "doc_id", "quality")
    ensemble = quality_rules.fit(sample, "text", "label")
    return quality_rules.at_least(docs, ensemble, 0.5)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; those without letters, or without a main language, go."""
    model = langid_crf.fit(docs.where(~held_out_of(F.col("doc_id"), 5, 0)))
    named = langid_crf.predict(docs, model)
    return named.where((F.col("language.lang_pred") != langid_crf.UNKNOWN) & (F.col("language.score") >= LEAST_SHARE)).select(docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id. Rows without an id can't be told apart by
    it and all stay; rows that repeat an id stay once for each different text."""
    first = simhash.cluster(docs).where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.select(docs.columns).unionByName(docs.where("doc_id IS NULL"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = decontaminate.with_hits(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("hits") == 0).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256, begins, ends) of every document; begins and ends are the byte span of each
    piece in its text."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    coded = sentence_pieces.round_trip(docs.select("doc_id", "text"), model).select("doc_id", "coded.*")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"), "begins", "ends")


STAGES = [
    ("quality classifier", keep_quality),
    ("language ID", keep_language),
    ("SimHash near-dedup", keep_one_of_each),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding and decoding", encode),
]

#: The stages learn models, walk at random and merge pieces, which SQL can't say; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each one's result written to the shared folder and read again by the next. The spans of the last stage
    are computed, but this result is held to its four columns; who wants the spans takes them from ``encode``."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"stage-{i + 1}")
    return docs.drop("begins", "ends")

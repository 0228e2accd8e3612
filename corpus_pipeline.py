"""The corpus pipeline: STAGES, applied in turn to the documents, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neurolake.cluster import ship
from neurolake.llm import common, mixing, neardup, packing, pii, toxicity

#: What every stage but the last returns; other columns of its input, whatever their names, are left out.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the tagger, learnt from the labelled ones of these, scores as toxic.

    Null and empty texts have no labelled word and stay; a null doc_id has no label, and its text is scored like any other; rows that repeat an id or a text are scored
    alike, so they stay or go together; very long texts are read whole. Without labels, or without documents, nothing goes.
    """
    ship(spark)
    tagger = toxicity.learn(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, tagger).select(*COLUMNS)


def _neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: its smallest doc_id.

    Null and empty texts, and texts without words, are no duplicates of anything and all stay; of a group whose ids are all null nothing has a smallest id, and its rows stay once
    each; of rows that repeat an id and its text one stays. No documents give none.
    """
    ship(spark)
    return neardup.one_of_each(docs).select(*COLUMNS)


def _pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by the names of its kinds; ``n_chars`` is counted anew.

    A null text stays null, an empty one empty; ids, sources and languages aren't looked at, and stay as they are, null or not; repeated rows are redacted alike; texts of
    any length are read whole. Every row stays.
    """
    ship(spark)
    return pii.redact(docs).select(*COLUMNS)


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bring the sources to their target shares; a document comes out once for each of its copies, or not at all.

    Null and empty texts have no mass and are drawn at their source's rate; a null source is one of its own; a null doc_id is drawn as ``null``; rows that repeat an id are
    drawn alike. No documents give none.
    """
    ship(spark)
    return mixing.mix_sources(docs).select(*COLUMNS)


def _pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut the stream of documents into windows of at most 4096 tokens.

    A null or empty text is its end token alone; null ids and rows that repeat an id are documents like others; very long texts are cut as often as they need. Returns a row
    a piece. No documents give none.
    """
    ship(spark)
    import public_tokenizers

    pieces = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("toxicity", _toxic), ("neardup", _neardup), ("pii", _pii), ("mix", _mix), ("pack", _pack)]
#: Learnt scores, signatures and the tokenizer can't be written in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

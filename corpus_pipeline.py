"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read
again as the next stage's ``docs``. All but the last give the columns of ``documents``; where a text
changes, ``n_chars`` follows it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodscape.llm import packing, pii, quality, simhash, substrings
from lodscape.llm.common import public_vocabulary, table, texts_at_once, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels that are not held out, doesn't reject.

    Null and empty texts get the score of a text without words; repeated rows are judged one by one; a score just at
    the limit stays; without labels of both kinds nothing is rejected. All columns, an empty table too, stay as they are.
    """
    model = quality.learn_quality(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model).where("predicted = 1").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each component of documents at five-word Jaccard similarity 0.8 or more.

    Null and empty texts are copies of each other; rows that repeat an id are one document; rows without an id stay.
    All columns, an empty table too, stay as they are.
    """
    return simhash.drop_similar_documents(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document holds too; a document that loses all its words stays, empty.

    Null texts stay null; rows without an id are left alone; rows that repeat an id are one document. All other columns,
    an empty table too, stay as they are.
    """
    return _recounted(substrings.cut_repeats(docs).select(*docs.columns))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind. Null texts stay null, repeated rows, all other columns and an empty table
    as they are; texts of any length are searched whole."""
    return _recounted(pii.mask_personal_data(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document: its ids, and its place in a training sequence of 2048 tokens.

    Null and empty texts are one end id; repeated rows are packed one by one; very long texts are cut into pieces of 2048; an
    empty table gives an empty result. A worker remembers fewer words and encodes less text at once than the operator does alone: by this stage an executor's
    heap and buffers have grown to what all stages before took.
    """
    pieces = packing.pack_documents(docs, public_vocabulary("word_bpe_49k.json"), remembered=50_000, at_once=1 << 18)
    return pieces.select("doc_id", "piece", "start", "length", "ids", "sequence_id", "offset")


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


STAGES = [
    ("quality classifier", keep_quality),
    ("simhash near-dedup", drop_near_copies),
    ("substring dedup", cut_repeated_passages),
    ("personal data", mask_personal_data),
    ("best-fit packing", pack_sequences),
]

#: Hashes of models and iterated components have no SQL form; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with texts_at_once(spark):
            docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs

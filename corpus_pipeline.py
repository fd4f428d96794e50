"""A corpus pipeline over documents: language, exact copies, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet and read again as the next stage's docs.  All but the last
return the columns of ``documents``; further columns of the input, whatever
their names, are passed on.  An empty table gives an empty result of the same
columns.  Rows that share a doc_id are rows of their own until a stage says
otherwise.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import language_id
from tideline.llm.common import Shelf, stash
from tideline.llm.exact_dedup import drop_copies
from tideline.llm.order_minhash import drop_near_copies
from tideline.llm.packing import pack
from tideline.llm.pii import mask_pii


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that have a language; those without a letter are rejected.

    The model learns from the rows given, as op7 does: labels of a bounded
    sample whose crc32(doc_id) mod 3 is not 1.  A document's ``lang`` stays what
    the table says; where that is null it becomes the predicted one.  A null
    text has no letter; a null doc_id doesn't matter but that its row is not
    learned from; repeated rows are judged each.
    """
    return language_id.keep_known(docs, language_id.fit(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays.

    Null and empty texts are equal; a null doc_id is smaller than any other; of
    rows that share text and doc_id one stays.
    """
    return drop_copies(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the largest doc_id.

    Null texts count as empty; rows with a null doc_id are compared with none
    and stay; of rows that share the doc_id of a group one stays.
    """
    return drop_near_copies(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by the mask of its kind; n_chars follows.

    Null texts stay null, and their n_chars becomes null; ids are not read;
    repeated rows are masked each.
    """
    return mask_pii(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens.

    A null text is a piece of the end id alone; a null doc_id stays null;
    repeated rows are packed each.
    """
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]

#: Edit distances, learned weights and tokenizer merges are beyond SQL; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``; each stage's table is removed once the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Shelf(spark) as shelf:
        for _, stage in STAGES[:-1]:
            docs = shelf.put(stage(spark, docs, sf_dir), "stage")
        return stash(STAGES[-1][1](spark, docs, sf_dir), "pipeline")

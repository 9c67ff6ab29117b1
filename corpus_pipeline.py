"""The corpus pipeline: language ID, exact dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
docs. Rejected documents, copies, near copies and what the mixture leaves out are gone for all later stages. The last stage
says where each piece of each remaining document is packed; the others return the columns of documents.

In every stage, columns other than those of documents are dropped, also where their names clash with these in another case; an empty
table gives an empty table; texts of any length are read whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from rillwork.llm import exactdedup, languageid, mixing, neardup, packing
from rillwork.llm.frames import DOCUMENT_COLUMNS, remove, shared_folder, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; lang becomes the identified one. Null, empty and letterless texts are rejected and go.
    Repeated rows stay or go together; languages that fit alike: the first in the alphabet. Null ids and sources change nothing."""
    return languageid.keep_identified(docs).select(DOCUMENT_COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text: of rows with an even doc_id, the history, before the others, then of the least doc_id (null last), then by a
    hash of the row. An empty text equals other empty ones; null texts equal nothing and all stay."""
    return exactdedup.drop_exact_copies(docs, exactdedup.earlier_half()).select(DOCUMENT_COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one of the least doc_id; a similarity of exactly the threshold is similar. Rows with a null
    doc_id and texts without words stay; rows that share a doc_id go or stay together."""
    return neardup.keep_one_of_similar(docs).select(DOCUMENT_COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The selection by source. A null source is a source of its own; a null or empty text has no token and goes with its place; a null
    doc_id gets its place by the text. Rows that repeat doc_id share a place; ties of quotients go to the lesser source."""
    return mixing.mix_sources(docs).select(DOCUMENT_COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start_token, end_token, shard, bin, bin_offset) of each piece. A null or empty text has one row without a bin; null and
    repeated ids are carried as they are; equal lengths go by a seeded hash. The result has no column of documents but doc_id."""
    return packing.pack_documents(docs)


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("mix_sources", mix), ("pack", pack)]

#: Language ID and the local search of packing can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents. A stage's result lies in the shared folder of the session until the next one is written; the last
    one's stays, for the result reads it. The session's size of Arrow batches is as before afterwards."""
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    path = None
    try:
        for k, (name, stage) in enumerate(STAGES):
            last, path = path, f"{folder}/{k}-{name}"
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
            if last:
                remove(spark, last)
    finally:
        spark.conf.set(batch, before)
    return docs

"""The training-data pipeline: five stages over the ``documents`` table.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept
and returns a DataFrame; ``run`` writes each result to the shared checkpoint
folder as Parquet and hands the reread table to the next stage.  All stages but
the last return the columns of ``documents``.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.minhash import drop_near_duplicates
from touchline.llm.mixing import mix_sources
from touchline.llm.packing import pack_documents
from touchline.llm.pii import pseudonymise, session_key
from touchline.llm.quality import log_ratios, ngram_counts, score_documents, trusted_documents
from touchline.session import scratch_path
from touchline.sources.tables import read_table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Copies share 80 % of their runs of five words (``op6_minhash`` links from 85 % on).
COPY_PERCENT = 80


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the n-gram threshold stay."""
    trusted = trusted_documents(read_table(spark, sf_dir, "labels"))
    ratios = log_ratios(ngram_counts(docs, trusted))
    return score_documents(docs, ratios, carry=COLUMNS).where("kept").select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return drop_near_duplicates(docs, percent=COPY_PERCENT).select(*COLUMNS)


def hide_persons(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes pseudonyms under the session's key; ``n_chars`` follows the new text."""
    return pseudonymise(docs, key=session_key(spark)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight and its draw say."""
    return mix_sources(docs).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their token ids and places."""
    return pack_documents(docs, with_ids=True)


STAGES = [("quality rules", keep_quality), ("near duplicates", drop_copies), ("personal data", hide_persons),
          ("mixing", mix), ("packing", pack)]

#: Hashed n-grams, Feistel rounds and token ids have no SQL form; the stages are
#: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, os.path.join("pipeline", f"{name.replace(' ', '-')}-{uuid.uuid4().hex[:12]}"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

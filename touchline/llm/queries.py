"""The registered query of each operator of this package, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from touchline.llm.neighbours import near_vectors
    return near_vectors(read_table(spark, sf_dir, "embeddings"))


@query
def op2_quality_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    from touchline.llm.quality import rate_documents
    return rate_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from touchline.llm.pii import pseudonymise, session_key
    docs = pseudonymise(read_table(spark, sf_dir, "documents"), key=session_key(spark), found="found")
    return docs.withColumn("n_replaced", F.size("found")).withColumn("n_chars", F.length("text").cast("long")).drop("found")


@query
def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from touchline.llm.licenses import scan_licenses
    return scan_licenses(read_table(spark, sf_dir, "documents"))


@query
def op5_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from touchline.llm.extraction import extract_pages
    return extract_pages(read_table(spark, sf_dir, "pages"))


@query
def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from touchline.llm.minhash import near_duplicates
    return near_duplicates(read_table(spark, sf_dir, "documents"))


@query
def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from touchline.llm.mixing import mix_sources
    return mix_sources(read_table(spark, sf_dir, "documents")).withColumn("rate", F.round("rate", 6))


@query
def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from touchline.llm.substrings import remove_repeats
    return remove_repeats(read_table(spark, sf_dir, "documents"), digest=True)


@query
def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from touchline.llm.packing import pack_documents
    return pack_documents(read_table(spark, sf_dir, "documents"))


@query
def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from touchline.llm.sharding import shard_digest
    return shard_digest(read_table(spark, sf_dir, "documents"))


@query
def op11_align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from touchline.llm.alignment import align_digest
    return align_digest(read_table(spark, sf_dir, "documents"))


@query
def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from touchline.llm.language import identify_documents
    return identify_documents(read_table(spark, sf_dir, "documents"))


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from touchline.llm.collocations import collocations
    return collocations(read_table(spark, sf_dir, "documents"))


def _oracles():
    from touchline.llm.collocations import COLLOCATION_SQL, SUPPORT, TOP
    from touchline.llm.mixing import MIX_SQL
    ORACLES["op13_collocations"] = COLLOCATION_SQL.format(docs="documents", support=SUPPORT, top=TOP)
    ORACLES["op7_mix_sources"] = MIX_SQL.format(
        docs="documents", columns="doc_id, text, lang, source, n_chars", rate="round(rate, 6) AS rate,")


_oracles()

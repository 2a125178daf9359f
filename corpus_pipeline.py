"""The corpus pipeline: stages over `documents`, each written as Parquet and read
again as the next one's input."""

from pyspark.sql import DataFrame, SparkSession

from misheard.llm import guess_cost, mixing, near_copies, perplexity, trie_bpe
from misheard.llm.common import shared_path, table
from misheard.llm.queries import tokenizer_path


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is usual for good text of their language."""
    return perplexity.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies: fingerprints
    within two bits, as in operator 8, or five-word shingles at a Jaccard similarity
    of 0.8 or more."""
    return near_copies.keep_first(docs, fingerprints=True)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    return guess_cost.redact(docs, length_col="n_chars", words=guess_cost.learn_words(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in training order, repeated or left out by source weight."""
    return mixing.mix(docs, length_col="n_chars")


def encode_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of the mix, with the text they decode to."""
    return trie_bpe.encode(docs, trie_bpe.read_tokenizer(tokenizer_path()))


STAGES = [
    ("filter_quality", filter_quality),
    ("drop_near_duplicates", drop_near_duplicates),
    ("redact_secrets", redact_secrets),
    ("mix_sources", mix_sources),
    ("encode_documents", encode_documents),
]

# SQL cannot express the stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

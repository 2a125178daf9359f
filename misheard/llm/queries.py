"""One query per operator of this folder: (spark, folder of tables) -> DataFrame."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from misheard.llm import (
    guess_cost, licenses, mixing, multiset, perplexity, projections, repeats, simhash, spelling, tag_paths, trie_bpe,
    warc, whitening,
)
from misheard.llm.common import shared_path, table

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    """One row per document, sorted by the training position of its first copy."""
    rows = mixing.assign(table(spark, sf, "documents"), ["doc_id", "source"])
    rows = rows.select(
        "doc_id", "source", "mix.size", "mix.source_size", "mix.target", "mix.taken",
        F.when(F.size("mix.copies") > 0, F.col("mix.copies")[0]["position"]).alias("position"),
    )
    return mixing.by_position(rows, F.col("position"), F.col("doc_id"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op3_trie_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    return trie_bpe.digests(table(spark, sf, "documents"), trie_bpe.read_tokenizer(tokenizer_path()))


@query
def op8_simhash_components(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprint and component of every document."""
    rows = simhash.near_duplicates(table(spark, sf, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op7_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and spans of every document."""
    docs = table(spark, sf, "documents")
    return guess_cost.digests(docs, words=guess_cost.learn_words(docs))


@query
def op10_multiset_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Every document, its edited text and the next document compared."""
    return multiset.compare_edits(table(spark, sf, "documents"))


@query
def op2_warc_conversion(spark: SparkSession, sf: str) -> DataFrame:
    """Pages as ARC archives, converted to WARC and read back."""
    arcs, warcs = shared_path(spark, "arc"), shared_path(spark, "warc")
    warc.write_arc(table(spark, sf, "pages"), arcs)
    warc.convert(spark, arcs, warcs)
    rows = warc.read_warc(spark, warcs, payloads=False)
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op4_main_text(spark: SparkSession, sf: str) -> DataFrame:
    """The main text of every page."""
    return tag_paths.main_text(table(spark, sf, "pages"))


@query
def op6_embedding_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Links and component of every vector."""
    rows = projections.near_duplicates(table(spark, sf, "embeddings"))
    return rows.withColumn("kept", F.col("vec_id") == F.col("component_id"))


@query
def op5_perplexity_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Perplexity of every document, its limit, and whether it is kept."""
    rows = perplexity.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return rows.drop("key")


@query
def op9_repeated_passages(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of every document without repeated strings of 400 bytes."""
    return repeats.remove_repeats(table(spark, sf, "documents"))


@query
def op12_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Base places, labels and score of every document."""
    return licenses.digests(table(spark, sf, "documents"))


@query
def op11_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Every word of the corpus with its near words counted, its form and its root."""
    return spelling.variants(table(spark, sf, "documents"))


@query
def op13_feast_whitening(spark: SparkSession, sf: str) -> DataFrame:
    """Whitened components of every vector."""
    return whitening.whiten(table(spark, sf, "embeddings"))

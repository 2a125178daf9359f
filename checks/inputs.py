"""Inputs the registered queries derive from the given tables."""

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from misheard.functions.text import purify
from misheard.operators.confusion import forward_table
from misheard.operators.joins import spread
from misheard.operators.noise import corrupt
from misheard.operators.pairs import pad_pair
from misheard.plans.corpus import SENTENCE_KEY, clean_corpus

# A few confusions that start the first corruption, before any
# table is learned. (chunk, replacement, count)
SEED_CONFUSIONS = (
    ("e", "e", 8), ("e", "a", 1), ("e", "", 1), ("t", "t", 5), ("t", "d", 1),
    ("th", "th", 3), ("th", "t", 1), ("ou", "ou", 3), ("ou", "u", 1), ("ue", "ue", 2), ("ue", "e", 1),
    ("n", "n", 6), ("n", "nn", 1), ("s", "s", 5), ("s", "z", 1), ("en", "en", 4), ("en", "an", 1),
    (" ", " ", 9), (" ", "", 1), ("le ", "le ", 3), ("le ", "l'", 1), ("er", "er", 4), ("er", "re", 1),
    ("i", "i", 7), ("i", "ie", 1), ("la", "la", 2), ("la", "là", 1), ("in", "in", 3), ("in", "im", 1),
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents"), "doc_id")


def sentences(spark: SparkSession, sf: str) -> DataFrame:
    return clean_corpus(docs(spark, sf))


def seed_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*SEED_CONFUSIONS], "chunk string, replacement string, cnt long")


def noisy_pairs(spark: SparkSession, sf: str, seed: int = 7) -> DataFrame:
    """(doc_id, line_no, sent_no, ref, hyp): sentences and their corruption."""
    done = corrupt(sentences(spark, sf), SENTENCE_KEY, "sentence", seed_table(spark), seed)
    return done.select(*SENTENCE_KEY, F.col("sentence").alias("ref"), F.col("corrupted").alias("hyp"))


def part_pairs(spark: SparkSession, sf: str, seed: int = 7) -> DataFrame:
    """(p_partkey, ref, hyp): descriptions of parts and their corruption; short
    enough for SQL to spell out every alignment."""
    name = F.lower(F.concat_ws(" ", "p_name", "p_type", "p_brand"))
    parts = spread(table(spark, sf, "part"), "p_partkey").select("p_partkey", name.alias("ref"))
    done = corrupt(parts, ["p_partkey"], "ref", seed_table(spark), seed)
    return done.withColumnRenamed("corrupted", "hyp")


def part_clips(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, test, predicted): every part is a clip, small ones are the test split;
    the recogniser hears the corrupted description."""
    size = table(spark, sf, "part").select("p_partkey", "p_size")
    path = F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("path")
    rows = part_pairs(spark, sf).join(size, "p_partkey").select(
        path, F.col("ref").alias("sentence"), F.col("p_partkey").alias("src_row"), purify(F.col("hyp")).alias("predicted"),
        (F.col("p_size") <= 25).alias("small"),
    )
    train, test = (rows.where(c).select("path", "sentence", "src_row") for c in ("not small", "small"))
    return train, test, rows.select("path", "predicted")


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """(conv_id, turn, ref, hyp): each turn with the next one, cleaned. Mostly
    unrelated texts of different lengths."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = spread(table(spark, sf, "conversations"), "conv_id").select("conv_id", "turn", purify(F.col("text")).alias("ref"))
    return c.withColumn("hyp", F.lead("ref").over(w)).where(F.col("hyp").isNotNull())


def padded_turns(spark: SparkSession, sf: str) -> DataFrame:
    ref, hyp = pad_pair(F.col("ref"), F.col("hyp"))
    return turns(spark, sf).select("conv_id", "turn", ref.alias("ref_aln"), hyp.alias("hyp_aln"))


def turn_confusions(spark: SparkSession, sf: str) -> DataFrame:
    """A confusion table both engines can build: chunks at the same place."""
    return forward_table(padded_turns(spark, sf)).persist()


def _clip_path() -> F.Column:
    return F.concat(F.lit("clip_"), F.col("doc_id").cast("string"), F.lit(".mp3"))


def clips(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(train, test) clip tables: labelled documents, split by quality. Documents
    marked toxic are listed in both splits, with another text in train."""
    l = table(spark, sf, "labels").join(docs(spark, sf).select("doc_id", "text", "source"), "doc_id")
    row = l.select(_clip_path().alias("path"), F.col("text").alias("sentence"), F.col("doc_id").alias("src_row"),
                   "quality", "toxic", "source")
    test = row.where((F.col("quality") == 0) | (F.col("toxic") == 1)).select("path", "sentence", "src_row")
    train = row.where(F.col("quality") == 1).select(
        "path", F.when(F.col("toxic") == 1, F.col("source")).otherwise(F.col("sentence")).alias("sentence"), "src_row"
    )
    return train, test


def all_clips(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a clip; unlabelled ones are unknown to the splits."""
    return docs(spark, sf).select(_clip_path().alias("path"))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """A stand-in recogniser that mishears a few letters."""
    return docs(spark, sf).select(
        _clip_path().alias("path"),
        F.replace(F.translate(purify(F.col("text")), "eu", "ao"), F.lit("th "), F.lit("t")).alias("predicted"),
    )


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Clips of good documents count as recognised already."""
    return table(spark, sf, "labels").where(F.col("quality") == 1).select(
        F.lit("recognise").alias("stage"), _clip_path().alias("key")
    )


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as frames of scores; the label names the clip."""
    return table(spark, sf, "embeddings").select(
        F.concat(F.lit("clip_"), F.col("label").cast("string")).alias("path"),
        F.col("vec_id").alias("frame_no"),
        F.col("embedding").cast("array<double>").alias("frame"),
    )

"""Character tokenizer: specials take ids 1..4, characters follow from 5."""

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from misheard import constants as K
from misheard.functions.text import chars, with_markers
from misheard.operators.joins import BROADCAST_ROWS, by_key, map_elements, require_strings


def char_vocabulary(df: DataFrame, text: str) -> DataFrame:
    """(token, id) of all characters of a column, ordered by character."""
    require_strings(df, text)
    spark: SparkSession = df.sparkSession
    found = df.select(F.explode(chars(F.col(text))).alias("token")).distinct()
    # one ordered task, over at most as many rows as there are code points
    numbered = found.select(
        "token", (F.row_number().over(Window.orderBy("token")) + K.FIRST_CHAR_ID - 1).cast("int").alias("id")
    )
    specials = spark.createDataFrame([*K.CHAR_SPECIALS], "token string, id int")
    return specials.unionByName(numbered)


def vocabulary_size(vocabulary: DataFrame) -> DataFrame:
    return vocabulary.agg(F.count(F.lit(1)).alias("size"))


def char_tokens(df: DataFrame, text: str, out: str = "tokens") -> DataFrame:
    """All characters between start and end marker, as strings."""
    return df.withColumn(out, with_markers(chars(F.col(text))))


def char_ids(
    df: DataFrame, keys: list[str], text: str, vocabulary: DataFrame, out: str = "ids", max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Ids of the known characters between start and end id; others drop out."""
    require_strings(df, text)
    rows = by_key(df.select(*keys, text), keys).select(*keys, chars(F.col(text)).alias("_c"))
    ids = map_elements(rows, keys, "_c", "token", vocabulary, "inner", F.col("id"), out, max_rows=max_rows)
    start, end = (F.lit(dict(K.CHAR_SPECIALS)[t]) for t in (K.START, K.END))
    return ids.withColumn(out, F.concat(F.array(start), out, F.array(end)))


def tokens_of_ids(
    df: DataFrame, keys: list[str], ids: str, vocabulary: DataFrame, out: str = "tokens",
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Tokens of the known ids, in order; unknown ids drop out."""
    rows = by_key(df.select(*keys, ids), keys)
    return map_elements(rows, keys, ids, "id", vocabulary, "inner", F.col("token"), out, max_rows=max_rows)


def ids_with_buckets(
    df: DataFrame,
    keys: list[str],
    tokens: str,
    vocabulary: DataFrame,
    buckets: int = K.OOV_BUCKETS_CHAR,
    out: str = "ids",
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Ids of tokens; an unknown token gets one of `buckets` ids after the
    vocabulary, chosen by a digest of the token."""
    rows = by_key(df.select(*keys, tokens), keys)
    size = vocabulary.agg(F.count(F.lit(1)).alias("_size"))
    sized = vocabulary.select("token", "id")
    oov = F.conv(F.substr(F.md5(F.col("token").cast("binary")), F.lit(1), F.lit(8)), 16, 10).cast("long")
    # negative numbers mark the bucket until the size, one row, is known
    marked = map_elements(
        rows, keys, tokens, "token", sized, "left",
        F.coalesce(F.col("id").cast("long"), -1 - F.pmod(oov, F.lit(buckets))), out, max_rows=max_rows,
    )
    n = F.col("_size")
    return (
        marked.withColumn("_size", size.scalar())
        .withColumn(out, F.transform(out, lambda i: F.when(i < 0, n - 1 - i).otherwise(i)))
        .drop("_size")
    )

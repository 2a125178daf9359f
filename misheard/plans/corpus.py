"""From raw texts to clean sentences."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from misheard import constants as K
from misheard.functions.text import long_enough, purify, sentences, words
from misheard.operators.joins import union_all
from misheard.sources.text import lines_of

SENTENCE_KEY = ["doc_id", "line_no", "sent_no"]


def sentences_of(lines: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """(keys, sent_no, sentence), sentences as they stand."""
    return lines.select(*keys, F.posexplode(sentences(F.col(line))).alias("sent_no", "sentence"))


def clean_lines(lines: DataFrame, keys: list[str], line: str = "line") -> DataFrame:
    """Split into sentences, clean them, keep those with enough words. One scan
    stage, no shuffle."""
    cleaned = sentences_of(lines, keys, line).withColumn("sentence", purify(F.col("sentence")))
    return cleaned.where(long_enough(words(F.col("sentence"))))


def clean_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, sent_no, sentence) of a table of texts."""
    return clean_lines(lines_of(docs, key, text), [key, "line_no"])


def corpora(*dfs: DataFrame) -> DataFrame:
    """Several corpora as one; copies stay."""
    return union_all(*dfs)


_BUCKETS = 2048


def _cut_value(df: DataFrame, key: str, n: int) -> tuple | None:
    """(v, below): the value of an integer key where the first n rows end, and
    the rows with smaller values. Narrows a range of values by counts per
    bucket, so no row is sorted or moved."""
    lo, hi, rows, known = df.agg(F.min(key), F.max(key), F.count(F.lit(1)), F.count(key)).first()
    if known < rows:
        raise ValueError(f"{rows - known} rows have no {key}, so they have no place in the order")
    if rows <= n:
        return None
    below = 0
    while lo < hi:
        width = -(-(hi - lo + 1) // _BUCKETS)
        bucket = F.floor((F.col(key) - F.lit(lo)) / F.lit(width)).cast("long")
        counts = dict(
            df.where(F.col(key).between(lo, hi)).groupBy(bucket.alias("b")).count().collect()   # <= _BUCKETS rows
        )
        for b in sorted(counts):
            if below + counts[b] >= n:
                break
            below += counts[b]
        lo, hi = lo + b * width, min(hi, lo + (b + 1) * width - 1)
    return lo, below


def head(df: DataFrame, keys: list[str], n: int = K.SMALL_CORPUS_LINES) -> DataFrame:
    """The first n rows in the order of integer keys, as a filter on them: the
    rows stay in place and the bounds reach the scan."""
    if n <= 0:
        return df.limit(0)
    taken: list[Column] = []
    fixed: list[Column] = []
    inside = df
    for key in keys:
        cut = _cut_value(inside, key, n)
        if cut is None:
            return df.where(reduce(Column.__or__, [*taken, reduce(Column.__and__, fixed)])) if fixed else df
        value, below = cut
        taken.append(reduce(Column.__and__, [*fixed, F.col(key) < value]))
        fixed.append(F.col(key) == value)
        n -= below
        inside = df.where(reduce(Column.__and__, fixed))
    # rows equal in all keys: any n of them
    return df.where(reduce(Column.__or__, taken)).unionByName(inside.limit(n))

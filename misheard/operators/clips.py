"""Clip metadata (path, sentence), recognised text, and the done-ledger.

Clip tables have one row per file row; `src_row` is its position, which decides
which of several rows of one path counts (the first).
"""

from pyspark.sql import Column, DataFrame, functions as F

from misheard.functions.text import is_audio, purify


def with_splits(train: DataFrame, test: DataFrame) -> DataFrame:
    return test.withColumn("split", F.lit("test")).unionByName(train.withColumn("split", F.lit("train")))


def actual_sentences(train: DataFrame, test: DataFrame, clean=purify) -> DataFrame:
    """One cleaned sentence per path: test wins over train, then the first row.
    Copies of one path are reduced before the shuffle."""
    first = F.struct((F.col("split") != "test").alias("t"), F.col("src_row"))
    return (
        with_splits(train, test)
        .groupBy("path")
        .agg(F.min_by(F.struct("sentence", "split"), first).alias("_s"))
        .select("path", "_s.split", clean(F.col("_s.sentence")).alias("sentence"))
    )


def sentence_of(
    clips: DataFrame, train: DataFrame, test: DataFrame, clean=purify, strict: bool = False
) -> DataFrame:
    """Sentence of each asked clip. Unknown clips drop out; with strict=True one
    raises while the query runs."""
    actual = actual_sentences(train, test, clean)
    if not strict:
        return clips.join(actual, "path", "inner")
    return _require(clips.join(actual, "path", "left"), F.col("split").isNotNull(), "clip does not exist: ", "path")


def classify(clips: DataFrame, train: DataFrame, test: DataFrame, strict: bool = True) -> DataFrame:
    """Add `is_test`. An unknown clip raises while the query runs; with
    strict=False it gets null."""
    side = (
        with_splits(train.select("path"), test.select("path"))
        .groupBy("path")
        .agg(F.max(F.col("split") == "test").alias("is_test"))
    )
    joined = clips.join(side, "path", "left")
    return _require(joined, F.col("is_test").isNotNull(), "clip does not exist: ", "path") if strict else joined


def unknown_clips(clips: DataFrame, train: DataFrame, test: DataFrame) -> DataFrame:
    known = train.select("path").unionByName(test.select("path"))
    return clips.join(known, "path", "left_anti")


def _require(df: DataFrame, ok: Column, message: str, key: str) -> DataFrame:
    text = F.concat(F.lit(message), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    return df.where(F.when(ok, True).otherwise(F.raise_error(text).cast("boolean")))


def evaluation_pairs(actual: DataFrame, predicted: DataFrame, strict: bool = True) -> DataFrame:
    """(path, ref, hyp): one pair per row of `actual`, however often a path is
    listed or recognised (the smallest text counts). With strict=True a clip
    missing on one side raises; else it drops out."""
    ref = actual.select("path", F.col("sentence").alias("ref"))
    hyp = one_per_path(predicted).select("path", F.col("predicted").alias("hyp"))
    if not strict:
        return ref.join(hyp, "path", "inner")
    both = ref.join(hyp, "path", "full_outer")
    return _require(both, F.col("ref").isNotNull() & F.col("hyp").isNotNull(), "clip without partner: ", "path")


def one_per_path(predicted: DataFrame) -> DataFrame:
    return predicted.groupBy("path").agg(F.min("predicted").alias("predicted"))


def unmatched(actual: DataFrame, predicted: DataFrame) -> DataFrame:
    """Clips present on one side only, with that side."""
    left = actual.select("path").distinct().withColumn("a", F.lit(True))
    right = predicted.select("path").distinct().withColumn("p", F.lit(True))
    return (
        left.join(right, "path", "full_outer")
        .where(F.col("a").isNull() | F.col("p").isNull())
        .select("path", F.when(F.col("a").isNull(), "predicted").otherwise("actual").alias("only_in"))
    )


def done_keys(ledger: DataFrame, stage: str) -> DataFrame:
    return ledger.where(F.col("stage") == stage).select("key").distinct()


def processed(df: DataFrame, ledger: DataFrame, stage: str, key: str = "path", strict: bool = True) -> DataFrame:
    """Rows whose key is done. With strict=True a key that is not done raises."""
    done = done_keys(ledger, stage)
    if not strict:
        return df.join(done, df[key] == done["key"], "left_semi")
    marked = df.join(done, df[key] == done["key"], "left")
    return _require(marked, F.col("key").isNotNull(), "not processed yet: ", key).drop("key")


def pending(df: DataFrame, ledger: DataFrame, stage: str, key: str = "path") -> DataFrame:
    """Rows whose key is not done yet."""
    done = done_keys(ledger, stage)
    return df.join(done, df[key] == done["key"], "left_anti")


def pending_audio(clips: DataFrame, ledger: DataFrame, stage: str) -> DataFrame:
    return pending(clips.where(is_audio(F.col("path"))), ledger, stage)


def by_split(train: DataFrame, test: DataFrame, mode: str) -> DataFrame:
    """Cleaned sentences of one split; one row per listed clip."""
    if mode not in ("train", "test"):
        raise ValueError("mode is 'train' or 'test'")
    listed = (test if mode == "test" else train).select("path")
    return listed.join(actual_sentences(train, test).select("path", "sentence"), "path", "inner")


def clip_list(clips: DataFrame) -> DataFrame:
    return clips.select("path")


def predictions_of_test(test: DataFrame, predicted: DataFrame, strict: bool = False) -> DataFrame:
    """The recognised text of every listed clip of the test split. Clips that are
    not recognised drop out; with strict=True one raises while the query runs."""
    if not strict:
        return test.select("path").join(predicted, "path", "inner")
    known = test.select("path").join(predicted.withColumn("_known", F.lit(True)), "path", "left")
    return _require(known, F.col("_known").isNotNull(), "not processed yet: ", "path").drop("_known")


def train_sentences(train: DataFrame) -> DataFrame:
    return train.select("path", purify(F.col("sentence")).alias("sentence"))

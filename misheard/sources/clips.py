"""Clip metadata and the per-clip side files of a recogniser."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from misheard import constants as K
from misheard.operators.ctc import keep_symbol_scores


def read_clip_table(spark: SparkSession, path: str) -> DataFrame:
    """(path, sentence, src_row) of a tab-separated file with a header."""
    raw = spark.read.csv(path, sep="\t", header=True, escape='"')
    return raw.select("path", "sentence", F.monotonically_increasing_id().alias("src_row"))


def _clip(ext: str) -> Column:
    name = F.col("_metadata.file_name")
    return F.substr(name, F.lit(1), F.length(name) - len(ext)).alias("path")


def read_predictions(spark: SparkSession, directory: str) -> DataFrame:
    """(path, predicted): first line of every clip's text file."""
    raw = spark.read.text(directory, wholetext=True, pathGlobFilter="*" + K.PREDICTION_EXT)
    return raw.select(_clip(K.PREDICTION_EXT), F.split("value", "\n")[0].alias("predicted"))


def read_vectors(spark: SparkSession, directory: str) -> DataFrame:
    """(path, vector) of raw little-endian float64 files."""

    @F.pandas_udf("array<double>")
    def doubles(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda b: np.frombuffer(b, "<f8"))

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*" + K.VECTOR_EXT).load(directory)
    return raw.select(_clip(K.VECTOR_EXT), doubles("content").alias("vector"))


def read_logits(spark: SparkSession, directory: str) -> DataFrame:
    """(path, frame_no, scores): comma-separated frames, cut down to the blank
    and the alphabet."""
    raw = spark.read.text(directory, wholetext=True, pathGlobFilter="*" + K.LOGITS_EXT)
    rows = raw.select(_clip(K.LOGITS_EXT), F.posexplode(F.split("value", "\n")).alias("frame_no", "_row"))
    scores = F.split("_row", ",").cast("array<double>")
    return rows.where(F.trim("_row") != "").select("path", "frame_no", keep_symbol_scores(scores).alias("scores"))


def write_by_split(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Predictions, vectors or scores as parquet, one folder per split."""
    df.write.mode(mode).partitionBy("split").parquet(path)

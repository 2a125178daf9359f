"""Text corpora."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from misheard import constants as K
from misheard.functions.text import lines
from misheard.operators.joins import require_strings


def set_split_size(spark: SparkSession, size: int = K.INPUT_SPLIT_BYTES) -> None:
    """Bytes of input per task, for jobs that do much work per byte."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_id, line) of text files. Ids grow in file order; they depend on how
    the input is split, so write them down once when they are used as keys."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_id"), F.col("value").alias("line"))


def lines_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, line) of a table of texts; empty texts have no lines."""
    require_strings(docs, text)
    return docs.where(F.length(text) > 0).select(key, F.posexplode(lines(F.col(text))).alias("line_no", "line"))


def write_lines(df: DataFrame, path: str, line: str, order_by: list[str] = (), single_file: bool = False) -> None:
    """Overwrite `path` with one line per row. With `order_by`, part files in
    name order hold the sorted lines. `single_file` puts them into one file
    through one task: for exports of modest size."""
    out = df.orderBy(*order_by) if order_by else df
    out = out.select(F.col(line).alias("value"))
    (out.coalesce(1) if single_file else out).write.mode("overwrite").text(path)


def append_lines(df: DataFrame, path: str, line: str) -> None:
    df.select(F.col(line).alias("value")).write.mode("append").text(path)

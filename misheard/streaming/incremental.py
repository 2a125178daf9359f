"""Process only new input files: the file source's checkpoint is the record of
finished ones. All cleaning steps are stateless, so no state is kept."""

from pyspark.sql import SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from misheard.plans.corpus import clean_corpus


def clean_new_files(
    spark: SparkSession, source: str, target: str, checkpoint: str, files_per_batch: int = 1000
) -> StreamingQuery:
    """Clean sentences of the text files that arrived since the last run, keyed
    by file path, line, and sentence. A file is read whole to number its lines."""
    files = spark.readStream.option("maxFilesPerTrigger", files_per_batch).option("wholetext", True).text(source)
    return (
        clean_corpus(files.select(F.col("_metadata.file_path").alias("file"), "value"), "file", "value")
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(target)
    )

"""Which keys of which stage are done."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from misheard.operators.clips import pending

LEDGER = "stage string, key string, done_at timestamp"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger table; empty while nothing was recorded."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path)


def record_done(keys: DataFrame, path: str, stage: str, key: str = "path") -> None:
    keys.select(F.lit(stage).alias("stage"), F.col(key).cast("string").alias("key"), F.current_timestamp().alias("done_at")).write.mode(
        "append"
    ).parquet(path)


def resume(
    df: DataFrame,
    ledger_path: str,
    stage: str,
    process: Callable[[DataFrame], DataFrame],
    output: str,
    key: str = "path",
) -> None:
    """Process the keys not done yet, append the outcome, then record them.

    Keys are recorded from the written outcome. A run that dies in between
    writes its keys again next time, so each run gets its own folder.
    """
    spark = df.sparkSession
    ledger = read_ledger(spark, ledger_path)
    run = ledger.where(F.col("stage") == stage).select("done_at").distinct().count()
    target = f"{output}/run={run}"
    process(pending(df, ledger, stage, key)).write.mode("overwrite").parquet(target)
    record_done(spark.read.parquet(target).select(key).distinct(), ledger_path, stage, key)

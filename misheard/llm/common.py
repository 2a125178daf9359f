"""Helpers shared by the operators of this folder."""

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from misheard.operators.joins import BROADCAST_ROWS, checkpoint_dir, is_small, spread_join

# Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the rows do not have yet, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and go on from there, so a
    lost executor costs no recomputation. Eager."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def attach(
    left: DataFrame, right: DataFrame, on: list[str], rows: str, salt_by: list[str], how: str = "inner",
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join (inner or left) to a table with one row per key that is cut from its lineage:
    broadcast if it counts at most `max_rows`, else shuffled with hot keys spread by the
    `salt_by` columns. `rows` is its column with the left rows of each key."""
    if is_small(right, max_rows):
        return left.join(F.broadcast(right), on, how)
    return spread_join(left, right, on, how, salt_by, left_rows=rows)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def parts_for(df: DataFrame, size: Column, per_part: int) -> int:
    """How many partitions keep each near `per_part` of the summed size; at
    least the session's shuffle partitions."""
    total = df.agg(F.sum(size)).first()[0] or 0
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-int(total) // per_part))


def map_arrow(
    df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, rows: int | None = None
) -> DataFrame:
    """Map record batches one by one, in slices of at most `rows` if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = rows or max(batch.num_rows, 1)
            for k in range(0, batch.num_rows, size):
                out = step(batch.slice(k, size))
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)

"""Joins that hold when one key carries a large part of all rows."""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# A table is broadcast only after its rows were counted and found below this.
BROADCAST_ROWS = 200_000
# Rows of one key that a single task may take in a shuffled join.
HEAVY_ROWS = 2_000_000


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True when the table has at most `max_rows` rows. Only partial counts are
    shuffled; a limit would first gather its rows from every partition."""
    return df.count() <= max_rows


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str,
    salt_by: list[str],
    max_rows: int = BROADCAST_ROWS,
    heavy_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """Join to a table with one row per key: broadcast when it is counted to be
    small, else a shuffled join with heavy keys spread (`spread_join`)."""
    if is_small(right, max_rows):
        return left.join(F.broadcast(right), on, how)
    return spread_join(left, right, on, how, salt_by, heavy_rows)


def spread_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str,
    salt_by: list[str],
    heavy_rows: int = HEAVY_ROWS,
    left_rows: str | None = None,
) -> DataFrame:
    """Shuffled join to a table with one row per key (`how`: inner, left,
    left_semi, left_anti).

    Keys with more than `heavy_rows` left rows are counted first (partial sums
    before the shuffle; at most rows/heavy_rows of them exist). Their left rows
    are spread over several tasks by a hash of `salt_by`, a row identity, so a
    rerun task places them alike; only their right rows are copied. `left_rows`
    names a column of `right` that already holds the left rows of each key.
    """
    counted = (
        left.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
        if left_rows is None
        else right.select(*on, F.col(left_rows).alias("_n"))
    )
    heavy = (
        counted.where(F.col("_n") > heavy_rows)
        .select(*on, F.ceil(F.col("_n") / F.lit(float(heavy_rows))).cast("int").alias("_salts"))
    )
    # few keys as a rule: counted once, and broadcast only if they are few indeed
    checkpoint_dir(left.sparkSession)
    heavy = heavy.checkpoint()
    few = heavy.count()
    if not few:
        return left.join(right, on, how)
    heavy = F.broadcast(heavy) if few <= BROADCAST_ROWS else heavy
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    row = F.xxhash64(*salt_by)
    no_key = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])
    spread = left.join(heavy, on, "left").withColumn(
        # rows without a key match nothing and need no copies: spread them freely
        "_salt", F.pmod(row, F.when(no_key, F.lit(4096)).otherwise(salts)).cast("int")
    ).drop("_salts")
    copies = right.join(heavy, on, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), salts - 1))
    ).drop("_salts")
    return spread.join(copies, [*on, "_salt"], how).drop("_salt")


def map_elements(
    df: DataFrame,
    keys: list[str],
    array: str,
    element: str,
    table: DataFrame,
    how: str,
    value: Column,
    out: str,
    carry: list[str] = (),
    extra: dict[str, Column] | None = None,
    max_rows: int = BROADCAST_ROWS,
    then: Callable[[DataFrame], DataFrame] = lambda joined: joined,
) -> DataFrame:
    """Look up every element of an array column and put the values back in order.

    `table` has one row per `element`; `value` is the column computed after the
    join, from its columns, `_pos`, the `extra` columns and those that `then` adds. `how='inner'` drops unknown elements, 'left' keeps them. `keys`
    must be unique per row. When `df` comes partitioned by them (`by_key`), the
    elements are grouped back without a shuffle as long as the table is small.
    `carry` columns ride on the first element.
    """
    exploded = df.select(*keys, *carry, F.posexplode_outer(array).alias("_pos", element)).select(
        *keys,
        *[F.when(F.coalesce(F.col("_pos"), F.lit(0)) == 0, F.col(c)).alias(c) for c in carry],
        "_pos",
        element,
    )
    known = table.withColumn("_known", F.lit(True))
    joined = lookup_join(exploded, known, [element], "left", [*keys, "_pos"], max_rows)
    if extra:
        joined = joined.withColumns(extra)
    joined = then(joined)
    wanted = F.col("_known") if how == "inner" else F.col("_pos").isNotNull()
    # only the value goes on: wide columns of the table stay out of the grouping
    valued = joined.select(*keys, *carry, F.when(wanted, F.struct(F.col("_pos"), value.alias("_v"))).alias("_item"))
    return valued.groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in carry],
        F.transform(F.sort_array(F.collect_list("_item")), lambda x: x["_v"]).alias(out),
    )


def by_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """Spread compact rows by their key before they are exploded. The number of
    partitions is named, as rows are about to grow many times and a size-based
    merge of small partitions would leave too few tasks; it grows with the
    splits of the input."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())
    return df.repartition(n, *[F.col(k) for k in keys])


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread an input that comes in fewer splits than there are task slots, so
    that work done per row is not left to a few tasks; else leave it alone."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= slots:
        return df
    return df.repartition(slots, *[F.col(k) for k in keys])


def checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; a temporary one only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        import tempfile

        shared = tempfile.mkdtemp(prefix="checkpoint-")
    sc.setCheckpointDir(shared)


def union_all(*dfs: DataFrame) -> DataFrame:
    """Bag union by column name."""
    return reduce(lambda a, b: a.unionByName(b), dfs)


def require_strings(df: DataFrame, *columns: str) -> DataFrame:
    """Check at the boundary of an operator that the columns are strings."""
    types = dict(df.dtypes)
    wrong = [f"{c}: {types.get(c, 'missing')}" for c in columns if types.get(c) != "string"]
    if wrong:
        raise TypeError("string columns expected, got " + ", ".join(wrong))
    return df

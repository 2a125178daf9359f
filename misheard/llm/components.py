"""Connected components of a link table by repeated random contraction."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from misheard.llm.common import cut, shared_path

# Links that one task takes of a round, or unites at the end; fewer links lie in fewer parts.
LINKS_PER_PART = 200_000


def _written(df: DataFrame) -> DataFrame:
    """The rows, read from files again. Unlike a checkpoint these do not carry on the size that
    Spark foretells: a join multiplies the sizes of its sides, and over rounds that number
    itself would fill the driver."""
    path = shared_path(df.sparkSession, "links")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all links (a, b) of a task; root is the smallest node."""
    ends = [np.concatenate([np.asarray(x.column(0)), np.asarray(x.column(1))]).reshape(2, -1) for x in batches]
    if not ends:
        return
    nodes, links = np.unique(np.concatenate(ends, axis=1), return_inverse=True)
    up = list(range(len(nodes)))
    for x, y in links.reshape(2, -1).T.tolist():
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        up[max(x, y)] = min(x, y)
    for i, x in enumerate(up):
        up[i] = up[x]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[up])], names=["node", "root"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b), cut from its lineage; root is the
    same node for all of a component and one of its nodes.

    While there are more than `LINKS_PER_PART` links, a round gives every node the smallest member of
    its closed neighbourhood in a fresh random order and moves the links to these
    representatives; an expected constant part of the nodes goes each round, whatever the shape.
    What is left is united by one task. Only minima per node are aggregated, so a node with very
    many links is no burden; the joins are sorted ones, whose large keys Spark splits at run time
    and of which the driver holds nothing. The number of the round is a column, so all rounds run
    the same generated code, and the links of a round lie in as many parts as their number
    asks for. The maps of the rounds are joined together at the end, last first.
    """
    edges = cut(
        links.where(F.col("a") != F.col("b"))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(0).alias("round"))
        .distinct()
    )
    maps = []
    rank = lambda c: F.struct(F.xxhash64(F.col(c), "round").alias("h"), F.col(c).alias("v"))
    while (n := edges.count()) > LINKS_PER_PART:
        edges = edges.coalesce(-(-n // LINKS_PER_PART))
        turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "round")
        step = edges.select("a", "b", "round").unionByName(turned).groupBy(F.col("a").alias("node"), "round")
        step = step.agg(F.min(rank("b")).alias("m"))
        step = cut(step.select("node", F.least(F.col("m"), rank("node"))["v"].alias("root")))
        step = step.coalesce(-(-2 * n // LINKS_PER_PART))
        maps.append(step)
        left = step.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = _written(
            edges.join(left.hint("merge"), "a").join(right.hint("merge"), "b").where("ra != rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"), (F.col("round") + 1).alias("round"))
            .distinct()
        )
    # callers use the outcome more than once, so it never stands for the plan that makes it
    final = cut(edges.select("a", "b").coalesce(1).mapInArrow(_united, "node long, root long"))
    if not maps:
        return final
    for step in maps[::-1]:
        later = final.select(F.col("node").alias("root"), F.col("root").alias("_final"))
        final = step.join(later.hint("merge"), "root", "left").select("node", F.coalesce("_final", "root").alias("root"))
    return cut(final)

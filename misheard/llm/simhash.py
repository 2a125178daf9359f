"""SimHash near-duplicates by deletion-variant signatures.

The 64-bit fingerprint is cut into two segments, so of two fingerprints that
differ in at most two bits one segment differs in at most one. Every segment is
indexed under its 32 variants with one bit left open; fingerprints with an equal
variant are candidates and are verified.

Distinct fingerprints stand for all their documents. A variant shared by more
than `group_rows` fingerprints is not paired up: its members are indexed once
more under the fingerprint with two bits left open. Whoever shares such a key
differs in these two bits at most, so each is linked to the smallest one.

A text of fewer words than a shingle is one shingle; null and empty texts have
fingerprint zero and are linked like any other. Rows that repeat an id are
linked like copies; a null id is never the smallest unless all are null.
"""

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from misheard.llm.common import attach, cut, free_name, map_arrow
from misheard.llm.components import components
from misheard.operators.joins import is_small, spread_join

SHINGLE_WORDS = 3
SEED = 42
GROUP_ROWS = 64
_SLICE = 1 << 16


def fingerprint(text: bytes | None, size: int = SHINGLE_WORDS) -> int:
    """Majority bits of the hashes of all shingles, as an unsigned integer."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    ends = [s - 1 for s in starts[min(size, len(words)) :]]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for k in range(0, len(ends), _SLICE):
        part = [digest(line[s:e], SEED) for s, e in zip(starts[k : k + _SLICE], ends[k : k + _SLICE])]
        bits = np.unpackbits(np.array(part, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(ends)).tobytes(), "big")


def fingerprints(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The `keep` columns and fp, the 64 bits as a signed long."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t.as_py()) for t in batch.column(0)], np.uint64)
        return pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found.view(np.int64))], names=[*keep, "fp"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return map_arrow(docs.select(F.col(text_col).cast("binary").alias("_text"), *keep), step, f"{kinds}, fp long")


def _without(fp: Column, *bits: Column) -> Column:
    for bit in bits:
        fp = fp.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), bit)))
    return fp


def links(fps: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(a, b): links between distinct fingerprints `fp` that connect all those
    within two bits of each other."""
    # bits 0..31 are the lower segment; the other one is dropped from the key
    own = F.when(F.col("bit") < 32, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(
        F.shiftrightunsigned("fp", 32)
    )
    keyed = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit")).select(
        "fp", "bit",
        F.shiftleft(F.col("bit").cast("long"), 32).bitwiseOR(_without(own, F.col("bit") % 32)).alias("key"),
    )
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = cut(keyed.join(shared, "key"))

    small = met.where(F.col("n") <= group_rows).select("key", "fp")
    pairs = (
        small.select("key", F.col("fp").alias("a")).join(small.select("key", F.col("fp").alias("b")), "key")
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2))
        .select("a", "b").distinct()
    )

    # the open bit with one of the other segment; and, once for all open bits of
    # a segment, two of the other segment
    large = met.where(F.col("n") > group_rows)
    other = F.when(F.col("bit") < 32, F.lit(32)).otherwise(F.lit(0))
    one = large.select(
        "fp", F.col("bit").alias("i"), F.explode(F.sequence(other, other + 31)).alias("j")
    )
    two = (
        large.where(F.col("bit") % 32 == 0)
        .select("fp", other.alias("o"), F.explode(F.sequence(F.lit(0), F.lit(31))).alias("i"))
        .select("fp", "o", "i", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("j"))
        .where("i < j").select("fp", (F.col("o") + F.col("i")).alias("i"), (F.col("o") + F.col("j")).alias("j"))
    )
    open2 = one.unionByName(two).select(
        "fp", (F.least("i", "j") * 64 + F.greatest("i", "j")).alias("bits"),
        _without(F.col("fp"), F.col("i"), F.col("j")).alias("rest"),
    )
    least = open2.groupBy("bits", "rest").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    stars = open2.join(least, ["bits", "rest"]).where("fp != b").select(F.col("fp").alias("a"), "b").distinct()
    return pairs.unionByName(stars)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_rows: int = GROUP_ROWS,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """(id, fp, component_id) and the `keep` columns: component_id is the smallest
    id that is reachable over fingerprints within two bits of each other; root
    is one fingerprint for all of a component."""
    rows = cut(fingerprints(docs, [id_col, *keep], text_col))
    fps = cut(rows.groupBy("fp").agg(F.min(id_col).alias("least"), F.count(F.lit(1)).alias("n")))
    roots = components(links(fps.select("fp"), group_rows))
    rooted = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(rooted.join(smallest, "root").select("fp", "n", "root", "component_id"))
    found = attach(rows, named, ["fp"], "n", [id_col, *keep])
    return found.select(id_col, *keep, "fp", "root", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each group of near copies: that of the smallest id
    (null last), of equal ids the one with the smallest digest of all columns."""
    row = free_name(docs, "_row")
    keyed = docs.withColumn(row, F.xxhash64(*docs.columns))
    found = near_duplicates(keyed, id_col, text_col, keep=(row,))
    found = cut(found.select("root", F.col(id_col).alias("id"), F.col(row).alias("_row")))
    return first_of_groups(keyed, found, row, id_col)


def first_of_groups(keyed: DataFrame, found: DataFrame, row: str, id_col: str) -> DataFrame:
    """The first row of each group of `found` (root, id, _row), without the column
    `row` by which the rows of `keyed` are told apart."""
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("_row"))
    first = found.groupBy("root").agg(F.min(order)["_row"].alias("_row"))
    rows = found.groupBy("_row").agg(F.count(F.lit(1)).alias("_n"))
    rows = cut(rows.join(first.withColumn("_first", F.lit(True)), "_row", "left"))
    dropped = rows.where("_first is null").select(F.col("_row").alias(row), "_n")
    if is_small(dropped):
        kept = keyed.join(F.broadcast(dropped), row, "left_anti")
    else:
        kept = spread_join(keyed, dropped, [row], "left_anti", [id_col], left_rows="_n")
    if not rows.where("_first and _n > 1").isEmpty():
        kept = kept.dropDuplicates([row])    # a first row that is repeated as it is
    return kept.drop(row)

"""Order-independent document fingerprints: a homomorphic multiset hash.

Every paragraph is hashed to a wide vector of +1 and -1; a document's
fingerprint is the sum of the vectors of its paragraphs, lane by lane, modulo
2^16. The sum does not depend on the order of paragraphs, and one is inserted or
deleted by adding or subtracting its vector. Lines are paragraphs; a line is cut
further at its sentence and clause ends, so that short documents have parts too.

The squared length of a difference of two fingerprints, per lane, estimates how
many paragraphs (by multiplicity) the documents do not share; set against their
own squared lengths it gives a likeness in 0..1.

Null and empty texts have no paragraphs: fingerprint zero, likeness 1 to each
other and 0 to others. Ids may be null, repeat, and be of any type: integers are
ordered as such, others as strings by code point. Empty tables give no rows; other
columns, clashing names too, are not read.
"""

import hashlib
import re
from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from misheard.llm.common import cut

LANES = 128
_PART = re.compile(r"[^\n.!?;:,|]+[\n.!?;:,|]*|[\n.!?;:,|]+")
_SLICE = 1 << 14


def paragraphs(text: str | None) -> list[str]:
    parts = map(str.strip, _PART.findall(text or ""))
    return [p for p in parts if p]


def vector(parts: list[str]) -> np.ndarray:
    """The sum of the parts' vectors modulo 2^16, as unsigned 16-bit lanes."""
    total = np.zeros(LANES, np.int64)
    digest = xxhash.xxh3_128_digest
    for k in range(0, len(parts), _SLICE):
        some = b"".join([digest(p.encode()) for p in parts[k : k + _SLICE]])
        bits = np.unpackbits(np.frombuffer(some, np.uint8).reshape(-1, LANES // 8), axis=1)
        total += 2 * bits.sum(axis=0, dtype=np.int64) - len(bits)
    return total.astype(np.uint16)


def insert(fingerprint: np.ndarray, *parts: str) -> np.ndarray:
    return fingerprint + vector(list(parts))


def delete(fingerprint: np.ndarray, *parts: str) -> np.ndarray:
    return fingerprint - vector(list(parts))


def to_hex(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u2").tobytes().hex()


def from_hex(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u2").astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal fingerprints, about 0 for those of unrelated documents."""
    if np.array_equal(a, b):
        return 1.0
    square = lambda v: float((v.view(np.int16).astype(np.int64) ** 2).sum())
    whole = square(a) + square(b)
    return min(1.0, max(0.0, 1.0 - square(a - b) / whole)) if whole else 0.0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every document: map only."""

    def run(batches):
        for batch in batches:
            found = [to_hex(vector(paragraphs(t.as_py()))) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.string())], names=[id_col, "fingerprint"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, fingerprint string")


def edited(text: str, following: str) -> str:
    """The text with its second half replaced by as much of the start of another."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


# Rows of one range of ids; each range is read by one task in order.
_RANGE_ROWS = 1_000
_MAX_RANGES = 20_000


def id_key(docs: DataFrame, id_col: str) -> Column:
    """What ids are ordered by: integers as such, others as strings by code point."""
    whole = docs.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    return F.col(id_col).cast("long" if whole else "string")


def range_ends(ids: DataFrame, wanted: int) -> list:
    """At most `wanted` ids that part the rows into ranges of about equal size."""
    if wanted == 1:
        return []
    if ids.schema["id"].dataType.simpleString() != "string":
        found = ids.approxQuantile("id", [k / wanted for k in range(1, wanted)], 0.1 / wanted)
        return sorted({int(e) for e in found})
    # strings have no quantiles: the least id of each part of a sampled range sort
    parts = cut(ids.where("id is not null").repartitionByRange(wanted, "id"))
    least = parts.groupBy(F.spark_partition_id().alias("part")).agg(F.min("id").alias("id"))
    return sorted({r.id for r in least.collect()})


def with_next(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """The rows dealt to ranges of falling ids (`_range`), each range with the
    first row of the next one as an extra row (`_extra`), cyclically.

    The range ends are quantiles of the ids, a bounded list; which row is first
    in a range is the largest id of a group. Texts are shuffled once.
    """
    key = id_key(docs, id_col)
    ids = cut(docs.select(key.alias("id")))
    rows = ids.count()
    wanted = max(1, min(_MAX_RANGES, -(-rows // _RANGE_ROWS)))
    ends = range_ends(ids, wanted)
    least = "" if ids.schema["id"].dataType.simpleString() == "string" else 0

    @F.pandas_udf("int")
    def above(c: pd.Series) -> pd.Series:
        return c.map(lambda x: len(ends) - bisect_left(ends, x)).astype("int32")

    def of(c: Column) -> Column:
        """0 for the largest ids; null ids come after all others."""
        if not ends:
            return F.when(c.isNull(), F.lit(1)).otherwise(F.lit(0))
        return F.when(c.isNull(), F.lit(len(ends) + 1)).otherwise(above(F.coalesce(c, F.lit(least))))

    # first id of each range that has rows, and the range before it, cyclically
    firsts = ids.groupBy(of(F.col("id")).alias("_own")).agg(F.max("id").alias("_first"))
    ring = Window.orderBy("_own")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = cut(firsts.select(
        "_own", "_first", F.coalesce(F.lag("_own").over(ring), F.last("_own").over(whole)).alias("_before")
    ))
    own = docs.select(id_col, text_col, of(key).alias("_own"))
    # at most one row per range: the list of range ends bounds the broadcast
    own = own.join(F.broadcast(firsts), "_own")
    first = key.eqNullSafe(F.col("_first"))
    dealt = own.select(
        id_col, text_col,
        F.explode(F.when(first, F.array(
            F.struct(F.col("_own").alias("_range"), F.lit(False).alias("_extra")),
            F.struct(F.col("_before").alias("_range"), F.lit(True).alias("_extra")),
        )).otherwise(F.array(F.struct(F.col("_own").alias("_range"), F.lit(False).alias("_extra"))))).alias("_to"),
    ).select(id_col, text_col, "_to.*")
    return dealt, len(ends) + 2


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint, that of its edited text, and its likeness to
    that and to the next document in falling order of ids (nulls last; the first
    one follows the last one).

    Rows of one id follow each other by text. A document alone is its own next.
    """

    def run(batches):
        before, at, head = None, None, None
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in range(4)))
            out = []
            for doc, text, part, extra in rows:
                text = text or ""
                if part != at:
                    before, at = None, part
                own = vector(paragraphs(text))
                if before is not None:
                    out.append(row(*before, text, own))
                before = None if extra else (doc, text, own)
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names
                )

    def row(doc, text, own, following, following_vector):
        new = edited(text, following)
        changed = vector(paragraphs(new))
        return (doc, len(text), hashlib.sha256(new.encode()).hexdigest(), to_hex(own), to_hex(changed),
                likeness(own, changed), likeness(own, following_vector))

    schema = (f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_chars long, edited_sha256 string, "
              "fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    names = [c.split()[0] for c in schema.split(", ")]
    dealt, ranges = with_next(docs, id_col, text_col)
    parts = dealt.repartition(ranges, "_range").sortWithinPartitions(
        "_range", "_extra", id_key(docs, id_col).desc_nulls_last(), text_col
    )
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(docs.schema[id_col].dataType), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
    return parts.mapInArrow(run, schema)

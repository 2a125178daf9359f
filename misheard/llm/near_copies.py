"""Near copies of the corpus: texts whose sets of five-word shingles have a Jaccard
similarity of 0.8 or more.

Candidates share a band: the least hashes of the set under `ROWS` functions, one
of `BANDS` such groups. Two sets at the least similarity share none with a chance
of (1 - 0.8^5)^32, about three in a million; nearer ones with less. Every
candidate is verified by the exact similarity of the sets, so no pair below it is
linked, and a group is what is reachable over such links.

Equal sets are one class, which stands for all its documents. Pairs are compared by a
sketch first, which never rules out one that is similar enough; only what it leaves is
compared by the sets. A band of more than `group_rows` classes is first compared with its
smallest class only; after that, pairs of its classes that are not yet connected are
compared, so a large group of copies costs one comparison of sets per class, and no pair
is left out.

A text of fewer words than a shingle is one shingle; null and empty texts have
none, and are copies of each other only.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from misheard.llm.common import attach, cut, free_name, map_arrow
from misheard.llm.components import components
from misheard.llm.simhash import first_of_groups, near_duplicates
from misheard.operators.joins import is_small, lookup_join, spread_join

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 5
SEED = 42
GROUP_ROWS = 64
SKETCH = 512
_ROWS = 512      # whose sets a task holds at once
_SLICE = 1 << 12
_ODD = np.random.default_rng(SEED).integers(0, 2**63, (2, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = np.random.default_rng(SEED + 1).integers(0, 2**63, SHINGLE_WORDS, np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, size: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes."""
    words = (text or b"").lower().split()
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] * bool(words), np.uint64)
    digest = xxhash.xxh64_intdigest
    w = np.array([digest(x, SEED) for x in words], np.uint64)
    n = len(w) - size + 1
    return np.unique(_mix(sum(w[k : k + n] * _PLACES[k] for k in range(size))))


def bands(found: np.ndarray) -> list[int]:
    """One signed long per band of a set that is not empty."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for k in range(0, len(found), _SLICE):
        part = (found[k : k + _SLICE, None] ^ _ODD[0]) * _ODD[1]
        least = np.minimum(least, part.min(axis=0))
    keys = [xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def sketch(found: np.ndarray) -> list[int]:
    """Whether an odd number of shingles falls in each of SKETCH bins, as signed longs. Two
    sets differ in at most as many bins as they differ in shingles."""
    odd = np.bincount((found >> np.uint64(40)).astype(np.int64) % SKETCH, minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _class(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).view(np.int64))


def _signatures(docs: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """The `keep` columns, the class of the set, its size, its bands, and its sketch."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t.as_py()) for t in batch.column(0)]
        made = [pa.array([_class(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([bands(s) if len(s) else [] for s in sets], pa.list_(pa.int64())),
                pa.array([sketch(s) for s in sets], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([*batch.columns[1:], *made], names=[*keep, "fp", "size", "bands", "sketch"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    rows = docs.select(F.col(text_col).cast("binary").alias("_text"), *keep)
    return map_arrow(rows, step, f"{kinds}, fp long, size long, bands array<long>, sketch array<long>", _ROWS)


def _sets(docs: DataFrame, wanted: DataFrame, row: str, text_col: str) -> DataFrame:
    """(fp, set) of the classes of `wanted` (fp, _row, rows), from the texts of its rows."""
    reps = wanted.select(F.col("_row").alias(row), "rows")
    texts = docs.select(row, F.col(text_col).cast("binary").alias("_text"))
    if is_small(reps):
        texts = texts.join(F.broadcast(reps), row, "left_semi")
    else:
        texts = spread_join(texts, reps, [row], "left_semi", [row], left_rows="rows")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t.as_py()) for t in batch.column(0)]
        made = [pa.array([_class(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
        return pa.RecordBatch.from_arrays(made, names=["fp", "set"])

    # rows that repeat as they are give their class once
    return map_arrow(texts.select("_text"), step, "fp long, set binary", _ROWS).dropDuplicates(["fp"])


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    pairs = cut(pairs)
    for side in ("a", "b"):
        of = pairs.groupBy(side).agg(F.count(F.lit(1)).alias("n")).withColumnRenamed(side, "fp")
        named = sets.join(of.hint("merge"), "fp").select(F.col("fp").alias(side), F.col("set").alias(f"set_{side}"), "n")
        pairs = spread_join(pairs, cut(named), [side], "inner", ["a", "b"], heavy_rows=10_000, left_rows="n").drop("n")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        near = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            near.append(both >= similarity * (len(x) + len(y) - both))
        return pa.RecordBatch.from_arrays(list(batch.columns[:2]), names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    return cut(map_arrow(pairs.select("a", "b", "set_a", "set_b"), step, "a long, b long"))


def groups(
    docs: DataFrame, classes: DataFrame, row: str, text_col: str, similarity: float = SIMILARITY,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """(node, root) of the classes (fp, size, bands, sketch, _row, rows) that are linked: all
    candidates of at least the similarity are connected. `row` tells the documents apart."""
    keyed = classes.select("fp", "size", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("least")).where("n > 1")
    # sorted joins throughout: these tables grow with the corpus, and the driver holds none
    met = cut(keyed.join(shared.hint("merge"), "key").join(classes.select("fp", "sketch").hint("merge"), "fp"))
    wanted = classes.join(met.select("fp").distinct().hint("merge"), "fp", "left_semi").select("fp", "_row", "rows")
    sets = cut(_sets(docs, cut(wanted), row, text_col))

    size = lambda c: F.col(c).cast("double")
    like = F.least(size("size_a"), size("size_b")) >= similarity * F.greatest(size("size_a"), size("size_b"))
    # sets of the least similarity differ in no more shingles, so in no more bins, than this
    bins = sum(F.bit_count(F.col("sketch_a")[k].bitwiseXOR(F.col("sketch_b")[k])) for k in range(SKETCH // 64))
    like &= bins <= (size("size_a") + size("size_b")) * ((1 - similarity) / (1 + similarity)) + 1e-6

    def paired(rows: DataFrame, *same: str) -> DataFrame:
        a, b = (
            rows.select("key", F.col("fp").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("size", "sketch", *same)])
            for s in "ab"
        )
        return a.join(b.hint("merge"), "key").where((F.col("a") < F.col("b")) & like)

    small = paired(met.where(F.col("n") <= group_rows)).select("a", "b")
    large = met.where(F.col("n") > group_rows)
    stars = large.where("fp != least").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    found = _verified(small.unionByName(stars).distinct(), sets, similarity)
    roots = components(found)
    if large.isEmpty():
        return roots
    rooted = large.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    apart = paired(cut(rooted), "root").where("root_a != root_b").select("a", "b").distinct()
    more = _verified(apart, sets, similarity)
    if more.isEmpty():
        return roots
    # only what the first links left apart is connected again
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    between = more.join(of("a").hint("merge"), "a", "left").join(of("b").hint("merge"), "b", "left")
    second = components(between.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    later = second.select(F.col("node").alias("root"), F.col("root").alias("_final"))
    old = roots.join(later.hint("merge"), "root", "left").select("node", F.coalesce("_final", "root").alias("root"))
    return old.unionByName(second.join(roots, "node", "left_anti"))


def _with_links(found: DataFrame, others: DataFrame) -> DataFrame:
    """`found` (root, id, _row) with groups as one that rows of one group of `others`
    (root, _row) connect. Only groups of `others` that meet several make links."""
    node = lambda kind, c: F.xxhash64(F.lit(kind), F.col(c))
    rows = found.groupBy("_row").agg(F.min("root").alias("x"))         # rows that are equal are of one group
    met = rows.join(others.groupBy("_row").agg(F.min("root").alias("y")).hint("merge"), "_row")
    met = cut(met.select(node("sets", "x").alias("a"), node("fingerprints", "y").alias("b")).distinct())
    several = met.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    roots = components(met.join(several.hint("merge"), "b").select("a", "b"))
    named = roots.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    joined = lookup_join(found.withColumn("_node", node("sets", "root")), named, ["_node"], "left", ["id", "_row"])
    return joined.select(F.coalesce("_root", "_node").alias("root"), "id", "_row")


def keep_first(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY,
    group_rows: int = GROUP_ROWS, fingerprints: bool = False,
) -> DataFrame:
    """`docs` with one row of each group of near copies: that of the smallest id
    (null last), of equal ids the one with the smallest digest of all columns. With
    `fingerprints`, texts whose fingerprints differ in two bits or less are linked too."""
    row = free_name(docs, "_row")
    keyed = docs.withColumn(row, F.xxhash64(*docs.columns))
    rows = cut(_signatures(keyed, [id_col, row], text_col).withColumnRenamed(row, "_row"))
    of = F.min(F.struct("_row", "size", "bands", "sketch"))
    classes = rows.groupBy("fp").agg(of.alias("m"), F.count(F.lit(1)).alias("n"))
    classes = cut(classes.select("fp", "m.*", "n", F.col("n").alias("rows")))
    roots = groups(keyed, classes.drop("n"), row, text_col, similarity, group_rows)
    rooted = classes.select("fp", "n").join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select(
        "fp", "n", F.coalesce("root", "fp").alias("root")
    )
    found = attach(rows.select(F.col(id_col).alias("id"), "_row", "fp"), cut(rooted), ["fp"], "n", ["id", "_row"])
    found = cut(found.select("root", "id", "_row"))
    if fingerprints:
        others = near_duplicates(keyed, id_col, text_col, keep=(row,)).select("root", F.col(row).alias("_row"))
        found = cut(_with_links(found, others))
    return first_of_groups(keyed, found, row, id_col)

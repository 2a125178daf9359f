"""Removal of repeated passages by bucket-pointer refinement.

Two byte strings of `length` are equal only if all their q-grams are, so strings
are put into buckets by one q-gram each: of all q-grams in a string, the one with
the smallest identifier, which equal strings share at the same place. Neighbouring
strings mostly share it too, so an anchor (a place with its q-gram) stands for a
run of strings, about one per `length`/2 bytes.

Buckets are refined by identifiers of later offsets. An identifier of 2k bytes is
made from those of k bytes at an offset and k bytes later; so identifiers of one
round are reused in the next, and no round needs the texts again. First, anchors
of a bucket are split by the identifier of all text around them: where several
agree, all strings of their runs are repeated, however many copies there are.
Then one anchor per such class is compared with the other classes of its bucket,
string by string, by sorting on (bucket, offset, identifier of the string). A
bucket of more than `BUCKET_CLASSES` classes is not held together: its runs are
cut into blocks of strings, which are refined in the same way, and the strings of
the blocks that are still open are dealt out by these three values.

Texts are bytes; a repeated string may start in the same document, and overlaps
count. Null and empty texts have nothing to remove. Rows that repeat an id are
documents of their own; equal rows are copies of each other. Identifiers have 64
bits and are taken as names: no two texts compared are expected to share one by
chance.
"""

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from misheard.llm.common import cut, parts_for, shared_path
from misheard.operators.joins import is_small

LENGTH = 400
GRAM = 64
BLOCK_BYTES = 8 << 20
BUCKET_CLASSES = 1_000
BLOCK_STRINGS = 16
_CHUNK = 1 << 18
_PLACE_BITS = 20
_SEEDS = (1 << 64) - 1
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_BYTE_NAMES = np.array([xxhash.xxh3_64_intdigest(bytes([b]), 9) for b in range(256)], np.uint64)


def _join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Identifiers of pairs of identifiers."""
    out = left * _ODD[0]
    out += right
    out ^= out >> np.uint64(31)
    out *= _ODD[1]
    out ^= out >> np.uint64(32)
    return out


def identifiers(data: np.ndarray, length: int) -> np.ndarray:
    """The identifier of the `length` bytes at every place that has so many."""
    names, k = _BYTE_NAMES[data], 1
    while 2 * k <= length:
        names = _join(names[:-k], names[k:])
        k *= 2
    return names if k == length else _join(names[: len(names) - (length - k)], names[length - k :])


def _window_min(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every `width` neighbours."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def _runs(data: np.ndarray, valid: np.ndarray, length: int, gram: int):
    """(anchor, first string, last string, identifier) of every run, in order.
    `valid` tells the places at which a string may start."""
    names = identifiers(data, gram)
    low = np.uint64((1 << _PLACE_BITS) - 1)
    # of equal q-grams the leftmost counts
    least = _window_min((names & ~low) | np.arange(len(names), dtype=np.uint64), length - gram + 1)
    starts = np.flatnonzero(valid[: len(least)])
    anchor = (least[starts] & low).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)][: len(starts)])
    last = np.r_[new[1:], len(starts)] - 1
    return anchor[new], starts[new], starts[last[: len(new)]], names[anchor[new]]


def _chunks(texts: list[bytes], length: int):
    """(document, start in it, bytes) pieces, packed into chunks; pieces of a
    long document overlap by all but one byte of a string."""
    chunk, size = [], 0
    for doc, text in enumerate(texts):
        for at in range(0, max(0, len(text) - length + 1), _CHUNK):
            piece = text[at : at + _CHUNK + length - 1]
            if size + len(piece) > _CHUNK + length and chunk:
                yield chunk
                chunk, size = [], 0
            chunk.append((doc, at, piece))
            size += len(piece)
    if chunk:
        yield chunk


def anchors_of(texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """Columns document, anchor, first, last, bucket, around: all runs."""
    found: list[list] = [[], [], [], [], []]
    for chunk in _chunks(texts, length):
        data = np.frombuffer(b"".join([p for _, _, p in chunk]), np.uint8)
        valid = np.ones(len(data), bool)
        begin = np.cumsum([0] + [len(p) for _, _, p in chunk])
        for end in begin[1:]:
            valid[end - length + 1 : end] = False
        anchor, first, last, bucket = _runs(data, valid, length, gram)
        piece = np.searchsorted(begin, first, "right") - 1
        doc, start = (np.array([c[k] for c in chunk], np.int64) for k in (0, 1))
        shift = start[piece] - begin[piece]
        for column, values in zip(found, (doc[piece], anchor + shift, first + shift, last + shift, bucket)):
            column.append(values)
    if not found[0]:
        return [np.zeros(0, np.int64)] * 6
    doc, anchor, first, last, bucket = map(np.concatenate, found)
    # a run cut by the border of two pieces is one
    goes_on = np.r_[False, (doc[1:] == doc[:-1]) & (anchor[1:] == anchor[:-1]) & (first[1:] == last[:-1] + 1)]
    head = np.flatnonzero(~goes_on)
    last = last[np.r_[head[1:], len(last)] - 1]
    doc, anchor, first, bucket = (c[head] for c in (doc, anchor, first, bucket))
    back, digest = length - gram, xxhash.xxh3_64_intdigest
    around = np.empty(len(doc), np.uint64)
    for k, (d, a) in enumerate(zip(doc.tolist(), anchor.tolist())):
        text, left = texts[d], min(a, back)
        around[k] = digest(text[a - left : a + length], left)
    return [doc, anchor, first, last, bucket.view(np.int64), around.view(np.int64)]


_ANCHOR = "key long, anchor long, first long, last long, bucket long, around long"


def anchors(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """All runs of (key, text)."""

    def run(batches):
        for batch in batches:
            keys, texts = np.asarray(batch.column(0)), batch.column(1)
            start, size = 0, 0
            for k in range(len(texts)):
                size += len(texts[k].as_buffer()) if texts[k].is_valid else 0
                if size >= 8 * _CHUNK or k == len(texts) - 1:
                    part = [t or b"" for t in texts.slice(start, k + 1 - start).to_pylist()]
                    doc, *rest = anchors_of(part, length, gram)
                    if len(doc):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(keys[start : k + 1][doc]), *map(pa.array, rest)], names=names
                        )
                    start, size = k + 1, 0

    names = [c.split()[0] for c in _ANCHOR.split(", ")]
    return rows.select("key", "text").mapInArrow(run, _ANCHOR)


def _strings(rows: pa.Table | pa.RecordBatch, length: int):
    """Of (bucket, class, single, key, anchor, first, text): for every string of
    every run its row, place, offset from the anchor, and identifier."""
    texts = rows.column(6).to_pylist()
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    many = sizes - length + 1
    row = np.repeat(np.arange(len(texts)), many)
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    names = identifiers(data, length)[np.repeat(np.cumsum(sizes) - sizes, many) + nth]
    first, anchor = np.asarray(rows.column(5)), np.asarray(rows.column(4))
    place = first[row] + nth
    return row, place, anchor[row] - place, names


_MARK = "key long, first long, last long"


def _mark(key, place) -> pa.RecordBatch:
    """Places in order, as runs."""
    new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (place[1:] != place[:-1] + 1)])
    last = np.r_[new[1:], len(place)] - 1
    return pa.RecordBatch.from_arrays(
        [pa.array(key[new]), pa.array(place[new]), pa.array(place[last])], names=["key", "first", "last"]
    )


def _refined_together(contexts: DataFrame, length: int) -> DataFrame:
    """Marks of strings met again in their bucket, whole buckets at a time."""

    def marks(rows: pa.Table):
        row, place, offset, names = _strings(rows, length)
        bucket = np.asarray(rows.column(0)).view(np.uint64)
        full = _join(_join(bucket[row], offset.astype(np.uint64)), names)
        order = np.argsort(full, kind="stable")
        same = full[order[1:]] == full[order[:-1]]
        again = np.zeros(len(full), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        wanted = again & np.asarray(rows.column(2).to_numpy(zero_copy_only=False))[row]
        if wanted.any():
            yield _mark(np.asarray(rows.column(3))[row[wanted]], place[wanted])

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            bucket = np.asarray(rest.column(0))
            # whole buckets, some thousand rows at a time
            begins = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            done = 0
            for b in begins[1:]:
                if b - done >= 2 * BUCKET_CLASSES:
                    yield from marks(rest.slice(done, b - done).combine_chunks())
                    done = b
            rest = rest.slice(done)
        if rest is not None and len(rest):
            yield from marks(rest.combine_chunks())

    return contexts.repartition("bucket").sortWithinPartitions("bucket", "class").mapInArrow(run, _MARK)


def _blocks(contexts: DataFrame, length: int) -> DataFrame:
    """The runs of contexts cut at every `BLOCK_STRINGS` offsets from the anchor:
    `shared` names what all strings of such a block have in common, `whole` names
    all that the part of it in this run covers."""

    def run(batches):
        for batch in batches:
            out = [[] for _ in names]
            for bucket, _, single, key, anchor, first, text in zip(*(c.to_pylist() for c in batch.columns)):
                low, high = anchor - (first + len(text) - length), anchor - first
                for block in range(low // BLOCK_STRINGS, high // BLOCK_STRINGS + 1):
                    near, far = block * BLOCK_STRINGS, (block + 1) * BLOCK_STRINGS - 1
                    # offsets count from a string's start to its anchor
                    begin, end = max(anchor - far, first), anchor - max(near, low)
                    part = text[begin - first : end - first + length]
                    at = anchor - near - first
                    shared = text[max(0, at) : at - (far - near) + length]
                    seed = (bucket ^ block) & _SEEDS
                    whole = xxhash.xxh3_64_intdigest(part, (seed ^ (anchor - begin << 20)) & _SEEDS)
                    row = (xxhash.xxh3_64_intdigest(shared, seed), whole, bucket, single, key, anchor, begin, end, part)
                    for column, value in zip(out, row):
                        column.append(value)
            made = [np.array(c, np.uint64).view(np.int64) for c in out[:2]] + out[2:]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made, kinds)], names=names)

    names = ["shared", "whole", "bucket", "single", "key", "anchor", "first", "last", "text"]
    kinds = [pa.int64()] * 3 + [pa.bool_()] + [pa.int64()] * 4 + [pa.binary()]
    schema = "shared long, whole long, bucket long, single boolean, key long, anchor long, first long, last long, text binary"
    return contexts.mapInArrow(run, schema)


def _refined_apart(contexts: DataFrame, length: int) -> DataFrame:
    """The same for buckets of any size, by one more refinement of the same kind:
    blocks of strings instead of runs. Only strings of blocks that differ although
    they share their common part become rows of their own."""
    blocks = cut(_blocks(contexts, length))
    classes = blocks.groupBy("shared", "whole").agg(
        F.count(F.lit(1)).alias("n"), F.first(F.struct("bucket", "single", "key", "anchor", "first", "text")).alias("one")
    )
    full = blocks.select("shared", "whole").groupBy("shared", "whole").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    whole_blocks = blocks.where("single").select("shared", "whole", "key", "first", "last").join(
        full.drop("n"), ["shared", "whole"]
    )
    mixed = classes.groupBy("shared").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1")
    ones = classes.join(mixed, "shared").select(
        "one.bucket", F.col("whole").alias("class"), (F.col("one.single") & (F.col("n") == 1)).alias("single"),
        "one.key", "one.anchor", "one.first", "one.text",
    )

    def run(batches):
        for batch in batches:
            row, place, offset, names = _strings(batch, length)
            bucket = np.asarray(batch.column(0)).view(np.uint64)
            full = _join(_join(bucket[row], offset.astype(np.uint64)), names)
            single = batch.column(2).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(full.view(np.int64)), pa.array(np.asarray(batch.column(3))[row]), pa.array(place),
                 pa.array(single[row])],
                names=["name", "key", "first", "single"],
            )

    strings = ones.mapInArrow(run, "name long, key long, first long, single boolean")
    again = strings.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name")
    singles = strings.where("single").join(again, "name").select("key", "first", F.col("first").alias("last"))
    return whole_blocks.select("key", "first", "last").unionByName(singles)


def _block(blocks: int):
    return F.pmod("key", F.lit(blocks)).cast("int").alias("block")


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM,
    bucket_classes: int = BUCKET_CLASSES, kept_text: bool = False,
) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every document, and with
    `kept_text` the bytes that are left."""
    spark = docs.sparkSession
    text = F.col(text_col).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("key"), text.alias("text"))

    path = shared_path(spark, "anchors")
    anchors(rows, length, gram).write.parquet(path)
    runs = spark.read.parquet(path)
    classes = runs.groupBy("bucket", "around").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "anchor", "first", "last")).alias("one")
    )
    path = shared_path(spark, "classes")
    classes.write.parquet(path)
    classes = spark.read.parquet(path)
    full = classes.where("n > 1").select("bucket", "around")
    whole_runs = runs.join(full, ["bucket", "around"]).select("key", "first", "last")
    mixed = classes.groupBy("bucket").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1")
    ones = classes.join(mixed, "bucket").select(
        "bucket", F.col("around").alias("class"), (F.col("n") == 1).alias("single"), "classes", "one.*"
    )

    blocks = parts_for(docs, F.octet_length(text_col), BLOCK_BYTES)
    # both uses below read the same shuffle of the texts
    dealt = rows.withColumn("block", _block(blocks)).repartition(blocks, "block")

    def cut_out(texts: pa.Table, wanted: pa.Table) -> pa.Table:
        of = {k: n for n, k in enumerate(texts.column("key").to_pylist())} if len(wanted) else {}
        source = texts.column("text")
        cuts = [
            source[of[k]].as_py()[a : b + length]
            for k, a, b in zip(*(wanted.column(c).to_pylist() for c in ("key", "first", "last")))
        ]
        return wanted.select(["bucket", "class", "single", "key", "anchor", "first"]).append_column(
            "text", pa.array(cuts, pa.binary())
        )

    def contexts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
        wanted = wanted.withColumn("block", _block(blocks))
        return texts.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(
            cut_out, "bucket long, class long, single boolean, key long, anchor long, first long, text binary"
        )

    few = contexts(dealt, ones.where(F.col("classes") <= bucket_classes))
    marks = whole_runs.unionByName(_refined_together(few, length))
    many = cut(ones.where(F.col("classes") > bucket_classes))
    if not many.isEmpty():
        keys = cut(many.select("key").distinct())
        holders = rows.join(F.broadcast(keys) if is_small(keys) else keys, "key", "left_semi")
        holders = holders.select("id", "key", "text").withColumn("block", _block(blocks)).repartition(blocks, "block")
        marks = marks.unionByName(_refined_apart(contexts(holders, many), length))

    def remove(texts: pa.Table, marks: pa.Table) -> pa.Table:
        key, first, last = (np.asarray(marks.column(c)) for c in ("key", "first", "last"))
        order = np.lexsort((first, key))
        key, first, end = key[order], first[order], last[order] + length
        out = [[], [], [], [], []]
        for k, t in zip(texts.column("key").to_pylist(), texts.column("text")):
            data = t.as_py() or b""
            lo, hi = np.searchsorted(key, k, "left"), np.searchsorted(key, k, "right")
            spans = []
            if hi > lo:
                reach = np.maximum.accumulate(end[lo:hi])
                begin = first[lo:hi]
                new = np.flatnonzero(np.r_[True, begin[1:] > reach[:-1]])
                spans = list(zip(begin[new].tolist(), reach[np.r_[new[1:], hi - lo] - 1].tolist()))
            at, kept = 0, []
            for a, b in spans:
                kept.append(data[at:a])
                at = b
            left = b"".join([*kept, data[at:]]) if spans else data
            for column, value in zip(out, (len(data), len(data) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left if kept_text else None)):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        made = [pa.array(c, kind) for c, kind in zip(out, kinds)]
        return pa.table([texts.column("id"), *made[: 5 if kept_text else 4]], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    schema += ", kept binary" * kept_text
    names = [c.split()[0] for c in schema.split(", ")]
    return dealt.groupBy("block").cogroup(marks.withColumn("block", _block(blocks)).groupBy("block")).applyInArrow(
        remove, schema
    )

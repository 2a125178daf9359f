"""Corrupt text: cut it into random chunks, replace known chunks by frequency.

Chunks are cut batch by batch with Arrow: their texts are the bytes of the input, so
only the places of the cuts are made. A small table of replacements goes along with
the function; others are joined.
"""

from hashlib import md5
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from misheard import constants as K
from misheard.functions.draws import draw_np, row_seed, wide_draw
from misheard.operators.confusion import candidates, drawn
from misheard.operators.joins import BROADCAST_ROWS, by_key, checkpoint_dir, is_small, map_elements, require_strings

# Entries of a table that goes along with the function, at most.
CARRIED_ROWS = 50_000
_SLICE = 1 << 20           # characters cut at once


def _cut(seeds: list, text: pa.StringArray, sizes: np.ndarray) -> pa.ListArray:
    """Chunks of texts without nulls. Each hex digit of a digest draws one size."""
    offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2] or pa.py_buffer(b"")
    first = int(offsets[0])
    begins = (np.frombuffer(data, np.uint8)[first : offsets[-1]] & 0xC0) != 0x80     # of a character
    before = np.concatenate(([0], np.cumsum(begins)))[offsets - first]               # characters before a row
    n = np.diff(before)
    blocks = np.where(n > 0, n // 32 + 1, 0)
    drawn_digits = np.frombuffer(
        b"".join([md5(f"{r}{b}".encode()).digest() for r, k in zip(seeds, blocks.tolist()) for b in range(k)]), np.uint8
    )
    steps = sizes[np.stack([drawn_digits >> 4, drawn_digits & 15], axis=1).reshape(-1)]
    ends = np.concatenate(([0], np.cumsum(steps)))
    row = np.repeat(np.arange(len(n)), 32 * blocks)
    of_row = ends[np.concatenate(([0], np.cumsum(32 * blocks)[:-1])).astype(np.int64)] if len(n) else ends[:0]
    ends = ends[1:] - of_row[row]
    used = ends - steps < n[row]
    row, ends = row[used], np.minimum(ends[used], n[row[used]])      # the last chunk ends with the text
    at = before[row] + ends
    if len(begins) > before[-1]:
        at = np.append(np.flatnonzero(begins), len(begins))[at]
    places = np.concatenate(([0], at)).astype(np.int32) + np.int32(first)
    chunks = pa.StringArray.from_buffers(len(at), pa.py_buffer(places.tobytes()), data)
    lists = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(n))))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(lists), chunks)


def _slices(seeds: list, text: pa.Array, sizes: np.ndarray):
    """(first row, chunk lists) of slices of a batch; nulls as empty texts."""
    text = pc.fill_null(text.cast(pa.string()), "")
    upto = list(accumulate(pc.binary_length(text).to_pylist()))
    start = 0
    for k, total in enumerate(upto):
        if k + 1 == len(text) or upto[k + 1] - (upto[start - 1] if start else 0) > _SLICE:
            yield start, _cut(seeds[start : k + 1], text.slice(start, k + 1 - start), sizes)
            start = k + 1


def _joined_lists(parts: list, nulls: pa.Array | None = None) -> pa.Array:
    lists = pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))
    return lists if nulls is None or not nulls.null_count else pc.if_else(pc.is_valid(nulls), lists, None)


def _check_sizes(sizes: tuple) -> np.ndarray:
    if not sizes or 16 % len(sizes):
        raise ValueError("the number of chunk sizes has to divide 16")
    return np.array([sizes[i % len(sizes)] for i in range(16)], np.int64)


def random_chunks(rs: Column, text: Column, sizes: tuple = K.CHUNK_SIZES) -> Column:
    """Cut text into chunks of independent, uniformly drawn sizes; the last one
    is clipped. The number of sizes has to divide 16 (repeat sizes to weight them)."""
    drawn_sizes = _check_sizes(sizes)

    @F.arrow_udf("array<string>")
    def run(seeds: pa.Array, texts: pa.Array) -> pa.Array:
        named = ["" if r is None else f"{r}|" for r in seeds.to_pylist()]
        return _joined_lists([c for _, c in _slices(named, texts, drawn_sizes)], texts)

    return run(rs.cast("string"), text)


class _Picks:
    """Replacements of a small table laid out for weighted picks, by chunk."""

    def __init__(self, rows: list, truncate_to: int | None):
        # in order of replacement, null first, as running counts are
        rows = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or ""))
        self.chunks = list(dict.fromkeys(r[0] for r in rows))
        self.replacements = [r[1] if r[1] is None or truncate_to is None else r[1][:truncate_to] for r in rows]
        self.hi = np.cumsum([r[2] for r in rows], dtype=np.int64)
        number = {c: k for k, c in enumerate(self.chunks)}
        of = np.array([number[r[0]] for r in rows], np.int64)
        self.total = np.zeros(len(self.chunks), np.int64)
        np.add.at(self.total, of, [r[2] for r in rows])
        self.base = np.cumsum(self.total) - self.total
        self.truncate_to = truncate_to

    def replaced(self, seeds: np.ndarray, lists: pa.ListArray) -> pa.ListArray:
        chunks, ends = lists.values, np.asarray(lists.offsets)
        counts = np.diff(ends)
        place = np.arange(len(chunks)) - np.repeat(ends[:-1], counts)
        found = pc.index_in(chunks, value_set=pa.array(self.chunks, pa.string()))
        known = np.flatnonzero(np.asarray(found.is_valid()))
        of = np.asarray(found.drop_null()).astype(np.int64)
        rs, k = np.repeat(seeds, counts)[known], place[known]
        wide = draw_np(rs, k) * np.int64(1 << 31) + (draw_np(rs, k, 1) & 0x7FFFFFFF)
        entry = np.searchsorted(self.hi, self.base[of] + wide % self.total[of], side="right")
        picked = np.zeros(len(chunks), np.int64)
        picked[known] = entry
        mask = np.ones(len(chunks), bool)
        mask[known] = False
        kept = chunks if self.truncate_to is None else pc.utf8_slice_codeunits(chunks, 0, self.truncate_to)
        new = pa.array(self.replacements, pa.string()).take(pa.array(picked, mask=mask))
        return pa.ListArray.from_arrays(lists.offsets, pc.coalesce(new, kept))


def _carried(table: DataFrame, max_rows: int, truncate_to: int | None) -> _Picks | None:
    """The table for picks inside a function, if it is small and has counts to pick by."""
    if not is_small(table, min(max_rows, CARRIED_ROWS)):
        return None
    rows = [tuple(r) for r in table.where(F.col("chunk").isNotNull()).select("chunk", "replacement", "cnt").collect()]
    if not rows or any(c is None or c <= 0 for _, _, c in rows) or sum(c for _, _, c in rows) >= 1 << 62:
        return None
    return _Picks(rows, truncate_to)


def _row_texts(lists: pa.ListArray, counts: np.ndarray) -> pa.Array:
    """The text of every row from the chunks of its texts, `counts` a row; chunks of rows
    that share a key are put in order of their places."""
    joined = pc.binary_join(lists, "")
    if (counts == 1).all():
        return joined
    joined, out, at = joined.to_pylist(), [], 0
    for n in counts.tolist():
        if n > 1:
            placed = sorted((i, x) for one in lists.slice(at, n).to_pylist() for i, x in enumerate(one))
            out.append("".join(x for _, x in placed))
        else:
            out.append(joined[at] if n else "")
        at += n
    return pa.array(out, pa.string())


def corrupt(
    df: DataFrame,
    keys: list[str],
    text: str,
    table: DataFrame,
    seed: int = 0,
    out: str = "corrupted",
    sizes: tuple = K.CHUNK_SIZES,
    truncate_to: int | None = None,
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Add the corrupted text to (keys, text). `keys` has to be unique.

    `truncate_to=3` cuts chunks and replacements to three characters.
    """
    require_strings(df, text)
    drawn_sizes = _check_sizes(sizes)
    rows = by_key(df.select(*keys, text), keys)
    seed_of = row_seed(seed, *[F.col(k) for k in keys])
    checkpoint_dir(table.sparkSession)
    table = table.select("chunk", "replacement", "cnt").checkpoint()
    picks = _carried(table, max_rows, truncate_to)
    if picks is not None:

        @F.arrow_udf("string")
        def corrupted(seeds: pa.Array, texts: pa.Array) -> pa.Array:
            counts = np.asarray(texts.value_lengths())
            rs = np.repeat(np.asarray(seeds), counts)
            cut = _slices([f"{r}|" for r in rs.tolist()], texts.flatten(), drawn_sizes)
            return _row_texts(_joined_lists([picks.replaced(rs[k : k + len(c)], c) for k, c in cut]), counts)

        each = rows.groupBy(*keys).agg(F.max(text).alias(text), F.collect_list(text).alias("_texts"))
        return each.select(*keys, text, corrupted(seed_of, "_texts").alias(out))

    rows = rows.withColumn("_rs", seed_of)
    rows = rows.withColumn("_chunks", random_chunks(F.col("_rs"), F.col(text), sizes))
    kept = F.col("chunk") if truncate_to is None else F.substr("chunk", F.lit(1), F.lit(truncate_to))

    at = F.pmod(wide_draw(F.col("_rs"), F.col("_pos")), F.col("total"))
    chosen = F.col("_repl")
    if truncate_to is not None:
        chosen = F.substr(chosen, F.lit(1), F.lit(truncate_to))
    replaced = F.coalesce(chosen, kept)
    found = candidates(table, held=True)
    max_rows = found.broadcast_rows(max_rows)
    done = map_elements(
        rows, [*keys, "_rs"], "_chunks", "chunk", found.top.select("chunk", "total", "slots"), "left", replaced, "_out",
        [text], {"_at": at}, max_rows, lambda joined: drawn(joined, found, [*keys, "_pos"], max_rows=max_rows),
    )
    return done.select(*keys, text, F.array_join("_out", "").alias(out))

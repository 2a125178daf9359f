"""Tables of which chunks are confused with which: (chunk, replacement, cnt).

Only counts travel: partial sums are made before the shuffle, so a chunk that
makes up a large share of all windows costs one row per task.
"""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from misheard import constants as K
from misheard.functions.draws import pick_entry, slot_of
from misheard.operators.joins import BROADCAST_ROWS, checkpoint_dir, lookup_join, require_strings, spread_join, union_all

# Columns cut out at once: a window is looked for from the start of its text, so long pairs
# are cut into stretches and these into blocks of a few windows.
_STRETCH, _BLOCK = 512, 32
PAGE = 256      # replacements listed in one row at most
_ENTRIES_PER_ROW = 5    # of a table that is broadcast, on average at most


def _blocks(df: DataFrame, keys: list[str], n: int, ref: str, hyp: str) -> DataFrame:
    """(keys, _at, _size, _r, _h): blocks of columns from `_at` (0-based) on with the n - 1
    columns behind them, of two strings of equal length `_size`."""
    require_strings(df, ref, hyp)
    size, other = F.length(ref), F.length(hyp)
    checked = F.when(
        size != other, F.raise_error(F.lit("aligned strings differ in length")).cast("int")
    ).otherwise(size)
    here = F.least(F.lit(_STRETCH), F.col("_size") - F.col("_from"))
    return (
        df.select(*keys, ref, hyp, checked.alias("_size"))
        .where(F.col("_size") > 0)
        .select(*keys, ref, hyp, "_size", F.explode(F.sequence(F.lit(0), F.col("_size") - 1, F.lit(_STRETCH))).alias("_from"))
        .select(
            *keys,
            "_from",
            "_size",
            F.substr(ref, F.col("_from") + 1, F.lit(_STRETCH + n - 1)).alias("_r"),
            F.substr(hyp, F.col("_from") + 1, F.lit(_STRETCH + n - 1)).alias("_h"),
        )
        .select(*keys, "_from", "_size", "_r", "_h", F.explode(F.sequence(F.lit(0), here - 1, F.lit(_BLOCK))).alias("_in"))
        .select(
            *keys,
            (F.col("_from") + F.col("_in")).alias("_at"),
            "_size",
            F.substr("_r", F.col("_in") + 1, F.lit(_BLOCK + n - 1)).alias("_r"),
            F.substr("_h", F.col("_in") + 1, F.lit(_BLOCK + n - 1)).alias("_h"),
        )
    )


def aligned_windows(
    df: DataFrame, keys: list[str], max_n: int, min_n: int = 1, ref: str = "ref_aln", hyp: str = "hyp_aln"
) -> DataFrame:
    """All same-position substrings of lengths min_n..max_n of two strings of
    equal length: `n`, `at` (1-based), `ref_win`, `hyp_win`."""
    blocks = _blocks(df, keys, max_n, ref, hyp).withColumn("n", F.explode(F.sequence(F.lit(min_n), F.lit(max_n))))
    # windows that start in this block and end inside the pair
    last = F.least(F.lit(_BLOCK), F.col("_size") - F.col("_at") - F.col("n") + 1)
    return (
        blocks.where(last >= 1)
        .select(*keys, "_at", "_r", "_h", "n", F.explode(F.sequence(F.lit(1), last)).alias("_i"))
        .select(
            *keys,
            "n",
            (F.col("_at") + F.col("_i")).alias("at"),
            F.substr("_r", F.col("_i"), F.col("n")).alias("ref_win"),
            F.substr("_h", F.col("_i"), F.col("n")).alias("hyp_win"),
        )
    )


def _no_gap(c: str) -> Column:
    return F.replace(F.col(c), F.lit(K.GAP), F.lit(""))


def _long_windows(df: DataFrame, n: int, ref: str, hyp: str) -> DataFrame:
    """(ref_win, hyp_win, cnt): the window of n columns, or as many as are left, from
    each column on."""
    last = F.least(F.lit(_BLOCK), F.col("_size") - F.col("_at"))
    blocks = _blocks(df, [], n, ref, hyp).withColumn("_last", last)
    cut = blocks.select("_r", "_h", F.explode(F.sequence(F.lit(1), F.col("_last"))).alias("_i")).select(
        F.substr("_r", F.col("_i"), F.lit(n)).alias("ref_win"), F.substr("_h", F.col("_i"), F.lit(n)).alias("hyp_win")
    )
    return cut.groupBy("ref_win", "hyp_win").agg(F.count(F.lit(1)).alias("cnt"))


def window_counts(df: DataFrame, max_n: int, ref: str = "ref_aln", hyp: str = "hyp_aln") -> DataFrame:
    """(ref_win, hyp_win, cnt): how often each of `aligned_windows` of 1..max_n columns occurs,
    a window in one row or more. A column's windows are the starts of its longest one, so only
    that is cut out of the text; shorter ones are cut from distinct longest ones. This pays
    where most of these repeat."""
    counts = _long_windows(df, max_n, ref, hyp)
    starts = F.sequence(F.lit(1), F.length("ref_win"))
    return counts.select("ref_win", "hyp_win", "cnt", F.explode(starts).alias("_n")).select(
        F.substr("ref_win", F.lit(1), F.col("_n")).alias("ref_win"),
        F.substr("hyp_win", F.lit(1), F.col("_n")).alias("hyp_win"),
        "cnt",
    )


def forward_table(
    df: DataFrame, order: int = K.CONFUSION_ORDER, ref: str = "ref_aln", hyp: str = "hyp_aln"
) -> DataFrame:
    """Clean chunk -> recognised chunk, for chunks of 1..order columns. Windows
    whose clean side is a lone gap are skipped."""
    return (
        window_counts(df, order, ref, hyp)
        .where(F.col("ref_win") != K.GAP)
        .groupBy(_no_gap("ref_win").alias("chunk"), _no_gap("hyp_win").alias("replacement"))
        .agg(F.sum("cnt").alias("cnt"))
    )


def reverse_table(
    df: DataFrame, max_gram: int = K.MAX_GRAM, ref: str = "ref_aln", hyp: str = "hyp_aln"
) -> DataFrame:
    """Recognised chunk -> clean chunk, for chunks of 1..max_gram-1 columns.
    Chunks empty on the recognised side are skipped."""
    return (
        aligned_windows(df, [], max_gram - 1, 1, ref, hyp)
        .groupBy(_no_gap("hyp_win").alias("chunk"), _no_gap("ref_win").alias("replacement"))
        .agg(F.count(F.lit(1)).alias("cnt"))
        .where(F.col("chunk") != "")
    )


def merge_tables(old: DataFrame, new: DataFrame) -> DataFrame:
    """Add the counts of two confusion tables."""
    return old.unionByName(new).groupBy("chunk", "replacement").agg(F.sum("cnt").alias("cnt"))


class Candidates(NamedTuple):
    """Replacements laid out for weighted picks. `top` has a row per chunk: chunk, total, n,
    first, slots. Chunks of more replacements than a page have theirs in `pages`, from
    below the top to the leaves: chunk, page, lo, total, slots. No row lists more than a page."""

    top: DataFrame
    pages: list[DataFrame]
    entries: int

    def broadcast_rows(self, max_rows: int) -> int:
        """The bound on rows for a broadcast; none where their entries are too many."""
        return max_rows if self.entries <= _ENTRIES_PER_ROW * max_rows else 0


def _slots(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lo, total, slots) of the entries (keys, lo, hi, repl, child): as many slots as
    entries of the key, each with the entries that reach into it, their ends from `lo`."""
    of = Window.partitionBy(*keys)
    based = spans.select(
        *keys, "repl", "child",
        F.min("lo").over(of).alias("base"),
        (F.max("hi").over(of) - F.min("lo").over(of)).alias("total"),
        F.count(F.lit(1)).over(of).cast("int").alias("n"),
        (F.col("lo") - F.min("lo").over(of)).alias("start"),
        (F.col("hi") - F.min("lo").over(of)).alias("hi"),
    )
    first, last = (slot_of(c, F.col("total"), F.col("n")) for c in (F.col("start"), F.col("hi") - 1))
    near = F.sort_array(F.collect_list(F.struct("hi", "repl", "child")))
    return (
        based.select(*keys, "base", "total", "hi", "repl", "child", F.explode(F.sequence(first, last)).alias("slot"))
        .groupBy(*keys, "slot")
        .agg(F.max("base").alias("lo"), F.max("total").alias("total"), near.alias("near"))
        .groupBy(*keys)
        .agg(
            F.max("lo").alias("lo"),
            F.max("total").alias("total"),
            F.transform(F.sort_array(F.collect_list(F.struct("slot", "near"))), lambda s: s["near"]).alias("slots"),
        )
    )


def _running(table: DataFrame) -> DataFrame:
    """(chunk, k, lo, hi, repl) with running counts and numbers in order of replacement,
    for chunks of any length: sums within ranges of rows, then over the ranges."""
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = table.repartitionByRange(parts, "chunk", "replacement").withColumn("part", F.spark_partition_id())
    ranged = ranged.checkpoint()      # the ranges are kept as they were drawn
    inside = Window.partitionBy("part", "chunk").orderBy("replacement")
    before = Window.partitionBy("chunk").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0")
    sums = ranged.groupBy("part", "chunk").agg(F.sum("cnt").alias("s"), F.count(F.lit(1)).alias("c"))
    rows = ranged.select(
        "part", "chunk", F.col("replacement").alias("repl"), "cnt",
        F.sum("cnt").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("sum"),
        F.row_number().over(inside).alias("no"),
    ).join(sums.select("part", "chunk", upto("s"), upto("c")), ["part", "chunk"])
    hi = F.col("s0") + F.col("sum")
    return rows.select("chunk", (F.col("c0") + F.col("no") - 1).alias("k"), (hi - F.col("cnt")).alias("lo"), hi.alias("hi"), "repl")


def candidates(table: DataFrame, page_rows: int = PAGE, held: bool = False) -> Candidates:
    """Replacements of each chunk in order with running counts. A chunk of more than
    `page_rows` is a tree of pages, so none is listed in one row or sorted in one task.
    A table that is `held` is cut from its lineage already."""
    checkpoint_dir(table.sparkSession)
    table = table.select("chunk", "replacement", "cnt")
    table = table if held else table.checkpoint()
    sizes = table.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min("replacement").alias("first"))
    sizes = sizes.checkpoint()
    most, entries = sizes.agg(F.max("n"), F.sum("n")).first()
    no_child = F.lit(None).cast("long").alias("child")
    few, tops, pages = table, [], []
    if (most or 0) > page_rows:
        big = sizes.where(F.col("n") > page_rows).select("chunk", "n")
        few = spread_join(table, big, ["chunk"], "left_anti", ["replacement"], left_rows="n")
        many = spread_join(table, big, ["chunk"], "left_semi", ["replacement"], left_rows="n")
        rows = _running(many).withColumn("child", no_child)
        while most > 1:
            paged = rows.withColumn("page", F.floor(F.col("k") / F.lit(float(page_rows))))
            pages.insert(0, _slots(paged, ["chunk", "page"]).checkpoint())
            most = -(-most // page_rows)
            rows = pages[0].select(
                "chunk", F.col("page").alias("k"), "lo", (F.col("lo") + F.col("total")).alias("hi"),
                F.lit(None).cast("string").alias("repl"), F.col("page").alias("child"),
            )
        tops = [pages.pop(0).select("chunk", "total", "slots")]
    running = Window.partitionBy("chunk").orderBy("replacement").rowsBetween(Window.unboundedPreceding, 0)
    hi = F.sum("cnt").over(running)
    spans = few.select("chunk", F.col("replacement").alias("repl"), no_child, (hi - F.col("cnt")).alias("lo"), hi.alias("hi"))
    top = union_all(_slots(spans, ["chunk"]).select("chunk", "total", "slots"), *tops)
    return Candidates(top.join(sizes, "chunk").checkpoint(), pages, entries or 0)


def drawn(
    joined: DataFrame, found: Candidates, salt_by: list[str], out: str = "_repl", max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """The replacement for the count `_at` of rows that were joined to `found.top` by chunk;
    null where the chunk is unknown."""
    rows = joined.withColumn("_e", pick_entry(F.col("_at"), F.col("total"), F.col("slots")))
    for pages in found.pages:
        below = pages.select("chunk", F.col("page").alias("_child"), F.col("lo").alias("_lo"),
                             F.col("total").alias("_width"), F.col("slots").alias("_near"))
        rows = rows.drop("total", "slots").withColumn("_child", F.col("_e")["child"])
        rows = lookup_join(rows, below, ["chunk", "_child"], "left", salt_by, max_rows // PAGE)
        rows = rows.withColumn("_rel", F.col("_at") - F.col("_lo"))
        lower = pick_entry(F.col("_rel"), F.col("_width"), F.col("_near"))
        rows = rows.withColumn("_e", F.when(F.col("_child").isNull(), F.col("_e")).otherwise(lower))
        rows = rows.drop("_child", "_lo", "_width", "_near", "_rel")
    return rows.withColumn(out, F.col("_e")["repl"]).drop("_e")

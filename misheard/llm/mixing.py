"""Mixing sources to target weights by a time-varying curriculum, with DataFrame
functions only.

Each source has a target number of words (its share of the budget, at most
`max_repeats` times its size, the excess reshared by weight) and a weight
schedule over the training run. The documents of a source stand in a seeded
order; their copies take the source's words in turn until the target is
reached. The schedule is integrated to the source's cumulative demand for
words; a copy's training position is the time at which that demand reaches the
words before it. The copies are then range-sorted by position.

Nothing is drawn: the order is a digest of the id, so reruns agree. Null and
empty texts have size zero and are never taken; a null source is a source of its
own; rows that repeat an id are documents of their own, ordered by size and
then by the digest of all columns. No rows give no rows.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from misheard.llm.common import WORD, attach, cut

# Weight over time per source in turn, as (time, weight) knots joined by lines:
# the first fades out, the second is steady, the third fades in.
SCHEDULES = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 0.75), (1.0, 2.0)),
)
WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MAX_REPEATS = 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def progress(share: Column, knots: tuple) -> Column:
    """The time in 0..1 at which a schedule has asked for `share` of its words:
    the inverse of the integral of the piecewise linear weight."""
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:])]
    total, out, before = sum(areas), None, 0.0
    for k, ((t0, w0), (t1, w1)) in enumerate(zip(knots, knots[1:])):
        rest = share * F.lit(float(total)) - F.lit(before)
        # w0 x + slope x^2 / 2 = rest, in the form that also holds for slope 0
        slope = (w1 - w0) / (t1 - t0)
        root = F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + F.lit(2 * slope) * rest))
        at = F.lit(t0) + (F.lit(2.0) * rest) / (F.lit(w0) + root)
        before += areas[k]
        last = k == len(areas) - 1
        out = at if out is None and last else (
            F.when(share * F.lit(float(total)) <= F.lit(before), at) if out is None
            else out.otherwise(at) if last
            else out.when(share * F.lit(float(total)) <= F.lit(before), at)
        )
    return out


def source_targets(
    per_source: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, max_repeats: int = MAX_REPEATS
) -> DataFrame:
    """From (source, source_size, rows) to these and source_no and target.

    Water filling in closed form: with sources by rising cap per weight, a level
    is reached at which the first source stays below its cap; that source and
    all later ones get level times weight, the ones before their cap. The
    windows run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    t = per_source.withColumn("source_no", F.row_number().over(by_name) - 1).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % n) + 1)
    )
    cap = F.col("source_size") * F.lit(max_repeats)
    t = t.withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    rising = Window.orderBy("ratio", "source_no")
    whole = Window.partitionBy()
    t = t.withColumn(
        "level",
        (
            F.lit(float(budget)) * F.sum("source_size").over(whole)
            - F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        )
        / F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing)),
    )
    # the level falls again once a source below its cap has been passed
    t = t.withColumn("level", F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(whole))
    return t.withColumn(
        "target",
        F.when(F.col("level").isNull() | (F.col("ratio") <= F.col("level")), F.col("cap").cast("double"))
        .otherwise(F.col("level") * F.col("weight")),
    ).select("source", "source_size", "rows", "source_no", "target")


def _assign(
    docs: DataFrame,
    keep: list[str],
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple = WEIGHTS,
    budget: float = BUDGET,
    max_repeats: int = MAX_REPEATS,
    schedules: tuple = SCHEDULES,
    seed: int = 0,
) -> DataFrame:
    """(row, mix): the `keep` columns of every document as a struct, and what
    `assign` says of it.

    Sizes are read once into a narrow table; the words before a document are
    found from sums per bucket of the order (about the square root of the
    source's rows per bucket), so a hot source is spread over many tasks.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit(""))
    order = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    named = docs.select(
        F.struct(*keep).alias("_row"),
        F.col(source_col).alias("_source"),
        key.alias("_key"),
        order.alias("_order"),
        word_count(F.col(text_col)).alias("_size"),
        F.xxhash64(*keep).alias("_tie"),
    )
    sized = cut(named.select("_source", "_key", "_order", "_size"))
    per_source = sized.groupBy("_key").agg(
        F.first("_source").alias("source"), F.sum("_size").alias("source_size"), F.count(F.lit(1)).alias("rows")
    )
    targets = source_targets(per_source.drop("_key"), weights, budget, max_repeats).select(
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("_key"),
        F.col("rows").alias("_rows"), "source_no", "source_size", "target",
        F.ceil(F.sqrt("rows")).cast("long").alias("_buckets"),
    )
    targets = cut(targets)
    # the first 8 hex digits of the order as a fraction, cut into buckets
    bucket = F.floor(
        F.conv(F.substring("_order", 1, 8), 16, 10).cast("double") / F.lit(float(2**32)) * F.col("_buckets")
    ).cast("long")
    sums = (
        attach(sized, targets, ["_key"], "_rows", ["_order"])
        .groupBy("source_no", bucket.alias("_bucket"))
        .agg(F.sum("_size").alias("_words"), F.count(F.lit(1)).alias("_n"))
    )
    along = Window.partitionBy("source_no").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(
        sums.select("source_no", "_bucket", "_n", F.coalesce(F.sum("_words").over(along), F.lit(0)).alias("_offset"))
    )
    within = (
        Window.partitionBy("source_no", "_bucket").orderBy("_order", "_size", "_tie")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = attach(named.drop("_source"), targets, ["_key"], "_rows", ["_order", "_tie"]).withColumn("_bucket", bucket)
    placed = attach(placed, offsets, ["source_no", "_bucket"], "_n", ["_order", "_tie"]).withColumn(
        "_before", F.col("_offset") + F.coalesce(F.sum("_size").over(within), F.lit(0))
    )
    wanted = F.floor(F.col("target") + 0.5).cast("long")
    turn = F.col("source_no") % len(schedules)
    copies = []
    for k in range(max_repeats):
        start = F.lit(k) * F.col("source_size") + F.col("_before")
        words = F.least(wanted - start, F.col("_size"))
        share = start.cast("double") / F.greatest(wanted, F.lit(1))
        at = progress(share, schedules[0])
        for no, knots in enumerate(schedules[1:], 1):
            at = F.when(turn == no, progress(share, knots)).otherwise(at)
        copies.append(F.when(words > 0, F.struct(words.alias("words"), at.alias("position"))))
    taken = sum((F.greatest(F.least(wanted - (F.lit(k) * F.col("source_size") + F.col("_before")), F.col("_size")),
                            F.lit(0)) for k in range(max_repeats)), F.lit(0))
    return placed.select(
        F.col("_row").alias("row"),
        F.struct(
            F.col("_size").alias("size"), "source_size", "target", taken.cast("long").alias("taken"),
            F.array_compact(F.array(*copies)).alias("copies"),
        ).alias("mix"),
    )


def assign(docs: DataFrame, keep: list[str], **options) -> DataFrame:
    """The `keep` columns of every document (none named mix) with `mix`: a struct
    of size, source_size, target, taken, and copies (array of words, position in
    0..1; a copy with fewer words than the document ends the source's share)."""
    return _assign(docs, keep, **options).select("row.*", "mix")


def first_words(text: Column, words: Column) -> Column:
    """The text up to the end of its given number of words."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), 1, words), "")


def by_position(df: DataFrame, position: Column, *ties: Column) -> DataFrame:
    """Range-sorted by training position, rows without one last."""
    order = [position.asc_nulls_last(), *ties]
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def mix(docs: DataFrame, text_col: str = "text", length_col: str | None = None, **options) -> DataFrame:
    """The training mix: one row per copy taken, with the columns of `docs`,
    sorted by training position. A copy that ends its source's share keeps its
    first words only; `length_col`, if given, is then set to its new length.
    Options as for `assign`."""
    rows = _assign(docs, docs.columns, text_col=text_col, **options)
    rows = rows.select("row", F.col("mix.size").alias("size"), F.explode("mix.copies").alias("copy"))
    old, whole = F.col("row")[text_col], F.col("copy.words") == F.col("size")
    text = F.when(whole, old).otherwise(first_words(old, F.col("copy.words").cast("int")))
    columns = [text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns]
    rows = rows.select(F.struct(*columns).alias("row"), "copy", whole.alias("whole"))
    if length_col:
        length = F.when(F.col("whole"), F.col("row")[length_col]).otherwise(F.length(F.col("row")[text_col]))
        rows = rows.withColumn("row", F.col("row").withField(length_col, length))
    return by_position(rows, F.col("copy.position"), F.xxhash64("row")).select("row.*")

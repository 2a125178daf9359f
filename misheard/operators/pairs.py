"""Reference/hypothesis pairs: padding, guards, alignment, column pairs."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from misheard import constants as K
from misheard.functions.align import align_column
from misheard.functions.sweep import best_sweep_column, sweep_column
from misheard.functions.text import chars
from misheard.operators.joins import require_strings

NULL, OK_EQUAL, EMPTY, TOO_DIFFERENT, ALIGN = "null", "equal", "empty", "too_different", "align"


def pad_pair(ref: Column, hyp: Column) -> tuple[Column, Column]:
    """Both strings right-padded with gaps to the longer length."""
    n = F.greatest(F.length(ref), F.length(hyp))
    return F.rpad(ref, n, K.GAP), F.rpad(hyp, n, K.GAP)


def pair_status(ref: Column, hyp: Column) -> Column:
    """`null`, `empty`, `equal`, `too_different` or `align`."""
    a, b = F.length(ref), F.length(hyp)
    return (
        F.when(ref.isNull() | hyp.isNull(), NULL)
        .when((a == 0) | (b == 0), EMPTY)
        .when(ref == hyp, OK_EQUAL)
        # |a-b| / max >= cut, in whole numbers
        .when(F.abs(a - b) * 10 >= F.greatest(a, b) * int(K.LENGTH_RATIO_CUT * 10), TOO_DIFFERENT)
        .otherwise(ALIGN)
    )


def align_pairs(
    df: DataFrame,
    ref: str = "ref",
    hyp: str = "hyp",
    purifier: Callable[[Column], Column] = lambda c: c,
    band: int | None = K.ALIGN_BAND,
) -> DataFrame:
    """Add `status`, `ref_aln`, `hyp_aln`. Equal pairs pass through, rejected
    pairs keep null alignments and their status; only the rest is aligned."""
    require_strings(df, ref, hyp)
    guarded = df.withColumn(ref, purifier(F.col(ref))).withColumn(hyp, purifier(F.col(hyp)))
    guarded = guarded.withColumn("status", pair_status(F.col(ref), F.col(hyp)))
    todo = F.col("status") == ALIGN
    aligned = guarded.withColumn(
        "_aln", align_column(F.when(todo, F.col(ref)), F.when(todo, F.col(hyp)), band)
    )
    same = F.col("status") == OK_EQUAL
    return aligned.withColumn(
        "ref_aln", F.when(same, F.col(ref)).otherwise(F.col("_aln.ref_aln"))
    ).withColumn("hyp_aln", F.when(same, F.col(hyp)).otherwise(F.col("_aln.hyp_aln"))).drop("_aln")


def align_windows(df: DataFrame, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """Unbanded alignment of every pair, no guard; empty pairs stay as they are."""
    require_strings(df, ref, hyp)
    return (
        df.withColumn("_aln", align_column(F.col(ref), F.col(hyp), None))
        .withColumns({"ref_aln": F.col("_aln.ref_aln"), "hyp_aln": F.col("_aln.hyp_aln")})
        .drop("_aln")
    )


def sweep_pairs(df: DataFrame, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """Add `sweeps`: one scored alignment per sweep configuration."""
    require_strings(df, ref, hyp)
    return df.withColumn("sweeps", sweep_column(F.col(ref), F.col(hyp)))


def best_sweep(df: DataFrame) -> DataFrame:
    """Keep the highest score, the first configuration on ties. All zero gives
    a single space on both sides; two empty strings give null."""
    best = F.array_max(
        F.transform(
            "sweeps",
            lambda s: F.struct(s["score"], (-s["cfg"]).alias("neg"), s["ref_aln"].alias("r"), s["hyp_aln"].alias("h")),
        )
    )
    won = F.col("_best.score")
    blank = (won == 0) & F.col("_best").isNotNull()
    return (
        df.withColumn("_best", best)
        .withColumns(
            {
                "score": won,
                "cfg": F.when(won > 0, -F.col("_best.neg")),
                "ref_aln": F.when(blank, " ").otherwise(F.col("_best.r")),
                "hyp_aln": F.when(blank, " ").otherwise(F.col("_best.h")),
            }
        )
        .drop("_best", "sweeps")
    )


def align_by_sweep(df: DataFrame, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """`best_sweep` of `sweep_pairs` at once: only the best outcome is kept."""
    require_strings(df, ref, hyp)
    found = ("score", "cfg", "ref_aln", "hyp_aln")
    return (
        df.withColumn("_best", best_sweep_column(F.col(ref), F.col(hyp)))
        .withColumns({c: F.col(f"_best.{c}") for c in found})
        .drop("_best")
    )


def column_pairs(df: DataFrame, keys: list[str], ref: str = "ref_aln", hyp: str = "hyp_aln") -> DataFrame:
    """One row per column of aligned pairs: `col`, `ref_ch`, `hyp_ch`."""
    zipped = F.arrays_zip(chars(F.col(ref)).alias("a"), chars(F.col(hyp)).alias("b"))
    return df.select(*keys, F.posexplode(zipped).alias("col", "_z")).select(
        *keys, "col", F.col("_z.a").alias("ref_ch"), F.col("_z.b").alias("hyp_ch")
    )

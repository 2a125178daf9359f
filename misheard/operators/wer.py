"""Word error rate."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from misheard.functions.text import bind, both_long_enough, words

_CODES = 94      # printable one-byte characters after the space


def _distances(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Edit distance over long word lists; a column of the table is one integer
    of rises and one of falls."""
    for refs, hyps in batches:
        out = []
        for a, b in zip(refs, hyps):
            if a is None or b is None:
                out.append(None)
                continue
            a, b = list(a), list(b)
            if not a or not b:
                out.append(max(len(a), len(b)))
                continue
            full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
            at: dict = {}
            for i, w in enumerate(a):
                at[w] = at.get(w, 0) | (1 << i)
            rise, fall, score = full, 0, len(a)
            for w in b:
                eq = at.get(w, 0)
                xv = eq | fall
                xh = (((eq & rise) + rise) ^ rise) | eq
                ph, mh = (fall | ~(xh | rise)) & full, rise & xh
                score += bool(ph & last) - bool(mh & last)
                ph, mh = ((ph << 1) | 1) & full, (mh << 1) & full
                rise, fall = (mh | ~(xv | ph)) & full, ph & xv
            out.append(score)
        yield pd.Series(out, dtype="Int32")


def word_edits(ref: Column, hyp: Column, max_codes: int = _CODES) -> Column:
    """Word edits between two strings. Each distinct word of the pair becomes
    one character and the built-in distance runs over those; pairs with more
    distinct words than one-byte characters go through the Arrow function."""
    both = F.struct(words(ref).alias("a"), words(hyp).alias("b"))
    listed = F.array_union(both["a"], both["b"])
    few = F.size(listed) <= max_codes

    def coded(ws: Column, vocabulary: Column) -> Column:
        return F.array_join(
            F.transform(ws, lambda w: F.char((F.array_position(vocabulary, w) + 32).cast("long"))), ""
        )

    native = bind(
        F.struct(both["a"].alias("a"), both["b"].alias("b"), listed.alias("v")),
        lambda p: F.levenshtein(coded(p["a"], p["v"]), coded(p["b"], p["v"])),
    )
    rare = F.pandas_udf(_distances, "int")(F.when(~few, both["a"]), F.when(~few, both["b"]))
    return F.when(few, native).otherwise(rare)


def scored_pairs(df: DataFrame, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """Pairs long enough to count, with `edits` and `ref_words`."""
    return df.where(both_long_enough(F.col(ref), F.col(hyp))).withColumns(
        {"edits": word_edits(F.col(ref), F.col(hyp)), "ref_words": F.size(words(F.col(ref)))}
    )


def word_error_rate(df: DataFrame, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """One row: edits, ref_words, wer."""
    return (
        scored_pairs(df, ref, hyp)
        .agg(F.sum("edits").alias("edits"), F.sum("ref_words").alias("ref_words"))
        .withColumn("wer", F.when(F.col("ref_words") > 0, F.col("edits") / F.col("ref_words")))
    )

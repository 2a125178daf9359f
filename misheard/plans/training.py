"""Learning confusions, corrupting corpora, training pairs."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from misheard import constants as K
from misheard.functions.text import render_pair, with_markers, within_budget
from misheard.functions.windows import auto_split, balanced_split, char_windows, word_windows
from misheard.functions.text import words
from misheard.operators.clips import actual_sentences, evaluation_pairs
from misheard.operators.confusion import forward_table, merge_tables, reverse_table
from misheard.operators.noise import corrupt
from misheard.operators.pairs import align_by_sweep, align_pairs

Tokenize = Callable[[Column], Column]


def test_pairs(train: DataFrame, test: DataFrame, predicted: DataFrame, strict: bool = True) -> DataFrame:
    """(path, ref, hyp): one pair per listed row of the test split."""
    actual = test.select("path").join(actual_sentences(train, test).select("path", "sentence"), "path")
    heard = predicted.join(test.select("path"), "path", "left_semi")
    return evaluation_pairs(actual, heard, strict)


def learn_confusions(pairs: DataFrame, order: int = K.CONFUSION_ORDER, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """Best sweep alignment of every pair, then the forward table."""
    return forward_table(align_by_sweep(pairs.select(ref, hyp), ref, hyp), order)


def learn_from_clips(train: DataFrame, test: DataFrame, predicted: DataFrame, order: int = K.CONFUSION_ORDER) -> DataFrame:
    """The forward table of the recognised test split."""
    return learn_confusions(test_pairs(train, test, predicted), order)


def fit_reverse(
    pairs: DataFrame,
    max_gram: int = K.MAX_GRAM,
    purifier: Callable[[Column], Column] = lambda c: c,
    prior: DataFrame | None = None,
    ref: str = "ref",
    hyp: str = "hyp",
) -> DataFrame:
    """Banded alignment, then the reverse table, added to a prior one."""
    aligned = align_pairs(pairs.select(ref, hyp), ref, hyp, purifier).where(F.col("ref_aln").isNotNull())
    table = reverse_table(aligned, max_gram)
    return table if prior is None else merge_tables(prior, table)


def window_rows(df: DataFrame, keys: list[str], sentence: str = "sentence") -> DataFrame:
    """(keys, win_no, window): overlapping word windows."""
    return df.select(*keys, F.posexplode(word_windows(F.col(sentence))).alias("win_no", "window"))


def char_window_rows(df: DataFrame, keys: list[str], sentence: str = "sentence") -> DataFrame:
    return df.select(*keys, F.posexplode(char_windows(F.col(sentence))).alias("win_no", "window"))


def balanced_rows(df: DataFrame, keys: list[str], n, sentence: str = "sentence") -> DataFrame:
    """(keys, part_no, part): n balanced parts of every sentence."""
    return df.select(*keys, F.posexplode(balanced_split(words(F.col(sentence)), n)).alias("part_no", "part"))


def budget_rows(
    df: DataFrame, keys: list[str], token_lengths: Callable[[Column], Column], joiner: int = 0, sentence: str = "sentence"
) -> DataFrame:
    """(keys, part_no, part): the fewest balanced parts within the token limit.
    `token_lengths` maps the word array to the tokens of each word."""
    w = words(F.col(sentence))
    return df.select(*keys, F.posexplode(auto_split(w, token_lengths(w), joiner)).alias("part_no", "part"))


def token_pairs(df: DataFrame, keys: list[str], corrupted: str, clean: str, tokenize: Tokenize) -> DataFrame:
    """(keys, line): both sides tokenised, over-long pairs dropped, rendered."""
    both = df.select(
        *keys,
        with_markers(tokenize(F.col(corrupted))).alias("_noisy"),
        with_markers(tokenize(F.col(clean))).alias("_clean"),
    )
    return both.where(within_budget(F.col("_noisy"), F.col("_clean"))).select(
        *keys, render_pair(F.col("_noisy"), F.col("_clean")).alias("line")
    )


def noisy_training_pairs(
    sentences: DataFrame, keys: list[str], table: DataFrame, tokenize: Tokenize, seed: int = 0, sentence: str = "sentence"
) -> DataFrame:
    """Word windows, each with its corrupted copy, as token pair lines."""
    rows = window_rows(sentences, keys, sentence)
    wkeys = [*keys, "win_no"]
    return token_pairs(corrupt(rows, wkeys, "window", table, seed), wkeys, "corrupted", "window", tokenize)


def validation_pairs(pairs: DataFrame, tokenize: Tokenize, swap: bool = False) -> DataFrame:
    """Recognised/clean token pair lines of evaluation pairs (path, ref, hyp).
    `swap` puts the recognised text on the clean side."""
    noisy, clean = ("ref", "hyp") if swap else ("hyp", "ref")
    return token_pairs(pairs, ["path"], noisy, clean, tokenize)


def longest_tokens(df: DataFrame, keys: list[str], tokens: str) -> DataFrame:
    """Longest tokenisation per key."""
    return df.groupBy(*keys).agg(F.max(F.size(tokens)).alias("max_tokens"))

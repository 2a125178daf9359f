"""Windows of a table of confusions are counted by their longest ones."""

from pyspark.sql import functions as F

from misheard.operators import confusion


def test_windows_of_a_repeated_pair_are_cut_once(spark):
    rows = [("ab?dé", "a?cdé")] * 50 + [("x", "?"), ("", ""), (None, None), ("a" * 300, "b" * 300)]
    df = spark.createDataFrame(rows, "ref_aln string, hyp_aln string")
    found = confusion.window_counts(df, 3)
    every = confusion.aligned_windows(df, [], 3).groupBy("ref_win", "hyp_win").agg(F.count(F.lit(1)).alias("cnt"))
    summed = found.groupBy("ref_win", "hyp_win").agg(F.sum("cnt").alias("cnt"))
    assert sorted(summed.collect()) == sorted(every.collect())
    assert found.count() < 25            # not a row for each of 1,500 windows

"""Windows are cut out of blocks of a few columns, also of long pairs."""

from misheard.operators import confusion, suggest


def test_windows_across_blocks_and_stretches(spark):
    a = "".join(chr(97 + i * i % 23) for i in range(1100))
    pairs = [(1, a, a[::-1]), (2, a[:32], a[1:33]), (3, a[:513], a[:513]), (4, "", ""), (5, None, None)]
    df = spark.createDataFrame(pairs, "id int, ref_aln string, hyp_aln string")
    got = sorted(tuple(r) for r in confusion.aligned_windows(df, ["id"], 11).collect())
    assert got == sorted(
        (k, n, i + 1, x[i : i + n], y[i : i + n]) for k, x, y in pairs if x for n in range(1, 12) for i in range(len(x) - n + 1)
    )
    cut = suggest.spans(df, ["id"], "ref_aln", 12).collect()
    assert sorted(tuple(r) for r in cut) == sorted(
        (k, i, n, x[i : i + n]) for k, x, _ in pairs if x for n in range(1, 12) for i in range(len(x) - n + 1)
    )


def test_blocks_hold_few_columns(spark):
    """A window is found by walking from the start of its block."""
    df = spark.createDataFrame([("a" * 1000, "b" * 1000)], "ref_aln string, hyp_aln string")
    lengths = [len(r["_r"]) for r in confusion._blocks(df, [], 11, "ref_aln", "hyp_aln").collect()]
    assert sum(lengths) >= 1000 and max(lengths) <= 64

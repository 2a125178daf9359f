import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import inputs as I
from misheard.functions.draws import draw, draw_np, row_seed
from misheard.operators import confusion, noise, suggest
from misheard.operators import joins as J
from misheard.plans import training
from misheard.plans.corpus import SENTENCE_KEY as SK

SF = "/root/testdata/sf0.001"


def same(a, b):
    b = b.select(a.columns)
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_draws_agree_and_are_even(spark):
    rs = row_seed(5, F.col("id"))
    got = spark.range(2000).select(rs.alias("rs"), F.col("id").alias("k"), draw(rs, F.col("id"), 1).alias("d")).toPandas()
    assert (draw_np(got["rs"], got["k"], 1) == got["d"]).all()
    per_position = spark.range(40000).select(draw(F.lit(12345), F.col("id")).alias("d")).toPandas()["d"]
    assert abs((per_position % 10).value_counts() / 4000 - 1).max() < 0.08
    assert abs(np.corrcoef(per_position[:-1], per_position[1:])[0, 1]) < 0.02


def test_chunks_rejoin_and_are_even(spark):
    s = I.sentences(spark, SF)
    got = s.select("sentence", noise.random_chunks(row_seed(1, *[F.col(k) for k in SK]), F.col("sentence")).alias("c"))
    assert got.where(F.array_join("c", "") != F.col("sentence")).count() == 0
    sizes = got.select(F.explode(F.slice("c", F.lit(1), F.size("c") - 1)).alias("x")).groupBy(F.length("x")).count().toPandas()
    assert sorted(sizes.iloc[:, 0]) == [1, 2, 3, 4]
    assert (sizes["count"] / sizes["count"].mean()).between(0.95, 1.05).all()
    with pytest.raises(ValueError):
        noise.random_chunks(F.lit(1), F.lit("a"), (1, 2, 3))


def test_identity_table_changes_nothing(spark):
    s = I.sentences(spark, SF)
    ident = spark.createDataFrame([(c, c, 3) for c in ["a", "e", "th", "ion", " "]], "chunk string, replacement string, cnt long")
    got = noise.corrupt(s, SK, "sentence", ident, 1)
    assert got.count() == s.count() and got.where("corrupted != sentence").count() == 0


def test_same_for_any_partitioning_and_join(spark):
    s, t = I.sentences(spark, SF), I.seed_table(spark)
    one = noise.corrupt(s.coalesce(1), SK, "sentence", t, 1)
    assert same(one, noise.corrupt(s.repartition(8), SK, "sentence", t, 1))
    assert same(one, noise.corrupt(s, SK, "sentence", t, 1, max_rows=0))     # shuffled lookup
    assert not same(one, noise.corrupt(s, SK, "sentence", t, 2))


def test_corrupt_edge_cases(spark):
    df = spark.createDataFrame([(1, ""), (2, "zzzzzzzzzzzz")], "id long, t string")
    t = spark.createDataFrame([("a", "b", 1)], "chunk string, replacement string, cnt long")
    got = {r["id"]: r["corrupted"] for r in noise.corrupt(df, ["id"], "t", t, 1).collect()}
    assert got == {1: "", 2: "z" * 12}
    cut = {r["id"]: r["corrupted"] for r in noise.corrupt(df, ["id"], "t", t, 1, sizes=(4,), truncate_to=3).collect()}
    assert cut == {1: "", 2: "z" * 9}


def test_picks_follow_the_counts(spark):
    t = spark.createDataFrame([("a", "x", 700), ("a", "y", 200), ("a", "z", 100)], "chunk string, replacement string, cnt long")
    df = spark.createDataFrame([(i, "a" * 50) for i in range(200)], "id long, t string")
    text = "".join(r[0] for r in noise.corrupt(df, ["id"], "t", t, 1, sizes=(1,)).select("corrupted").collect())
    assert len(text) == 10000
    assert [round(text.count(c) / 10000, 1) for c in "xyz"] == [0.7, 0.2, 0.1]


@pytest.mark.parametrize("n, page_rows, levels", [(1_000_000, 256, 3), (500, 4, 5)])
def test_picks_among_very_many_replacements(spark, n, page_rows, levels):
    """A chunk of a million replacements beside a short one; one replacement holds most of the count."""
    cnt = F.when(F.col("id") == n // 3, 10 * n).otherwise(F.col("id") % 5 + 1)
    long = spark.range(n).select(F.lit("a").alias("chunk"), F.lpad(F.col("id").cast("string"), 7, "0").alias("replacement"), cnt.alias("cnt"))
    short = spark.createDataFrame([("b", "x", 2), ("b", "y", 3)], "chunk string, replacement string, cnt long")
    found = confusion.candidates(long.unionByName(short), page_rows)
    assert len(found.pages) == levels - 1 and found.entries == n + 2
    for rows in (found.top, *found.pages):
        widest = F.max(F.greatest(F.size("slots"), F.array_max(F.transform("slots", F.size))))
        assert rows.agg(widest).first()[0] <= page_rows
    ids = np.arange(n)
    hi = np.where(ids == n // 3, 10 * n, ids % 5 + 1).cumsum()
    at = [*range(20), *(hi[-1] - 1 - np.arange(20)), *np.random.default_rng(1).integers(0, hi[-1], 300), hi[n // 3], hi[n // 3] - 1]
    asked = [("a", int(x)) for x in at] + [("b", k) for k in range(5)] + [("c", 0)]
    for max_rows in (J.BROADCAST_ROWS, 0):
        rows = spark.createDataFrame(asked, "chunk string, _at long").join(found.top, "chunk", "left")
        got = confusion.drawn(rows, found, ["chunk", "_at"], max_rows=max_rows).select("chunk", "_at", "_repl").collect()
        want = {("a", int(x)): f"{np.searchsorted(hi, x, 'right'):07d}" for x in at}
        want |= {("b", k): "x" if k < 2 else "y" for k in range(5)} | {("c", 0): None}
        assert {(r[0], r[1]): r[2] for r in got} == want


def test_spread_join_equals_join(spark):
    left = spark.range(5000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(
            F.concat(F.lit("k"), (F.col("id") % 40).cast("string"))).alias("k")
    )
    right = left.where("k is not null and k != 'k7'").select("k").distinct().withColumn("v", F.length("k"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert same(left.join(right, "k", how), J.spread_join(left, right, ["k"], how, ["id"], 100))


def brute_tables(pairs, order, max_gram):
    fwd, rev = {}, {}
    for a, b in pairs:
        for n in range(1, max(order, max_gram - 1) + 1):
            for i in range(len(a) - n + 1):
                x, y = a[i:i + n], b[i:i + n]
                cx, cy = x.replace("?", ""), y.replace("?", "")
                if n <= order and x != "?":
                    fwd[cx, cy] = fwd.get((cx, cy), 0) + 1
                if n < max_gram and cy:
                    rev[cy, cx] = rev.get((cy, cx), 0) + 1
    return fwd, rev


def test_confusion_tables(spark, monkeypatch):
    monkeypatch.setattr(confusion, "_BLOCK", 4)
    pairs = [("ab?cdefghij", "a?xcdefg?ij"), ("abc", "abd"), ("", ""), ("??a", "bba")]
    df = spark.createDataFrame(pairs, "ref_aln string, hyp_aln string")
    fwd, rev = brute_tables(pairs, 3, 12)
    as_dict = lambda t: {(r["chunk"], r["replacement"]): r["cnt"] for r in t.collect()}
    assert as_dict(confusion.forward_table(df)) == fwd
    assert as_dict(confusion.reverse_table(df)) == rev
    twice = confusion.merge_tables(confusion.reverse_table(df), confusion.reverse_table(df))
    assert as_dict(twice) == {k: 2 * v for k, v in rev.items()}
    with pytest.raises(Exception, match="differ in length"):
        confusion.forward_table(spark.createDataFrame([("ab", "a")], "ref_aln string, hyp_aln string")).collect()


def test_suggestions(spark):
    df = spark.createDataFrame([(1, "abcabcabd"), (2, ""), (3, "zz")], "id long, t string")
    ident = spark.createDataFrame(
        [(c, c, 1) for c in ["a", "b", "c", "ab", "abcab", "d"]], "chunk string, replacement string, cnt long"
    )
    got = suggest.suggestions(df, ["id"], "t", ident, n=50, seed=1)
    texts = {1: "abcabcabd", 2: "", 3: "zz"}
    rows = got.collect()
    assert len(rows) == 150 and all(r["suggestion"] == texts[r["id"]] for r in rows)
    swap = spark.createDataFrame([("a", "x", 1), ("b", "y", 1)], "chunk string, replacement string, cnt long")
    only = spark.createDataFrame([(1, "abab")], "id long, t string")
    assert {r["suggestion"] for r in suggest.suggestions(only, ["id"], "t", swap, n=20).collect()} == {"xyxy"}
    assert same(got, suggest.suggestions(df.repartition(4), ["id"], "t", ident, n=50, seed=1, max_rows=0))


def test_fit_and_learn(spark):
    df = spark.createDataFrame([("la casa blu", "la caza blu"), ("abc", "abc"), ("", "x")], "ref string, hyp string")
    rev = training.fit_reverse(df, max_gram=3)
    # a substitution in place stays in its column
    assert rev.where("chunk = 'z' and replacement = 's'").first()["cnt"] == 1
    more = training.fit_reverse(df, max_gram=3, prior=rev)
    assert more.where("chunk = 'z' and replacement = 's'").first()["cnt"] == 2
    fwd = training.learn_confusions(df)
    assert fwd.where("chunk = 'c' and replacement = 'c'").first()["cnt"] == 2


def test_any_character_survives_corruption(spark):
    """Control characters, marks and line breaks are text like any other."""
    text = "ab\x02cd\x01ef|g-h\n\t|é😀" * 20
    df = spark.createDataFrame([(1, text), (2, ""), (3, "x")], "k long, t string")
    table = spark.createDataFrame([("zzz", "y", 1)], "chunk string, replacement string, cnt long")
    got = {r["k"]: r["corrupted"] for r in noise.corrupt(df, ["k"], "t", table, seed=3).collect()}
    assert got == {1: text, 2: "", 3: "x"}


def test_truncated_replacements(spark):
    df = spark.createDataFrame([(k, "abcd") for k in range(20)], "k long, t string")
    table = spark.createDataFrame([(c, "wxyz", 1) for c in ("a", "ab", "abc", "abcd")], "chunk string, replacement string, cnt long")
    got = {r["corrupted"][:4] for r in noise.corrupt(df, ["k"], "t", table, truncate_to=2).collect()}
    assert all(g.startswith("wx") and "y" not in g for g in got)

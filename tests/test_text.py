import math
import random

import pytest
from pyspark.sql import functions as F

from misheard.functions import text as T
from misheard.functions import windows as W
from misheard.plans.corpus import clean_corpus, head
from misheard.sources.text import lines_of


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


def test_purify(spark):
    for text, want in [
        ("Ab-c, D\té?!", "abc dé"), ("  È  l'A ", "è  l'a"), ("1a_2", "a"), ("", ""), ("ŠÙ", "šù"), ("ñç", ""),
    ]:
        assert one(spark, text, T.purify) == want


def test_lines(spark):
    df = spark.createDataFrame([(1, "a\nb\r\nc\rd\n"), (2, ""), (3, "x\n\ny")], "doc_id long, text string")
    got = [(r["doc_id"], r["line_no"], r["line"]) for r in lines_of(df).collect()]
    assert got == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (1, 3, "d"), (3, 0, "x"), (3, 1, ""), (3, 2, "y")]


def test_sentences(spark):
    assert one(spark, "A b. C? D!E f.  G", T.sentences) == ["A b.", "C?", "D!E f.", "G"]


@pytest.mark.parametrize("n", [1, 21, 22, 23, 33, 34, 44, 45, 100])
def test_word_windows(spark, n):
    words = [f"w{i}" for i in range(n)]
    want, at = [], 0
    if n < 22:
        want = [words]
    else:
        while at + 22 < n:
            want.append(words[at:at + 22])
            at += 11
        want.append(words[at:])
    assert one(spark, " ".join(words), W.word_windows) == [" ".join(w) for w in want]


@pytest.mark.parametrize("n", [0, 99, 100, 124, 125, 126, 250])
def test_char_windows(spark, n):
    text = "".join(chr(97 + i % 26) for i in range(n))
    want = [text]
    if n >= 100:
        want, at = [], 0
        while at + 100 <= n:
            want.append(text[at:at + 100])
            at += 25
        want.append(text[at:])
    assert one(spark, text, W.char_windows) == want


def cut(words, n):
    base, extra = divmod(len(words), n)
    at, out = 0, []
    for c in range(n):
        size = base + (c < extra)
        out.append(words[at:at + size])
        at += size
    return out


def test_splits(spark):
    r = random.Random(3)
    rows = []
    for _ in range(120):
        ws = ["x" * r.choice([1, 2, 3, 5, 8, 13, 21, 30 if r.random() < 0.05 else 2]) for _ in range(r.randint(1, 60))]
        rows.append((" ".join(ws), r.randint(1, len(ws))))
    df = spark.createDataFrame(rows, "t string, n int")
    w = T.words(F.col("t"))
    got = df.select(
        "t", "n", W.balanced_split(w, F.col("n")).alias("b"),
        W.auto_split(w, F.transform(w, lambda x: F.length(x)), 1).alias("chars"),
        W.auto_split(w, F.transform(w, lambda x: F.lit(1))).alias("words"),
    ).collect()
    for row in got:
        ws = row["t"].split()
        assert row["b"] == [" ".join(c) for c in cut(ws, row["n"])]
        for name, tokens in (("chars", lambda c: len(" ".join(c))), ("words", len)):
            best = next((n for n in range(1, len(ws) + 1) if all(tokens(c) + 2 < 25 for c in cut(ws, n))), len(ws))
            assert row[name] == [" ".join(c) for c in cut(ws, best)]


def test_split_errors_and_empty(spark):
    for n in (0, 4):
        with pytest.raises(Exception, match="cannot cut"):
            one(spark, "a b c", lambda t: W.balanced_split(T.words(t), n))
    assert one(spark, "", lambda t: W.auto_split(T.words(t), F.transform(T.words(t), lambda x: F.lit(1)))) == []


def test_head_is_the_sorted_head(spark, table):
    rows = lines_of(table("documents"))
    for n in (0, 1, 17, 1000, 10**7):
        got = head(rows, ["doc_id", "line_no"], n)
        want = rows.orderBy("doc_id", "line_no").limit(n)
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    copies = rows.unionByName(rows)
    assert head(copies, ["doc_id", "line_no"], 11).count() == 11


def test_clean_corpus_is_one_stage(table):
    plan = clean_corpus(table("documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "EvalPython" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_head_rejects_rows_without_a_key(spark):
    df = spark.createDataFrame([(None,), (0,), (1,)], "k long")
    with pytest.raises(ValueError, match="have no k"):
        head(df, ["k"], 1)

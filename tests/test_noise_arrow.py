"""Chunks and corruption made batch by batch against plain Python, and rows that share a key."""

from hashlib import md5

import pyarrow as pa
from pyspark.sql import functions as F

from misheard.functions.draws import row_seed
from misheard.operators import noise

TEXTS = ["", "a", "añb€c😀d" * 9, "plain words, none wide " * 7, None, "zü"]


def plain_chunks(rs, text, sizes):
    digits = "".join(md5(f"{rs}|{b}".encode()).hexdigest() for b in range(len(text) // 32 + 1))
    out = []
    for d in digits:
        if not text:
            break
        size = sizes[int(d, 16) % len(sizes)]
        out.append(text[:size])
        text = text[size:]
    return out


def test_chunks_equal_plain_python(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS * 3)], "id long, t string").coalesce(1)
    for sizes in ((1, 2, 3, 4), (4,), (2, 1)):
        got = df.select("t", row_seed(3, F.col("id")).alias("rs"), noise.random_chunks(row_seed(3, F.col("id")), F.col("t"), sizes).alias("c"))
        for r in got.collect():
            assert r.c == (None if r.t is None else plain_chunks(r.rs, r.t, sizes))


def test_slices_of_a_batch_change_nothing(spark, monkeypatch):
    rows = [f"1{k}|" for k in range(len(TEXTS))]
    sizes = noise._check_sizes((1, 2, 3, 4))
    whole = noise._joined_lists([c for _, c in noise._slices(rows, pa.array(TEXTS), sizes)]).to_pylist()
    monkeypatch.setattr(noise, "_SLICE", 5)
    assert noise._joined_lists([c for _, c in noise._slices(rows, pa.array(TEXTS), sizes)]).to_pylist() == whole


def test_carried_table_equals_joined_table(spark):
    df = spark.createDataFrame(
        [(k % 15 if k % 7 else None, t) for k, t in enumerate(TEXTS * 6)], "id long, t string"
    )
    table = spark.createDataFrame(
        [("a", "b", 3), ("a", "é", 2), ("a", "", 1), ("ñ", "nn", 1), ("pl", None, 2), ("pl", "bl", 2), ("a", "b", 1),
         (" ", "__", 9), ("€c", "wxyz", 1), (None, "q", 5)], "chunk string, replacement string, cnt long",
    )
    for cut in (None, 3):
        carried = noise.corrupt(df, ["id"], "t", table, 4, truncate_to=cut)
        joined = noise.corrupt(df, ["id"], "t", table, 4, truncate_to=cut, max_rows=0)
        assert sorted(map(str, carried.collect())) == sorted(map(str, joined.collect()))

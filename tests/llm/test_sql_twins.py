"""SQL twins over planted rows: near vectors, repeated strings."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from misheard.llm import oracles, projections, repeats
from pyspark.sql import functions as F


def twin(name, **tables):
    con = duckdb.connect()
    for table, rows in tables.items():
        con.register(table, rows)
    found = con.sql(oracles.ORACLES[name])
    return found.columns, sorted(found.fetchall(), key=repr)


def test_near_vectors(spark, shared):
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for k in range(25):
        base = rng.normal(size=16)
        for _ in range(k % 5 + 1):
            rows.append((n, (base + rng.normal(size=16) * 0.3).astype(np.float32).tolist()))
            n += 1
    rows += [(n, None), (n + 1, [0.0] * 16), (n + 2, [float("nan")] + [1.0] * 15), (n + 3, rows[0][1]), (n + 4, [])]
    kinds = "vec_id long, embedding array<float>"
    # through Parquet, which both sides read alike
    path = f"{shared}/near-vectors"
    spark.createDataFrame(rows, kinds).write.mode("overwrite").parquet(path)
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{path.removeprefix('file:')}/*.parquet'")
    want = con.sql(oracles.ORACLES["op6_embedding_neighbours"])
    got = projections.near_duplicates(spark.read.parquet(path)).withColumn("kept", F.col("vec_id") == F.col("component_id"))
    want, got = sorted(want.fetchall()), sorted(tuple(r) for r in got.select(*want.columns).collect())
    assert got == want and sum(r[1] for r in want) > 40


@pytest.mark.parametrize("cases", ["planted", "empty"])
def test_repeated_strings(docs_of, cases):
    rng = np.random.default_rng(5)
    text = lambda n: "".join(rng.choice(list("abcdé \n"), n))
    passage, same = text(450), "x" * 900
    rows = [(k, text(300) + (passage[k:] if k % 2 else passage) + text(200)) for k in range(8)]
    rows += [(20, same), (21, None), (22, ""), (23, text(399)), (24, rows[0][1]), (25, passage[:200])]
    rows = rows if cases == "planted" else []
    table = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())})
    columns, want = twin("op9_repeated_passages", documents=table)
    docs = docs_of(rows) if rows else docs_of([(1, "x")]).limit(0)
    got = repeats.remove_repeats(docs).select(*columns).collect()
    assert sorted((tuple(r) for r in got), key=repr) == want
    assert not rows or sum(r[2] > 0 for r in want) >= 10

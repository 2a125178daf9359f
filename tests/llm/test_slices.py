"""Near copies: a task holds the sets of a few rows only."""

from misheard.llm import near_copies


def test_sets_of_few_rows_are_held(spark, shared, tmp_path, monkeypatch):
    made, seen = str(tmp_path), near_copies.map_arrow

    def watched(df, step, *rest):
        def noted(batch):
            with open(f"{made}/rows", "a") as f:
                f.write(f"{batch.num_rows}\n")
            return step(batch)

        return seen(df, noted, *rest)

    monkeypatch.setattr(near_copies, "map_arrow", watched)
    docs = spark.range(4000).coalesce(1).selectExpr("id as doc_id", "concat('a b c d e f g ', cast(id % 3999 as string)) as text")
    rows = near_copies._signatures(docs, ["doc_id"], "text").collect()
    assert len(rows) == 4000 and len({r.fp for r in rows}) == 3999
    sizes = [int(x) for x in open(f"{made}/rows")]
    assert sum(sizes) == 4000 and max(sizes) <= 1000

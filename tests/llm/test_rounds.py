"""Connected components over many rounds: the driver's plans stay small."""

from misheard.llm import components


def foretold(df) -> int:
    """Bits of the size that Spark foretells."""
    try:
        return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()
    except ValueError:      # more digits than Python reads
        return 10_000


def test_sizes_foretold_do_not_grow_over_rounds(spark, shared, monkeypatch):
    sizes, cut = [], components.cut

    def watched(df):
        sizes.append(foretold(df))
        return cut(df)

    monkeypatch.setattr(components, "cut", watched)
    monkeypatch.setattr(components, "LINKS_PER_PART", 16)
    links = spark.range(1, 600).selectExpr("id * 7 % 601 as a", "(id + 1) * 7 % 601 as b").where("b != 0")
    got = components.components(links).collect()
    assert len(got) == 600 and len({r.root for r in got}) == 1 and got[0].root in {r.node for r in got}
    assert max(sizes) < 1000, sizes


def test_few_links_take_no_rounds(spark, shared, monkeypatch):
    made, cut = [], components.cut
    monkeypatch.setattr(components, "cut", lambda df: made.append(df) or cut(df))
    links = spark.range(3000).selectExpr("id as a", "id + 1 as b").unionByName(spark.sql("select 9000L as a, 9001L as b"))
    got = {r.node: r.root for r in components.components(links).collect()}
    assert len(got) == 3003 and set(got.values()) == {0, 9000} and len(made) <= 3

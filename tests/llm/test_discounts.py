"""Languages whose counts give a discount of zero."""

from misheard.llm import perplexity


def test_zero_discounts_leave_no_document_unscored(spark, docs_of):
    # single symbols: "a" to "d" follow twice as many others as the counts of
    # counts foresee, so the raw discount of n-grams seen twice is below zero
    good = ["xyxyxy", "abab cdcd efef ghgh", "klkl mnmn opop", "q r s", "tutu vwvw"]
    odd = ["x\u2603y\u2603z", "ab\u2603ab\u2603", "\u2603" * 5]
    rows = [(i, t) for i, t in enumerate(good + odd)] + [(50, "abc", "none"), (51, ""), (52, None)]
    labels = spark.createDataFrame([(i, 1) for i in range(len(good))], "doc_id long, quality int")
    docs = docs_of(rows)
    counts = perplexity.gram_counts(
        docs.where(f"doc_id < {len(good)}").selectExpr("lang", "text", "true as trusted"), 4
    )
    backs = [r.back for _, back in perplexity.levels(counts, 4) for r in back.collect()]
    assert min(backs) > 0
    got = {r.doc_id: r for r in perplexity.classify(docs, labels).collect()}
    assert all(got[i].perplexity is not None for i in range(len(good + odd)))
    assert all(got[i].perplexity is None and got[i].kept for i in (50, 51, 52))
    assert not any(got[i].kept for i in range(len(good), len(good + odd)))

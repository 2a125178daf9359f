"""Every document labelled good is trusted, however many, on either kind of join."""

from misheard.llm import perplexity


def test_all_good_labels_are_trusted(spark, docs_of, monkeypatch):
    labels = spark.range(1_000_300).selectExpr("id as doc_id", "1 as quality").unionByName(
        spark.createDataFrame([(3, 1), (3, 1), (None, 1), (-4, 0)], "doc_id long, quality int")
    )
    assert perplexity.trusted_ids(labels, "doc_id").count() == 1_000_300
    docs = docs_of([(k % 40, f"plain text number {k} about rivers and towns") for k in range(80)] + [(None, "none")])
    few = labels.where("doc_id < 30")
    broadcast = sorted(map(str, perplexity.classify(docs, few).collect()))
    monkeypatch.setattr(perplexity, "lookup_join", lambda a, b, on, how, by: perplexity.spread_join(a, b, on, how, by, 1))
    assert sorted(map(str, perplexity.classify(docs, few).collect())) == broadcast

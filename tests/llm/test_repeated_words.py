"""Text of repeated words, which any model finds easy to predict."""

import numpy as np
from pyspark.sql import functions as F

from misheard.llm import perplexity


def test_shares_of_own_ngrams():
    share = lambda t: perplexity.own_share(np.unique(np.concatenate(list(perplexity.ngrams(t))), return_counts=True)[1])
    assert share("a") == 1 and share("abcdefgh") == 1
    assert share("Of " * 200) < 0.3 < 0.7 < share("It was the best of times, it was the worst of times, and so on.")


def test_repeated_words_are_rejected(spark, shared):
    """Labels that the model did not see."""
    table = lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")
    labels = table("labels")
    seen, held = labels.where(F.col("doc_id") % 2 == 0), labels.where(F.col("doc_id") % 2 == 1)
    rows = perplexity.classify(table("documents"), seen).join(held, "doc_id").join(table("documents").select("doc_id", "text"), "doc_id").collect()
    good, bad = ([r for r in rows if r.quality == q] for q in (1, 0))
    for name, of in (("good", good), ("bad", bad)):
        print(name, len(of), "by perplexity alone", sum(r.perplexity <= r.limit for r in of), "kept", sum(r.kept for r in of))
    repeated = [r for r in bad if len(set(r.text.split())) < 0.1 * len(r.text.split())]
    assert repeated and not any(r.kept for r in repeated)
    assert np.mean([r.kept for r in good]) >= 0.97
    assert np.mean([r.kept for r in bad]) <= 0.1

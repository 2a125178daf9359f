"""Edits compared over ids that are not integers."""

import hashlib
import random

import pytest

from misheard.llm import multiset


@pytest.mark.parametrize("size", [1, 40])
def test_edits_follow_falling_strings(spark, shared, monkeypatch, size):
    monkeypatch.setattr(multiset, "_RANGE_ROWS", 3)
    rng = random.Random(7)
    rows = [(f"d-{n}é" if n % 3 else f"D{n}", "".join(rng.choice("ab. é\n") for _ in range(20)), n)
            for n in rng.sample(range(1000), size)] + [(None, "no id. text", 0), ("", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, _range int")
    found = {r.doc_id: r for r in multiset.compare_edits(docs).collect()}
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0], reverse=True) + [r for r in rows if r[0] is None]
    assert len(found) == len(rows)
    for (doc, text, _), (_, following, _) in zip(order, order[1:] + order[:1]):
        new = multiset.edited(text or "", following or "")
        assert found[doc].edited_sha256 == hashlib.sha256(new.encode()).hexdigest(), doc
    assert multiset.compare_edits(docs.limit(0)).count() == 0


def test_other_types_of_ids(spark, shared):
    for kind in ("int", "double", "date"):
        docs = spark.sql(f"select cast(null as {kind}) doc_id, 'a. b' text")
        assert multiset.compare_edits(docs).count() == 1

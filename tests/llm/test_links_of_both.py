"""The stage of near copies also links by the fingerprints of operator 8."""

import random

import corpus_pipeline
from misheard.llm import near_copies, simhash


def fingerprint_pair():
    """Two texts within two bits whose five-word shingles are less alike than 0.8."""
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    base = simhash.fingerprint(" ".join(words).encode())
    for _ in range(20_000):
        new = list(words)
        for k in rng.sample(range(60), 2):
            new[k] = f"v{rng.randrange(10**6)}"
        a, b = near_copies.shingles(" ".join(words).encode()), near_copies.shingles(" ".join(new).encode())
        both = len(set(a.tolist()) & set(b.tolist()))
        close = (base ^ simhash.fingerprint(" ".join(new).encode())).bit_count() <= 2
        if close and both < 0.8 * (len(a) + len(b) - both):
            return " ".join(words), " ".join(new)
    raise AssertionError("no such pair")


def test_stage_links_by_fingerprints_too(spark, docs_of):
    one, two = fingerprint_pair()
    copy = two + " end"              # a near copy of the second by its shingles
    rows = [(5, one), (3, two), (1, copy), (9, "something else that stands alone here"), (None, one), (7, one)]
    docs = docs_of(rows)
    assert sorted(r.doc_id for r in near_copies.keep_first(docs).collect()) == [1, 5, 9]
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == [1, 9]

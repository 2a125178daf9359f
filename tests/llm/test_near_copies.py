"""The pipeline's stage of near copies against brute force over Jaccard similarity."""

import random

import pytest

import corpus_pipeline
from misheard.llm import near_copies


def plain(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_force(rows):
    """Smallest id of each group that is connected over similarities of 0.8."""
    sets = [plain(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a == sets[j] or both and both >= 0.8 * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted(least.values())


@pytest.mark.parametrize("group_rows", [2, 64])
def test_near_copies_match_brute_force(docs_of, group_rows):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = [(900, None), (901, ""), (902, " \n"), (903, "One two"), (904, "one  two"), (905, "three")]
    for base in range(12):
        words = [word() for _ in range(rng.randrange(40, 300))]
        for copy in range(12):
            new = list(words)
            for _ in range(rng.randrange(8)):
                new[rng.randrange(len(new))] = word()
            rows.append((base * 12 + copy, " ".join(new)))
    rng.shuffle(rows)
    got = near_copies.keep_first(docs_of(rows), group_rows=group_rows)
    assert got.columns == docs_of(rows).columns
    assert sorted(r.doc_id for r in got.collect()) == brute_force(rows)
    assert near_copies.keep_first(docs_of(rows).limit(0)).count() == 0


def test_stage_drops_copies_at_the_similarity(spark, docs_of):
    words = [f"w{k}" for k in range(104)]
    near, far = list(words), list(words)
    near[50] = near[70] = "x"        # 90 of 110 shingles: 0.818
    far[30] = far[50] = far[70] = "y"    # 85 of 115: 0.739
    docs = docs_of([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))])
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == [1, 3]

"""Spelling variants against all pairs, letter by letter."""

import collections
import random
import re
import zlib

import pytest

from misheard.llm import spelling
from misheard.llm.queries import QUERIES

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(rows):
    counts = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def plain(words):
    deleted = collections.defaultdict(set)
    for w in words:
        for k in range(len(w)):
            deleted[k, w[:k] + w[k + 1 :]].add(w)
    near = collections.defaultdict(set)
    for (_, rest), group in deleted.items():
        for w in group:
            near[w] |= group - {w}
            if rest in words:
                near[w].add(rest)
                near[rest].add(w)
    form = {}
    for w, n in words.items():
        best = min(((-words[x], x) for x in near[w]), default=None)
        if best and -best[0] >= 2 * n:
            form[w] = best[1]
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return out


def digest(df):
    rows = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def made_up(seed, alphabet, n):
    """Rows of words with their slips, some very frequent."""
    draw = random.Random(seed)
    base = ["".join(draw.choices(alphabet, k=draw.randint(3, 9))) for _ in range(n)]
    text = []
    for w in base:
        for _ in range(draw.randint(1, 5)):
            k, c = draw.randrange(len(w)), draw.choice(alphabet)
            slip = draw.choice([w, w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :], w[:k] + c + w[k:], w + c])
            text += [slip] * draw.choice([1, 3, 7, 20])
        text += [w] * draw.randint(1, 40)
    draw.shuffle(text)
    return [(k, " ".join(text[k::50])) for k in range(50)]


@pytest.mark.parametrize("sizes", [{}, {"top_levels": 2, "subtree_words": 20, "askers": 30}, {"top_levels": 16}])
def test_equals_all_pairs(docs_of, sizes):
    for seed, alphabet in ((1, "abq"), (2, "aeionrstlÀé÷"), (3, "abcdefghijklmnopqrstuvwxyzüñ")):
        rows = made_up(seed, alphabet, 60)
        rows += [(None, "École ÉCOLE école×école l'école Straße"), (7, None), (8, ""), (9, "123 ... abcd"), (9, "x" * 3000 + " ")] * 3
        want = plain(plain_words(rows))
        assert digest(spelling.variants(docs_of(rows), **sizes)) == want
        assert any(r[1] != r[2] and r[1] for r in want) or seed != 1       # chains are met


def test_empty_tables(docs_of):
    assert spelling.variants(docs_of([(1, None), (2, "")])).collect() == []
    assert spelling.variants(docs_of([(1, "x")]).where("false")).collect() == []


def test_one_hot_word(docs_of):
    rows = [(k, "common " * 50 + "comon commons") for k in range(200)]
    assert digest(spelling.variants(docs_of(rows))) == plain(plain_words(rows))


def test_query_on_documents(spark, shared):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert digest(QUERIES["op11_spelling_variants"](spark, sf)) == plain(plain_words(rows))

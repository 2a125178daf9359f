import random

import pytest
from pyspark.sql import functions as F

from misheard.constants import SWEEP_CONFIGS
from misheard.functions import align as A
from misheard.operators import pairs as P


def table_links(a, b, band):
    """The same choice of links from a full table."""
    n = len(a)
    best = [[0] * (n + 1) for _ in range(n + 1)]
    for i in reversed(range(n)):
        for j in reversed(range(n)):
            best[i][j] = max(best[i + 1][j], best[i][j + 1])
            if a[i] == b[j] and (band is None or abs(i - j) < band):
                best[i][j] = max(best[i][j], 1 + best[i + 1][j + 1])
    out, i, j = [], 0, 0
    while best[i][j]:
        if a[i] == b[j] and (band is None or abs(i - j) < band):
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] == best[i][j]:
            i += 1
        else:
            j += 1
    return out


def moved_layout(a, b, links):
    """Columns by moving everything up to a link to the left, link after link."""
    at_a, at_b = list(range(len(a))), list(range(len(b)))
    for i, j in links:
        d = abs(i - j)
        at_a = [p - d if k <= i - (i < j) else p for k, p in enumerate(at_a)]
        at_b = [p - d if k <= j - (j < i) else p for k, p in enumerate(at_b)] if d else at_b
    x, y = dict(zip(at_a, a)), dict(zip(at_b, b))
    cols = [(x.get(p, "?"), y.get(p, "?")) for p in sorted({*x, *y})]
    cols = [c for c in cols if c != ("?", "?")]
    return "".join(c[0] for c in cols), "".join(c[1] for c in cols)


def sliced_sweep(a, b, w, s):
    n = max(len(a), len(b))
    x, y = a.ljust(n, "?"), b.ljust(n, "?")
    at = 0
    while at + w < len(x):
        p, q = A.align_strings(x[at:at + w], y[at:at + w], None)
        x, y, at = x[:at] + p + x[at + w:], y[:at] + q + y[at + w:], at + s
    p, q = A.align_strings(x[at:], y[at:], None)
    x, y = x[:at] + p, y[:at] + q
    return sum(u == v for u, v in zip(x[:n], y)) / n, x, y


def texts(alphabet, longest, seed):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, longest))) for _ in range(2)]


@pytest.mark.parametrize("block", [1, 2, 3, 512])
@pytest.mark.parametrize("band", [None, 1, 2, 3, 10])
def test_links_and_layout(monkeypatch, block, band):
    monkeypatch.setattr(A, "_ROWS_PER_BLOCK", block)
    for seed in range(400):
        a, b = texts("ab?" if seed % 2 else "abc", 14, seed)
        n = max(len(a), len(b))
        x, y = a.ljust(n, "?"), b.ljust(n, "?")
        links = table_links(x, y, band)
        if n:
            assert A._links(x, y, band) == links
            if band is None:
                assert A._short_links(x, y) == links
        assert A.align_strings(a, b, band) == moved_layout(x, y, links)


def test_sweep_equals_slicing():
    for seed in range(600):
        a, b = texts("abcd", 26, seed)
        if a or b:
            for w, s in SWEEP_CONFIGS:
                assert A.sweep_strings(a, b, w, s, {}) == sliced_sweep(a, b, w, s)


def test_shifted_substitution():
    assert A.align_strings("abxcd", "zabyc", 10) == ("?abx?cd", "zab?yc?")


def test_guard(spark):
    rows = [("", ""), ("", "a"), ("ab", "ab"), ("a" * 5, "a"), ("a" * 10, "aa"), ("a" * 10, "aaa"), ("abc", "xyz")]
    df = spark.createDataFrame(rows, "ref string, hyp string")
    got = [r["status"] for r in P.align_pairs(df).collect()]
    assert got == ["empty", "empty", "equal", "too_different", "too_different", "align", "align"]
    with pytest.raises(TypeError):
        P.align_pairs(spark.createDataFrame([(1, "a")], "ref int, hyp string"))


def test_invariants_on_tables(spark, table):
    from checks.inputs import noisy_pairs

    both = noisy_pairs(spark, "/root/testdata/sf0.001")
    for got in (P.align_windows(both), P.align_pairs(both).where("ref_aln is not null"), P.align_by_sweep(both)):
        bad = got.where(
            (F.length("ref_aln") != F.length("hyp_aln"))
            | (F.replace("ref_aln", F.lit("?"), F.lit("")) != F.col("ref"))
            | (F.replace("hyp_aln", F.lit("?"), F.lit("")) != F.col("hyp"))
        )
        assert got.count() > 1000 and bad.count() == 0


def test_best_sweep_edge_cases(spark):
    df = spark.createDataFrame([("", ""), ("", "abc"), ("abc", "xyz"), ("ab", "ab")], "ref string, hyp string")
    got = [(r["score"], r["cfg"], r["ref_aln"], r["hyp_aln"]) for r in P.align_by_sweep(df).collect()]
    assert got == [(None, None, None, None), (0.0, None, " ", " "), (0.0, None, " ", " "), (1.0, 0, "ab", "ab")]


def test_sentences_need_one_table_and_give_the_same_links(monkeypatch):
    """An optimum whose links all lie in the band is the one with the band."""
    draw = random.Random(5)
    pairs = []
    for n in (1, 5, 20, 70, 150):
        for _ in range(40):
            a = "".join(draw.choices("aeinst ?", k=n))
            b = "".join(c if draw.random() > 0.2 else draw.choice(["", c + c, "e"]) for c in a)
            pairs.append((a, b))
    slow = []
    links = A._links
    monkeypatch.setattr(A, "_links", lambda *got: slow.append(got) or links(*got))
    for band in (1, 3, 10, None):
        slow.clear()
        found = [A.align_strings(a, b, band) for a, b in pairs]
        assert band is not None or not slow
        assert band != 10 or len(slow) < len(pairs) // 2
        monkeypatch.setattr(A, "_ONE_TABLE", 0)
        assert found == [A.align_strings(a, b, band) for a, b in pairs]
        monkeypatch.setattr(A, "_ONE_TABLE", 512)

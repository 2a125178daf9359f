"""Operators that look at whole tables, against brute force."""

import collections
import hashlib
import random
import re
import time

import duckdb
import numpy as np
import pytest
import xxhash

from misheard.llm import components, mixing, perplexity, projections, repeats, simhash, warc
from misheard.llm.oracles import ORACLES
from misheard.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def groups(n, linked):
    """Smallest member of each node's component."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_twin(spark, shared, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    got, want = QUERIES[name](spark, SMALL).toPandas(), con.execute(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    text = lambda df: sorted(map(str, df[columns].astype(object).where(df[columns].notna(), None).values.tolist()))
    clean = lambda df: [r.replace(".0,", ",").replace(".0]", "]") for r in text(df)]
    assert clean(got) == clean(want)


# --- mixing -----------------------------------------------------------------


def test_targets_are_water_filled(spark, shared):
    sizes = {"a": 10, "b": 1000, "c": 500, None: 90, "d": 0}
    rows = [(s, n, 1) for s, n in sizes.items()]
    got = {r.source: r for r in mixing.source_targets(spark.createDataFrame(rows, "source string, source_size long, rows long")).collect()}
    names = ["a", "b", "c", "d", None]
    weight = dict(zip(names, (5, 2, 1, 5, 2)))
    target, open_, rest = {}, set(names), 1.5 * sum(sizes.values())
    while True:
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 2 * sizes[s]}
        if not full:
            break
        for s in full:
            target[s] = 2 * sizes[s]
            rest -= target[s]
        open_ -= full
    target |= share
    assert {s: r.target for s, r in got.items()} == pytest.approx(target)
    assert [got[s].source_no for s in names] == [0, 1, 2, 3, 4]


def test_mix_takes_its_targets_in_order(docs_of):
    rng = random.Random(5)
    rows = [(i % 90, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(40))), "en", f"s{i % 3}") for i in range(100)]
    rows += [(200, None, "en", "s0"), (201, " \n", "en", None), (None, "one two\tthree", "en", None), (7, rows[7][1], "en", "s1")]
    docs = docs_of(rows)
    got = mixing.assign(docs, ["doc_id", "source", "n_chars"]).collect()
    assert len(got) == len(rows)
    taken = collections.Counter()
    for r in got:
        taken[r.source] += r.mix.taken
        assert r.mix.taken == sum(c.words for c in r.mix.copies) <= 2 * r.mix.size
        assert all(0 <= c.position <= 1 for c in r.mix.copies)
    for r in got:
        assert abs(taken[r.source] - r.mix.target) <= 0.5
    mixed = mixing.mix(docs, length_col="n_chars")
    out = mixed.collect()
    assert mixed.columns == docs.columns and out == mixing.mix(docs.repartition(7), length_col="n_chars").collect()
    words = collections.Counter()
    for r in out:
        words[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        assert r.n_chars == len(r.text)
    assert words == +taken
    assert mixing.mix(docs.limit(0)).count() == 0
    nothing = mixing.assign(docs_of([(1, ""), (2, None)]), ["doc_id"]).collect()
    assert [(r.mix.target, r.mix.taken, r.mix.copies) for r in nothing] == [(0.0, 0, [])] * 2


def test_progress_inverts_the_schedule(spark):
    from pyspark.sql import functions as F

    for knots in mixing.SCHEDULES:
        at = np.array([r.p for r in spark.range(101).select(mixing.progress(F.col("id") / 100, knots).alias("p")).collect()])
        t, w = np.array([k[0] for k in knots]), np.array([k[1] for k in knots])
        fine = np.linspace(0, 1, 20001)
        area = np.r_[0, np.cumsum((np.interp(fine[1:], t, w) + np.interp(fine[:-1], t, w)) / 2 * np.diff(fine))]
        assert np.interp(at, fine, area) / area[-1] == pytest.approx(np.arange(101) / 100, abs=1e-6)


# --- archives ---------------------------------------------------------------


def test_archives_round_trip(spark, shared):
    rows = [
        (1, "http://a b", b"x" * 200), (2, None, b"x" * 200), (3, "u", bytes(range(256)) * 3), (4, "u", b"\r\n\r\nWARC/1.1\r\n\n" * 20),
        (5, "v", b"\r\n\r\nWARC/1.1\r\n\n" * 20), (None, "z", b"x" * 200), (6, "q", None), (7, "q", b""), (8, "s", b"abc"),
        (9, "s", b"abc"), (1, "http://a b", b"x" * 200),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html binary")
    arcs, warcs = f"{shared}/arc-{time.time()}", f"{shared}/warc-{time.time()}"
    warc.write_arc(pages, arcs)
    warc.convert(spark, arcs, warcs)
    got = warc.read_warc(spark, warcs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    for page, _, data in rows:
        data = data or b""
        for r in by[page]:
            assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
            revisit = page in (2, 5)
            assert r.record_type == ("revisit" if revisit else "response")
            assert r.refers_to == ({2: 1, 5: 4}[page] if revisit else None)
            assert bytes(r.payload) == (b"" if revisit else data)
    assert by[1][0].target_uri == "http://a%20b" and by[1][0].record_id.startswith("<urn:uuid:")
    warc.write_arc(pages.limit(0), arcs + "e")
    warc.convert(spark, arcs + "e", warcs + "e")
    assert warc.read_warc(spark, warcs + "e").count() == 0


def test_both_versions_are_parsed_by_declared_length():
    for version in (1, 2):
        data = warc.arc_start(version) + warc.arc_record(version, "u", 5, b"a\n\nb") + warc.arc_record(version, None, None, b"")
        (one, block), (two, empty) = warc.parse_arc(data + b"\n")
        assert one["URL"] == "u" and one["Archive-date"] == warc.CAPTURED and two["URL"] == "urn:none"
        assert bytes(warc.http_parts(block)[1]) == b"a\n\nb" and bytes(warc.http_parts(empty)[1]) == b""
        with pytest.raises(ValueError):
            list(warc.parse_arc(data[:-3]))
    assert warc.warc_time("19970509") == "1997-05-09T00:00:00Z"


# --- perplexity -------------------------------------------------------------


def kneser_ney(texts, order):
    """Plain interpolated modified Kneser-Ney over dictionaries."""
    fold = perplexity._folding()
    symbols = lambda t: [0] * (order - 1) + [int(fold[min(ord(c), 0xFFFF)]) for c in t]
    counts = collections.Counter()
    for t in texts:
        s = symbols(t)
        counts.update(tuple(s[i : i + order]) for i in range(len(s) - order + 1))
    tables = []
    for k in range(order, 0, -1):
        n = [sum(c == r for c in counts.values()) for r in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else None
        raw = [r - (r + 1) * y * n[r] / n[r - 1] if n[r - 1] and y is not None else None for r in (1, 2, 3)]
        d = [0] + [r / 2 if x is None else max(0, min(r, x)) for r, x in zip((1, 2, 3), raw)]
        total, left = collections.Counter(), collections.Counter()
        for g, c in counts.items():
            total[g[:-1]] += c
            left[g[:-1]] += d[min(c, 3)]
        tables.append((counts, d, total, left))
        counts = collections.Counter(g[1:] for g in counts)
    unseen = 1 / (len(tables[-1][0]) + 1)

    def nats(text):
        s, sum_ = symbols(text), 0.0
        for i in range(len(text)):
            g, p = tuple(s[i : i + order]), unseen
            for counts, d, total, left in reversed(tables):
                suffix = g[len(g) - len(next(iter(counts))) :]
                c = counts.get(suffix, 0)
                if suffix[:-1] in total:
                    p = (c - d[min(c, 3)]) / total[suffix[:-1]] + left[suffix[:-1]] / total[suffix[:-1]] * p
            sum_ -= np.log(p)
        return sum_ / len(text)

    return nats


def test_perplexity_matches_plain_counts(spark, docs_of):
    rng = random.Random(6)
    word = lambda s: "".join(rng.choice(s) for _ in range(rng.randrange(1, 6)))
    rows = [(i, " ".join(word("abcde É7") for _ in range(rng.randrange(1, 60))), rng.choice(["x", "y"])) for i in range(80)]
    rows += [(100 + i, " ".join(word("#$%&") for _ in range(20)), "x") for i in range(5)]
    rows += [(200, None, "x"), (201, "", "y"), (202, "no model", "z"), (203, "abc", None), (None, "ab ab 😀", "x"), (3, rows[3][1], rows[3][2])]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 80, 2)] + [(None, 1, 0), (0, 1, 0), (101, 0, 1)], "doc_id long, quality int, toxic int")
    docs = docs_of(rows)
    got = perplexity.classify(docs, labels).collect()
    assert len(got) == len(rows)
    models = {}
    for lang in ("x", "y"):
        models[lang] = kneser_ney([t for i, t, la, *_ in rows if la == lang and t and i is not None and i < 80 and i % 2 == 0], 4)
    text = {(i, la): t for i, t, la in rows}
    for r in got:
        t = text[r.doc_id, r.lang or None]
        if r.lang in models and t:
            assert np.log(r.perplexity) == pytest.approx(models[r.lang](t), rel=1e-9)
            assert r.kept == (r.perplexity <= r.limit)
        else:
            assert r.perplexity is None and r.kept
    kept = perplexity.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert not {r.doc_id for r in kept.collect()} & set(range(100, 105))
    assert kept.count() == sum(r.kept for r in got)
    assert perplexity.keep_good(docs.limit(0), labels).count() == 0
    assert perplexity.keep_good(docs, labels.limit(0)).count() == len(rows)


def test_long_texts_are_scored_in_slices(monkeypatch):
    whole = np.concatenate(list(perplexity.ngrams("abcdefé" * 50)))
    monkeypatch.setattr(perplexity, "_SLICE", 16)
    assert (np.concatenate(list(perplexity.ngrams("abcdefé" * 50))) == whole).all()


def test_held_out_quality(spark, shared):
    """Labels that the model did not see: junk that is far from prose goes, good
    documents stay."""
    from pyspark.sql import functions as F

    table = lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")
    labels = table("labels")
    seen, held = labels.where(F.col("doc_id") % 2 == 0), labels.where(F.col("doc_id") % 2 == 1)
    rows = perplexity.classify(table("documents"), seen).join(held, "doc_id").collect()
    good = [r.kept for r in rows if r.quality == 1]
    assert np.mean(good) >= 0.97
    assert np.mean([r.kept for r in rows if r.quality == 0]) < 0.6


# --- vectors ----------------------------------------------------------------


@pytest.mark.parametrize("block_rows", [5, projections.BLOCK_ROWS])
def test_links_of_vectors(spark, shared, monkeypatch, block_rows):
    monkeypatch.setattr(projections, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(projections.window_pairs, "__defaults__", (block_rows,))
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((12, 16))
    made = [c + rng.standard_normal(16) * s for c in centres for s in rng.uniform(0, 0.4, 15)]
    rows = [(int(i), list(map(float, v))) for i, v in zip(rng.permutation(len(made)), made)]
    rows += [(1000, rows[0][1]), (1001, rows[0][1]), (1002, [-0.0] + rows[0][1][1:]), (5, [2 * x for x in rows[3][1]])]
    bad = [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [1.0, None] * 8), (2004, [float("nan")] * 16), (2005, [float("inf")] * 16), (2006, [1.0, 2.0])]
    table_ = spark.createDataFrame([(i, v, "x") for i, v in rows + bad], "vec_id long, embedding array<double>, node string")
    got = projections.near_duplicates(table_).collect()
    assert len(got) == len(rows) + len(bad)
    unit = np.array([v for _, v in rows])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    near = (unit @ unit.T >= 0.9) & ~np.eye(len(rows), dtype=bool)
    links = collections.Counter()
    for (i, _), n in zip(rows, near.sum(1)):
        links[i, int(n)] += 1
    found = collections.Counter((r.vec_id, r.n_links) for r in got if r.vec_id < 2000)
    assert sum(n * c for (_, n), c in found.items()) >= 0.9 * near.sum()
    assert all(f <= max(n for (j, n) in links if j == i) for (i, f) in found)
    root = groups(len(rows), zip(*np.nonzero(near)))
    least = {}
    for k, r in enumerate(root):
        least[r] = min(least.get(r, 10**9), rows[k][0])
    want = collections.Counter((rows[k][0], least[r]) for k, r in enumerate(root))
    assert collections.Counter((r.vec_id, r.component_id) for r in got if r.vec_id < 2000) == want
    assert all(r.n_links == 0 and r.component_id == r.vec_id for r in got if r.vec_id >= 2000)
    assert projections.near_duplicates(table_.limit(0)).count() == 0


def test_recall_on_the_table(spark, shared, table):
    """Against brute force at a cosine at which the table has many pairs."""
    v = table("embeddings").toPandas().sort_values("vec_id")
    unit = np.stack(v.embedding.to_numpy()).astype(float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    cosine = float(np.quantile(unit @ unit.T, 0.98))
    near = int((unit @ unit.T >= cosine).sum() - len(v))
    found = projections.near_duplicates(table("embeddings"), cosine=cosine).agg({"n_links": "sum"}).first()[0]
    assert 0.9 * near <= found <= near


def test_calibration():
    for n in (10, 1000, 10**6):
        p = projections.calibrate(n)
        chance = projections.collision_chance(0.9, p.edge, p.window)
        assert projections._passes(p.lines, chance, p.count) >= projections.RECALL
    rng = np.random.default_rng(8)
    x = rng.standard_normal(10**6)
    y = 0.9 * x + np.sqrt(0.19) * rng.standard_normal(10**6)
    met = ((x > 1) & (y > 1) | (x < -1) & (y < -1)) & (abs(x - y) <= 0.8)
    assert met.mean() == pytest.approx(projections.collision_chance(0.9, 1.0, 0.8), rel=0.03)


# --- fingerprints -----------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(docs_of, table):
    texts = [r.text for r in table("documents").collect()]
    rows = list(enumerate(texts)) + [(500, None), (501, ""), (502, " \n"), (503, "One"), (504, "one"), (504, "one"), (None, "one two"), (505, "x " * 70_000)]
    got = simhash.near_duplicates(docs_of(rows)).collect()
    fp = np.array([plain_fingerprint(t) for _, t in rows], np.uint64)
    ids = [i for i, _ in rows]
    root = groups(len(rows), ((i, j) for i in range(len(rows)) for j in np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= 2)))
    least = {}
    for i, r in zip(ids, root):
        least[r] = min([x for x in (least.get(r), i) if x is not None], default=None)
    want = collections.Counter((i, int(f), least[r]) for i, f, r in zip(ids, fp, root))
    assert collections.Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == want
    kept = simhash.keep_first(docs_of(rows))
    assert kept.columns == docs_of(rows).columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(i) for i in least.values())
    assert simhash.keep_first(docs_of(rows).limit(0)).count() == 0


@pytest.mark.parametrize("group_rows", [3, 64])
def test_links_connect_all_within_two_bits(spark, shared, group_rows):
    rng = np.random.default_rng(9)
    made = set()
    for base in rng.integers(0, 2**63, 3):
        for _ in range(300):
            x = int(base)
            for bit in rng.choice(64, rng.integers(0, 5), replace=False):
                x ^= 1 << int(bit)
            made.add(x - (1 << 64) if x >> 63 else x)
    made = sorted(made)
    links = simhash.links(spark.createDataFrame([(x,) for x in made], "fp long"), group_rows).collect()
    fp = np.array(made, np.int64).view(np.uint64)
    at = {x: k for k, x in enumerate(made)}
    assert all((r.a ^ r.b) % 2**64 and ((r.a ^ r.b) % 2**64).bit_count() <= 2 for r in links)
    near = ((i, j) for i in range(len(fp)) for j in np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= 2))
    assert groups(len(fp), ((at[r.a], at[r.b]) for r in links)) == groups(len(fp), near)


def test_components_of_chains_and_stars(spark, shared):
    rng = random.Random(10)
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1001 + k) for k in range(100)] + [(5, 5)]
    edges += [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(200)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = groups(2500, edges)
    parts = collections.defaultdict(set)
    for node, root in got.items():
        parts[root].add(want[node])
        assert want[root] == want[node]
    assert all(len(p) == 1 for p in parts.values())
    assert len(parts) == len({want[n] for n in got})
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- repeats ----------------------------------------------------------------


def without_repeats(texts, length):
    seen = collections.Counter(t[x : x + length] for t in texts for x in range(len(t) - length + 1))
    for t in texts:
        covered = np.zeros(len(t), bool)
        for x in range(len(t) - length + 1):
            if seen[t[x : x + length]] > 1:
                covered[x : x + length] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~covered])
        spans = int((covered & ~np.r_[False, covered[:-1]]).sum()) if len(t) else 0
        yield len(t), int(covered.sum()), spans, kept


@pytest.mark.parametrize(("gram", "classes", "chunk"), [(16, 1000, 1 << 18), (8, 1, 1 << 18), (16, 3, 64)])
def test_repeats_match_brute_force(docs_of, monkeypatch, gram, classes, chunk):
    monkeypatch.setattr(repeats, "_CHUNK", chunk)
    rng = random.Random(11)
    passages = ["".join(rng.choice("abcd é") for _ in range(rng.randrange(30, 90))) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 50))) for _ in range(rng.randrange(6))]
        rows.append((i, "".join(parts) + "a" * rng.choice([0, 0, 0, 150])))
    rows += [(0, rows[0][1]), (500, None), (501, ""), (502, rows[5][1] * 2), (None, rows[7][1])]
    got = repeats.remove_repeats(docs_of(rows), length=40, gram=gram, bucket_classes=classes, kept_text=True).collect()
    data = [(t or "").encode() for _, t in rows]
    want = collections.Counter((i, *w) for (i, _), w in zip(rows, without_repeats(data, 40)))
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == want
    assert all(r.kept_sha256 == hashlib.sha256(bytes(r.kept)).hexdigest() for r in got)


def test_repeats_of_the_table(spark, shared, table):
    docs = table("documents").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in QUERIES["op9_repeated_passages"](spark, SMALL).collect()}
    for d, (n, removed, spans, kept) in zip(docs, without_repeats([d.text.encode() for d in docs], 400)):
        r = got[d.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, removed, spans, hashlib.sha256(kept).hexdigest())
    assert repeats.remove_repeats(table("documents").limit(0)).count() == 0

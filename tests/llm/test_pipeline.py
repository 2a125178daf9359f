"""The pipeline's stages on a small table, and the entry without this folder."""

import collections
import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from misheard.llm import guess_cost, perplexity, trie_bpe
from misheard.llm.queries import QUERIES, tokenizer_path

SMALL = "/root/testdata/sf0.001"
ROOT = Path(corpus_pipeline.__file__).parent


@pytest.fixture(scope="module")
def stages(spark, shared, tmp_path_factory):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SMALL).write.parquet(path)
        docs = spark.read.parquet(path)
        found.append(docs)
    return found


def rows(df):
    return collections.Counter(df.collect())


def test_quality_stage(spark, stages):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    kept = {r.doc_id for r in perplexity.classify(stages[0], labels).where("kept").collect()}
    assert rows(stages[1]) == collections.Counter(r for r in stages[0].collect() if r.doc_id in kept)
    assert 0.5 * stages[0].count() < len(kept) < stages[0].count()


def shingles(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def test_near_duplicate_stage(stages):
    docs = sorted(stages[1].collect(), key=lambda r: r.doc_id)
    sets = [shingles(r.text) for r in docs]

    def near(i, j):
        both = len(sets[i] & sets[j])
        return sets[i] == sets[j] or both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) and both > 0

    left, kept = set(range(len(docs))), []
    while left:
        first = min(left)
        group, new = set(), {first}
        kept.append(docs[first])
        while new:
            group |= new
            new = {j for j in left - group for i in new if near(i, j)}
        left -= group
    assert len(kept) < len(docs)
    assert rows(stages[2]) == collections.Counter(kept)


def test_secret_stage(stages):
    before = {r.doc_id: r for r in stages[2].collect()}
    for r in stages[3].collect():
        old = before.pop(r.doc_id)
        assert r.text == guess_cost.without_secrets(old.text, "[SECRET]") and r.n_chars == len(r.text)
        assert (r.lang, r.source) == (old.lang, old.source)
    assert not before


def test_mixing_stage(stages):
    texts = {r.doc_id: r.text for r in stages[3].collect()}
    size, taken = collections.Counter(), collections.Counter()
    for r in stages[3].collect():
        size[r.source] += len(r.text.split())
    for r in stages[4].collect():
        assert texts[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
        taken[r.source] += len(r.text.split())
    assert stages[4].columns == stages[0].columns
    assert sum(taken.values()) == pytest.approx(1.5 * sum(size.values()), rel=0.01)


def test_encoding_stage(spark, stages):
    model = trie_bpe.load(trie_bpe.read_tokenizer(tokenizer_path()))
    want = collections.Counter()
    for r in stages[4].collect():
        ids, text = model.encode_batch([r.text])[0]
        want[r.doc_id, ids, text.decode()] += 1
    got = collections.Counter((r.doc_id, np.array(r.tokens, "<u4").tobytes(), r.decoded) for r in stages[5].collect())
    assert got == want


def test_run_gives_the_last_stage(spark, shared, stages):
    assert sorted(map(str, corpus_pipeline.run(spark, SMALL).collect())) == sorted(map(str, stages[5].collect()))


def test_entry_without_this_folder(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; print(sum(k.startswith('op') for k in e.queries()), len(e.queries()) > 50)"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True)
    assert said.stdout.split() == ["0", "True"], said.stderr


def test_one_query_per_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))

"""Models as JSON, read again here and by the tokenizers library."""

import glob

import pytest

from checks import inputs as I
from misheard.operators import bpe
from misheard.sources import models

SF = "/root/testdata/sf0.001"


def test_confusions_as_json(spark, tmp_path):
    rows = [("a", "b", 3), ("a", "", 1), ('q"\n', "é", 2)] + [("x", f"r{k}", k + 1) for k in range(9000)]
    table = spark.createDataFrame(rows, "chunk string, replacement string, cnt long")
    path = str(tmp_path / "c")
    models.save_confusions_json(table, path)
    assert sorted(tuple(r) for r in models.load_confusions_json(spark, path).collect()) == sorted(rows)
    assert spark.read.json(path).where("chunk = 'x'").count() == 3
    models.save_confusions_json(table.limit(0), path + "e")
    assert models.load_confusions_json(spark, path + "e").count() == 0


def test_subwords_as_json(spark, tmp_path):
    sentences = I.sentences(spark, SF)
    model = bpe.train_bpe(sentences, "sentence", 300)
    path = str(tmp_path / "b")
    models.save_bpe_json(model, path)
    again = models.load_bpe_json(spark, path)
    for kind in ("vocab", "merges"):
        cols = getattr(model, kind).columns
        old, new = (sorted(tuple(r) for r in getattr(m, kind).select(*cols).collect()) for m in (model, again))
        assert old == new
    assert again.suffix == model.suffix

    library = pytest.importorskip("tokenizers").Tokenizer.from_file(glob.glob(path + "/part-*")[0])
    got = bpe.encode(sentences, "sentence", again, "tokens")
    rows = got.select("sentence", "tokens").collect()
    assert len(rows) > 1000
    for r in rows:
        assert [t for t in r.tokens if t not in ("[START]", "[END]")] == library.encode(r.sentence).tokens, r.sentence


def test_merges_as_strings(spark, tmp_path):
    (tmp_path / "m.json").write_text(
        '{"model": {"end_of_word_suffix": "</w>", "vocab": {"a": 0, "b</w>": 1, "ab</w>": 2}, "merges": ["a b</w>"]}}'
    )
    model = models.load_bpe_json(spark, str(tmp_path / "m.json"))
    assert [tuple(r) for r in model.merges.collect()] == [(0, "a", "b</w>")] and model.vocab.count() == 3


def test_too_many_tokens(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(models, "MAX_JSON_TOKENS", 1)
    vocab = spark.createDataFrame([("a", 0), ("b", 1)], models.VOCAB)
    with pytest.raises(ValueError):
        models.save_bpe_json(bpe.BpeModel(vocab, spark.createDataFrame([], models.MERGES)), str(tmp_path / "x"))

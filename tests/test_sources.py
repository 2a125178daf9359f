import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import inputs as I
from misheard.operators import bpe, clips as C, lm
from misheard.plans import training
from misheard.sources import clips as SC, ledger as L, models as M, text as X
from misheard.streaming.incremental import clean_new_files

SF = "/root/testdata/sf0.001"


def test_text_round_trip(spark, tmp_path):
    s = I.sentences(spark, SF)
    out = str(tmp_path / "t")
    X.write_lines(s, out, "sentence", ["doc_id", "line_no", "sent_no"])
    want = [r[0] for r in s.orderBy("doc_id", "line_no", "sent_no").select("sentence").collect()]
    assert [r["line"] for r in X.read_lines(spark, out).orderBy("line_id").collect()] == want
    X.append_lines(s.limit(3), out, "sentence")
    assert X.read_lines(spark, out).count() == len(want) + 3
    X.write_lines(s, out, "sentence", ["doc_id", "line_no", "sent_no"], single_file=True)
    files = list((tmp_path / "t").glob("part*"))
    assert len(files) == 1 and files[0].read_text().splitlines() == want


def test_clip_files(spark, tmp_path):
    (tmp_path / "test.tsv").write_text('client\tpath\tsentence\nx\ta.mp3\tCiao!\nx\ta.mp3\tSecond\nx\tb.mp3\t"Uno ""due"""\n')
    got = SC.read_clip_table(spark, str(tmp_path / "test.tsv")).orderBy("src_row").collect()
    assert [(r["path"], r["sentence"]) for r in got] == [("a.mp3", "Ciao!"), ("a.mp3", "Second"), ("b.mp3", 'Uno "due"')]
    for d in "pvl":
        (tmp_path / d).mkdir()
    (tmp_path / "p" / "a.mp3.txt").write_text("first\nsecond\n")
    assert [tuple(r) for r in SC.read_predictions(spark, str(tmp_path / "p")).collect()] == [("a.mp3", "first")]
    np.array([1.5, -2.0]).tofile(tmp_path / "v" / "a.mp3.array")
    assert [tuple(r) for r in SC.read_vectors(spark, str(tmp_path / "v")).collect()] == [("a.mp3", [1.5, -2.0])]
    frames = np.arange(90.0).reshape(2, 45)
    np.savetxt(tmp_path / "l" / "a.mp3.logits", frames, delimiter=",")
    rows = SC.read_logits(spark, str(tmp_path / "l")).orderBy("frame_no").collect()
    keep = [0, *range(4, 44)]
    assert [(r["path"], r["frame_no"], r["scores"]) for r in rows] == [
        ("a.mp3", k, frames[k, keep].tolist()) for k in (0, 1)]
    df = spark.createDataFrame([("a", "x", "test"), ("b", "y", "train")], "path string, predicted string, split string")
    SC.write_by_split(df, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("split = 'test'").count() == 1


def test_models_round_trip(spark, tmp_path):
    t = I.seed_table(spark)
    M.save_confusions(t, str(tmp_path / "c"))
    assert M.load_confusions(spark, str(tmp_path / "c")).exceptAll(t).count() == 0
    s = I.sentences(spark, SF)
    m = bpe.train_bpe(s, "sentence", 70)
    M.save_bpe(m, str(tmp_path / "b"))
    back = M.load_bpe(spark, str(tmp_path / "b"))
    assert back.vocab.exceptAll(m.vocab).count() == 0 and back.merges.exceptAll(m.merges).count() == 0
    k = lm.kneser_ney(lm.ngram_counts(s, "sentence"))
    M.save_lm(k, str(tmp_path / "k"))
    k = M.load_lm(spark, str(tmp_path / "k"))
    M.write_arpa(k, str(tmp_path / "arpa"), single_file=True)
    lines = next((tmp_path / "arpa").glob("part*")).read_text().splitlines()
    assert lines[0] == "\\data\\" and lines[-1] == "\\end\\"
    assert lines[1] == f"ngram 1={k.where('order = 1').count()}"
    for order in (1, 2, 3):
        start = lines.index(f"\\{order}-grams:")
        assert len(lines[start + 1].split("\t")) == (2 if order == 3 else 3)
    assert len(lines) == k.count() + 1 + 3 + 2 * 4


def test_ledger(spark, tmp_path):
    path, out = str(tmp_path / "ledger"), str(tmp_path / "out")
    df = spark.createDataFrame([("a.mp3",), ("b.mp3",)], "path string")
    assert L.read_ledger(spark, path).count() == 0
    seen = []

    def process(todo):
        seen.append(sorted(r[0] for r in todo.collect()))
        return todo.withColumn("predicted", F.upper("path"))

    L.resume(df.limit(1), path, "w", process, out)
    L.resume(df, path, "w", process, out)
    L.resume(df, path, "w", process, out)
    assert seen == [["a.mp3"], ["b.mp3"], []]
    assert spark.read.parquet(out).count() == 2
    ledger = L.read_ledger(spark, path)
    assert C.processed(df, ledger, "w").count() == 2 and C.pending(df, ledger, "other").count() == 2
    with pytest.raises(Exception, match="not processed yet"):
        C.processed(df, ledger, "other").collect()


def test_strict_clip_joins(spark):
    test = spark.createDataFrame([("a", "Sì!", 0), ("a", "no", 1)], "path string, sentence string, src_row long")
    train = spark.createDataFrame([("a", "train", 0), ("b", "B b", 1)], "path string, sentence string, src_row long")
    got = {r["path"]: (r["split"], r["sentence"]) for r in C.actual_sentences(train, test).collect()}
    assert got == {"a": ("test", "sì"), "b": ("train", "b b")}
    ask = spark.createDataFrame([("a",), ("c",)], "path string")
    with pytest.raises(Exception, match="does not exist"):
        C.classify(ask, train, test).collect()
    pred = spark.createDataFrame([("a", "si"), ("z", "q")], "path string, predicted string")
    assert C.sentence_of(ask, train, test).count() == 1
    with pytest.raises(Exception, match="does not exist"):
        C.sentence_of(ask, train, test, strict=True).collect()
    with pytest.raises(Exception, match="without partner"):
        C.evaluation_pairs(C.actual_sentences(train, test), pred).collect()
    assert [tuple(r) for r in training.test_pairs(train, test, pred.union(pred)).collect()] == [("a", "sì", "si")] * 2
    unheard = C.predictions_of_test(test, spark.createDataFrame([("z", "q")], "path string, predicted string"), strict=True)
    with pytest.raises(Exception, match="not processed yet"):
        unheard.collect()
    swapped = training.validation_pairs(training.test_pairs(train, test, pred), lambda c: F.split(c, " "), swap=True)
    assert swapped.first()["line"] == "[START]~sì~[END]|[START]~si~[END]"


def test_incremental_cleaning(spark, tmp_path):
    src, out, ck = (str(tmp_path / d) for d in ("src", "out", "ck"))
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.txt").write_text("One two three four. Short.\n")
    clean_new_files(spark, src, out, ck).awaitTermination()
    (tmp_path / "src" / "b.txt").write_text("Five six seven eight nine!\n")
    clean_new_files(spark, src, out, ck).awaitTermination()
    assert sorted(r[0] for r in spark.read.parquet(out).select("sentence").collect()) == [
        "five six seven eight nine", "one two three four"]

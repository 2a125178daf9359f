import random

import pytest
from pyspark.sql import functions as F

from checks import inputs as I
from misheard import constants as K
from misheard.functions import text as T
from misheard.operators import bpe, chartok, ctc, lm, wer

SF = "/root/testdata/sf0.001"


# --- language model --------------------------------------------------------

@pytest.fixture(scope="module")
def counts(spark):
    return lm.ngram_counts(I.sentences(spark, SF), "sentence").persist()


@pytest.mark.parametrize("heavy", [10**9, 50])
def test_probabilities_sum_to_one(spark, counts, heavy):
    m = lm.kneser_ney(counts, heavy_rows=heavy).persist()
    uni = m.where("order = 1 and ngram != '<s>'").agg(F.sum("prob")).first()[0]
    assert abs(uni - 1) < 1e-9
    # seen mass plus backoff times what the shorter context leaves for the rest
    for order in (2, 3):
        g = m.where(F.col("order") == order).select(
            F.substring_index("ngram", " ", order - 1).alias("ctx"), F.expr("substr(ngram, instr(ngram, ' ') + 1)").alias("short"), "prob"
        )
        low = m.where(F.col("order") == order - 1).select(F.col("ngram").alias("short"), F.col("prob").alias("low"))
        back = m.where(F.col("order") == order - 1).select(F.col("ngram").alias("ctx"), "backoff")
        total = g.join(low, "short").groupBy("ctx").agg(F.sum("prob").alias("p"), F.sum("low").alias("q")).join(back, "ctx")
        off = total.select(F.max(F.abs(F.col("p") + F.col("backoff") * (1 - F.col("q")) - 1))).first()[0]
        assert total.count() > 1000 and off < 1e-9


def test_counts_of_a_line(spark):
    df = spark.createDataFrame([("a b a <s> b",), ("",)], "t string")
    got = {r["ngram"]: r["cnt"] for r in lm.ngram_counts(df, "t").collect()}
    assert got["<s>"] == 2 and got["a"] == 2 and got["b"] == 2 and got["a b"] == 2 and got["a b a"] == 1
    assert got["<s> </s>"] == 1 and got["b </s>"] == 1 and got["a b </s>"] == 1


def test_few_counts_raise_or_fall_back(spark):
    c = lm.ngram_counts(spark.createDataFrame([("a b",)], "t string"), "t")
    with pytest.raises(ValueError, match="too few"):
        lm.kneser_ney(c)
    assert lm.kneser_ney(c, fallback=(0.5, 1.0, 1.5)).where("order = 3").count() == 2


# --- subwords --------------------------------------------------------------

@pytest.fixture(scope="module")
def model(spark):
    return bpe.train_bpe(I.sentences(spark, SF), "sentence", 120)


def library(model, texts=None):
    tokenizers = pytest.importorskip("tokenizers")
    from tokenizers.models import BPE
    from tokenizers.pre_tokenizers import Whitespace

    vocab = {r["token"]: r["id"] for r in model.vocab.collect()}
    merges = [(r["left"], r["right"]) for r in model.merges.orderBy("rank").collect()]
    t = tokenizers.Tokenizer(BPE(vocab, merges, unk_token=K.UNK, end_of_word_suffix=model.suffix))
    t.pre_tokenizer = Whitespace()
    t.add_special_tokens(list(K.BPE_SPECIALS))
    return t


def test_batched_merges_equal_single_merges(spark):
    s = I.sentences(spark, SF)
    one, many = (bpe.train_bpe(s, "sentence", 75, batched=b) for b in (False, True))
    assert one.merges.orderBy("rank").collect() == many.merges.orderBy("rank").collect()
    assert one.vocab.orderBy("id").collect() == many.vocab.orderBy("id").collect()


def test_batches_on_small_alphabets(spark):
    r = random.Random(0)
    for trial in range(2):
        rows = [("".join(r.choice("abc") for _ in range(r.randint(1, 9))),) for _ in range(60)]
        df = spark.createDataFrame(rows, "t string").coalesce(1)
        one, many = (bpe.train_bpe(df, "t", 25, batched=b) for b in (False, True))
        assert one.merges.orderBy("rank").collect() == many.merges.orderBy("rank").collect()


def test_merges_are_the_librarys_up_to_ties(spark, model):
    tokenizers = pytest.importorskip("tokenizers")
    from tokenizers.models import BPE
    from tokenizers.pre_tokenizers import Whitespace
    from tokenizers.trainers import BpeTrainer

    t = tokenizers.Tokenizer(BPE(unk_token=K.UNK))
    t.pre_tokenizer = Whitespace()
    trainer = BpeTrainer(vocab_size=120, special_tokens=list(K.BPE_SPECIALS), end_of_word_suffix="_", show_progress=False)
    t.train_from_iterator([r["sentence"] for r in I.sentences(spark, SF).collect()], trainer)
    ours = {r["token"] for r in model.vocab.collect()}
    assert len(ours) == t.get_vocab_size() == 120
    assert len(ours & set(t.get_vocab())) >= 117


def test_pieces_equal_the_librarys(spark, model):
    t = library(model)
    texts = [r["sentence"] for r in I.sentences(spark, SF).limit(300).collect()]
    texts += ["Hello [START] w?rld!!", "a[END]b", "ñ x_y", "", "..[PAD]..", "ßß'"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i long, t string")
    tokens = bpe.tokenize(df, "t", model, "tokens").orderBy("i").collect()
    ids = bpe.tokenize(df, "t", model).orderBy("i").collect()
    for row, row_ids, text in zip(tokens, ids, texts):
        want = t.encode(text)
        assert row["tokens"] == [K.START, *want.tokens, K.END]
        assert row_ids["ids"] == [1, *want.ids, 2]


def test_char_tokenizer(spark):
    df = spark.createDataFrame([(1, "ba"), (2, ""), (3, "xbx")], "i long, t string")
    v = chartok.char_vocabulary(spark.createDataFrame([("cab",)], "t string"), "t")
    assert {r["token"]: r["id"] for r in v.collect()} == {
        "[START]": 1, "[END]": 2, "[PAD]": 3, "[UNK]": 4, "a": 5, "b": 6, "c": 7}
    for rows in (0, 100):
        ids = chartok.char_ids(df, ["i"], "t", v, max_rows=rows)
        assert {r["i"]: r["ids"] for r in ids.collect()} == {1: [1, 6, 5, 2], 2: [1, 2], 3: [1, 6, 2]}
        back = chartok.tokens_of_ids(ids, ["i"], "ids", v.where("id != 6"), max_rows=rows)
        assert {r["i"]: r["tokens"] for r in back.collect()} == {
            1: ["[START]", "a", "[END]"], 2: ["[START]", "[END]"], 3: ["[START]", "[END]"]}
    assert chartok.vocabulary_size(v).first()["size"] == 7


# --- error rate and decoding -----------------------------------------------

def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("codes", [94, 3, 0])
def test_word_edits(spark, codes):
    r = random.Random(codes)
    rows = [tuple(" ".join(r.choice("abcdefgh") * 2 for _ in range(r.randint(0, 20))) for _ in range(2)) for _ in range(200)]
    df = spark.createDataFrame(rows, "ref string, hyp string")
    got = df.select("ref", "hyp", wer.word_edits(F.col("ref"), F.col("hyp"), codes).alias("e")).collect()
    assert all(x["e"] == edits(x["ref"].split(), x["hyp"].split()) for x in got)


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_ctc_blocks(spark, block):
    r = random.Random(1)
    want, rows = {}, []
    for clip in "xyz":
        ids = [r.choice([0, 0, 4, 4, 5, 1]) for _ in range(40)]
        kept = [s for k, s in enumerate(ids) if s and (k == 0 or ids[k - 1] != s)]
        want[clip] = "".join(K.ALPHABET[s - 1] for s in kept)
        rows += [(clip, 7 * k, [1.0 if j == s else 0.0 for j in range(41)]) for k, s in enumerate(ids)]
    df = spark.createDataFrame(rows, "path string, frame_no long, scores array<double>").repartition(5)
    assert {x["path"]: x["predicted"] for x in ctc.greedy_decode(df, block=7 * block).collect()} == want


def test_token_budget(spark):
    words = lambda n: " ".join("a" * n)
    df = spark.createDataFrame([(words(29), words(3)), (words(30), words(3)), (words(3), words(30))], "a string, b string")
    kept = df.where(T.within_budget(*(T.with_markers(T.words(F.col(c))) for c in "ab")))
    assert kept.count() == 1


def test_long_words_and_piece_counts(spark):
    import random
    import time

    rng = random.Random(3)

    def slowly(parts, ranks):
        while True:
            found = [(ranks[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]
            if not found:
                return parts
            i = min(found)[1]
            parts = [*parts[:i], parts[i] + parts[i + 1], *parts[i + 2:]]

    ranks = {p: n for n, p in enumerate([("a", "b"), ("b", "a"), ("a", "a"), ("ab", "a"), ("aa", "ab"), ("aba", "b"), ("ab", "ab")])}
    for _ in range(200):
        parts = [rng.choice(["a", "b", None]) for _ in range(rng.randrange(30))]
        assert bpe.merge_symbols([*parts], ranks) == slowly(parts, ranks)
    start = time.perf_counter()
    bpe.merge_symbols(list("ab" * 50_000), ranks)
    assert time.perf_counter() - start < 10

    df = spark.createDataFrame([(1, "abab ab's bab, x"), (2, "")], "k long, t string")
    model = bpe.train_bpe(df, "t", 20)
    from misheard.functions.text import words

    rows = df.withColumn("w", words(F.col("t"))).select("k", "w", bpe.token_lengths(model)(F.col("w")).alias("n")).collect()
    one = spark.createDataFrame([(w,) for w in rows[0]["w"]], "t string")
    each = {r["t"]: len(r["tokens"]) for r in bpe.encode(one, "t", model, "tokens").collect()}
    assert [each[w] for w in rows[0]["w"]] == rows[0]["n"] and rows[1]["n"] == []

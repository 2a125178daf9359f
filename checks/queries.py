"""One query per operator: (spark, folder of parquet tables) -> DataFrame."""

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from checks import inputs as I
from misheard import constants as K
from misheard.functions import text as T
from misheard.functions.draws import row_seed, wide_draw
from misheard.functions.windows import char_ngrams
from misheard.operators import bpe, chartok, clips as C, confusion, ctc, lm, noise, pairs as P, sentences as learned, suggest, wer
from misheard.plans import corpus, training
from misheard.plans.corpus import SENTENCE_KEY as SK
from misheard.sources.text import lines_of

QUERIES: dict = {}
TURN = ["conv_id", "turn"]


def query(f):
    QUERIES[f.__name__] = f
    return f


def word_tokens(c):
    return T.words(c)


# --- sources ---------------------------------------------------------------

@query
def text_lines(spark: SparkSession, sf: str) -> DataFrame:
    return lines_of(I.docs(spark, sf))


@query
def clip_table(spark, sf):
    train, test = I.clips(spark, sf)
    return C.with_splits(train, test).select("path", "split", "src_row", F.length("sentence").alias("chars"))


@query
def first_line_predictions(spark, sf):
    return I.docs(spark, sf).select(
        F.concat(F.lit("clip_"), F.col("doc_id").cast("string")).alias("path"),
        F.split("text", "\n")[0].alias("predicted"),
    )


@query
def vector_sidecars(spark, sf):
    v = F.col("embedding").cast("array<double>")
    return I.table(spark, sf, "embeddings").select(
        "vec_id", F.size(v).alias("dims"), F.element_at(v, 1).alias("first"), F.element_at(v, -1).alias("last"),
        F.array_max(v).alias("top"),
    )


@query
def logit_columns(spark, sf):
    kept = ctc.keep_symbol_scores(F.col("frame"))
    return I.frames(spark, sf).select(
        "path", "frame_no", F.size(kept).alias("symbols"), kept[0].alias("blank"), kept[1].alias("first"),
        kept[40].alias("last"), ctc.best_symbol(kept).alias("best"),
    )


# --- projections and filters ----------------------------------------------

@query
def purify_text(spark, sf):
    return I.docs(spark, sf).select("doc_id", T.purify(F.col("text")).alias("clean"))


@query
def min_words_filter(spark, sf):
    return I.docs(spark, sf).select("doc_id", T.purify(F.col("text")).alias("clean")).where(
        T.long_enough(T.words(F.col("clean")))
    )


@query
def both_long_filter(spark, sf):
    return I.turns(spark, sf).where(T.both_long_enough(F.col("ref"), F.col("hyp")))


@query
def token_budget_filter(spark, sf):
    a, b = (T.with_markers(T.words(F.col(c))) for c in ("ref", "hyp"))
    return I.turns(spark, sf).where(T.within_budget(a, b)).select(*TURN, F.size(a).alias("n_ref"), F.size(b).alias("n_hyp"))


@query
def pair_guard(spark, sf):
    return I.turns(spark, sf).select(
        *TURN, P.pair_status(F.col("ref"), F.col("hyp")).alias("forward"),
        P.pair_status(F.col("ref"), F.col("ref")).alias("with_itself"),
        P.pair_status(F.col("ref"), F.lit("")).alias("with_nothing"),
    )


@query
def audio_paths(spark, sf):
    ext = F.when(F.col("lang").isin("en", "fr"), ".Mp3").otherwise(".ogg")
    path = F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), ext)
    return I.docs(spark, sf).select("doc_id", path.alias("path")).where(T.is_audio(F.col("path")))


@query
def clip_paths(spark, sf):
    p = F.col("path")
    return I.all_clips(spark, sf).select(
        "path", T.clip_path("clips", p).alias("audio"), T.clip_path("logits/", p, K.LOGITS_EXT).alias("logits"),
        T.clip_path("array", p, K.VECTOR_EXT).alias("vector"), T.clip_path("predictions", p, K.PREDICTION_EXT).alias("text"),
    )


@query
def render_pairs(spark, sf):
    a, b = (T.with_markers(T.words(F.col(c))) for c in ("hyp", "ref"))
    return I.turns(spark, sf).select(*TURN, T.render_pair(a, b).alias("line"))


# --- generators ------------------------------------------------------------

@query
def clean_corpus(spark, sf):
    return I.sentences(spark, sf)


@query
def sentence_split(spark, sf):
    return corpus.sentences_of(lines_of(I.docs(spark, sf)), ["doc_id", "line_no"])


@query
def abbreviation_scores(spark, sf):
    found = learned.abbreviation_scores(lines_of(I.docs(spark, sf)))
    return found.select("type", "n_with", "n_without", F.round("score", 6).alias("score"))


@query
def learned_sentences(spark, sf):
    lines = lines_of(I.docs(spark, sf))
    return learned.learned_sentences(lines, ["doc_id", "line_no"], learned.abbreviations(lines))


@query
def rule_word_tokens(spark, sf):
    """Words of the sentences as they stand, by the word rules."""
    w = T.rule_words(F.col("sentence"))
    split = corpus.sentences_of(lines_of(I.docs(spark, sf)), ["doc_id", "line_no"])
    return split.select(*SK, F.size(w).alias("n"), F.array_join(w, "|").alias("words"))


@query
def word_tokens_of_sentences(spark, sf):
    w = T.words(F.col("sentence"))
    return I.sentences(spark, sf).select(*SK, F.size(w).alias("n"), F.array_join(w, "|").alias("words"))


@query
def word_windows(spark, sf):
    return training.window_rows(I.sentences(spark, sf), SK)


@query
def char_windows(spark, sf):
    return training.char_window_rows(I.sentences(spark, sf), SK)


@query
def balanced_split(spark, sf):
    return training.balanced_rows(I.sentences(spark, sf), SK, 3)


@query
def auto_split_words(spark, sf):
    """Every word one token."""
    return training.budget_rows(I.sentences(spark, sf), SK, lambda w: F.transform(w, lambda x: F.lit(1)))


@query
def auto_split_chars(spark, sf):
    """Every character one token, spaces included."""
    return training.budget_rows(
        I.sentences(spark, sf), SK, lambda w: F.transform(w, lambda x: F.length(x)), joiner=1
    )


@query
def auto_split_bpe(spark, sf):
    """Every subword piece one token."""
    return training.budget_rows(I.sentences(spark, sf), SK, bpe.token_lengths(_bpe(spark, sf)))


@query
def aligned_windows(spark, sf):
    wins = confusion.aligned_windows(I.padded_turns(spark, sf), TURN, 3, 3)
    return wins.groupBy(*TURN).agg(
        F.count(F.lit(1)).alias("windows"),
        F.count_if(F.col("ref_win") == F.col("hyp_win")).alias("same"),
        F.min("ref_win").alias("least_ref"),
        F.max("hyp_win").alias("most_hyp"),
        F.max("at").cast("int").alias("last"),
    )


@query
def char_ngram_arrays(spark, sf):
    return I.turns(spark, sf).select(*TURN, F.array_join(char_ngrams(F.col("ref"), 3), "|").alias("grams"))


def _chunks(spark, sf):
    rs = row_seed(11, *[F.col(k) for k in SK])
    return I.sentences(spark, sf).select(*SK, noise.random_chunks(rs, F.col("sentence")).alias("chunks"))


@query
def random_chunks(spark, sf):
    return _chunks(spark, sf).select(*SK, F.array_join("chunks", "|").alias("chunks"))


@query
def chunk_offsets(spark, sf):
    """Running sum of chunk lengths, summed up per sentence."""
    rows = _chunks(spark, sf).repartition(*SK).select(*SK, F.posexplode("chunks").alias("k", "chunk"))
    upto = Window.partitionBy(*SK).orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offset = rows.withColumn("end", F.sum(F.length("chunk")).over(upto))
    return offset.groupBy(*SK).agg(
        F.max("end").alias("chars"), F.count(F.lit(1)).alias("chunks"), F.sum(F.col("end") * (F.col("k") + 1)).alias("mix")
    )


# --- joins and lookups -----------------------------------------------------

@query
def clip_sentence(spark, sf):
    return C.sentence_of(I.all_clips(spark, sf), *I.clips(spark, sf))


@query
def split_of_clip(spark, sf):
    return C.classify(I.all_clips(spark, sf), *I.clips(spark, sf), strict=False)


@query
def split_of_known_clip(spark, sf):
    train, test = I.clips(spark, sf)
    known = train.select("path").unionByName(test.select("path"))
    return C.classify(known, train, test)


@query
def unknown_clips(spark, sf):
    return C.unknown_clips(I.all_clips(spark, sf), *I.clips(spark, sf))


@query
def evaluation_pairs(spark, sf):
    return training.test_pairs(*I.clips(spark, sf), I.predictions(spark, sf))


@query
def repeated_evaluation_pairs(spark, sf):
    """Paths listed twice and recognised twice: one pair per listed row."""
    train, test = I.clips(spark, sf)
    twice = test.unionByName(test.where(F.col("src_row") % 3 == 0))
    heard = I.predictions(spark, sf)
    return training.test_pairs(train, twice, heard.unionByName(heard))


@query
def unmatched_clips(spark, sf):
    train, _ = I.clips(spark, sf)
    return C.unmatched(train, I.predictions(spark, sf))


@query
def processed_clips(spark, sf):
    return C.processed(I.predictions(spark, sf), I.ledger(spark, sf), "recognise", strict=False)


@query
def pending_clips(spark, sf):
    return C.pending_audio(I.all_clips(spark, sf), I.ledger(spark, sf), "recognise")


@query
def chunk_candidates(spark, sf):
    c = confusion.candidates(I.turn_confusions(spark, sf))
    return c.top.select("chunk", "total", F.col("n").cast("int").alias("n"), "first")


def _char_vocab(spark, sf):
    return chartok.char_vocabulary(I.turns(spark, sf), "ref")


@query
def ids_with_oov(spark, sf):
    """Words looked up in a word vocabulary of the benchmark texts."""
    b = I.table(spark, sf, "benchmark").select(T.purify(F.col("text")).alias("t"))
    found = b.select(F.explode(T.words(F.col("t"))).alias("token")).distinct()
    # numbered within two-letter starts, whose few counts are summed up first
    found = found.withColumn("start", F.substr("token", F.lit(1), F.lit(2)))
    before = Window.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    starts = found.groupBy("start").agg(F.count(F.lit(1)).alias("n")).select(
        "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")
    )
    place = F.row_number().over(Window.partitionBy("start").orderBy("token")) - 1
    vocab = found.join(starts, "start").select("token", (F.col("first") + place).cast("int").alias("id"))
    rows = I.turns(spark, sf).select(*TURN, T.words(F.col("ref")).alias("tokens"))
    done = chartok.ids_with_buckets(rows, TURN, "tokens", vocab, 5)
    return done.select(*TURN, F.array_join(done["ids"].cast("array<string>"), " ").alias("ids"))


@query
def tokens_from_ids(spark, sf):
    """Character ids back to characters; the reader knows fewer characters."""
    ids = chartok.char_ids(I.turns(spark, sf), TURN, "ref", _char_vocab(spark, sf))
    fewer = _char_vocab(spark, sf).where(F.col("id") % 7 != 0)
    return chartok.tokens_of_ids(ids, TURN, "ids", fewer).select(*TURN, F.array_join("tokens", "").alias("text"))


# --- alignment and confusion learning --------------------------------------

@query
def pad_pairs(spark, sf):
    return I.padded_turns(spark, sf)


@query
def banded_alignment(spark, sf):
    """Counts per sentence over whole texts, and the aligned strings."""
    return P.align_pairs(I.noisy_pairs(spark, sf)).select(*SK, "status", "ref_aln", "hyp_aln")


@query
def bulk_alignment(spark, sf):
    """Aligner with a caller-supplied cleaner: spaces removed."""
    return P.align_pairs(I.turns(spark, sf), purifier=lambda c: F.replace(c, F.lit(" "), F.lit("")))


@query
def bulk_part_alignment(spark, sf):
    """The same on descriptions of parts, which SQL can follow."""
    found = P.align_pairs(I.part_pairs(spark, sf), purifier=lambda c: F.replace(c, F.lit(" "), F.lit("")))
    return found.select("p_partkey", "ref", "hyp", "status", "ref_aln", "hyp_aln")


@query
def unbanded_alignment(spark, sf):
    return P.align_windows(I.noisy_pairs(spark, sf)).select(*SK, "ref_aln", "hyp_aln")


@query
def unbanded_part_alignment(spark, sf):
    return P.align_windows(I.part_pairs(spark, sf)).select("p_partkey", "ref", "hyp", "ref_aln", "hyp_aln")


@query
def banded_part_alignment(spark, sf):
    return P.align_pairs(I.part_pairs(spark, sf)).select("p_partkey", "ref", "hyp", "status", "ref_aln", "hyp_aln")


@query
def part_sweeps(spark, sf):
    swept = P.sweep_pairs(I.part_pairs(spark, sf)).select("p_partkey", F.inline("sweeps"))
    return swept.select("p_partkey", "cfg", F.round("score", 6).alias("score"), "ref_aln", "hyp_aln")


@query
def part_best_alignment(spark, sf):
    best = P.align_by_sweep(I.part_pairs(spark, sf)).where(F.col("ref_aln").isNotNull())
    return best.select("p_partkey", F.round("score", 6).alias("score"), "cfg", "ref_aln", "hyp_aln")


@query
def part_confusions(spark, sf):
    """Corrupted, swept, and learned from: what top_confusions does, on texts
    that SQL can follow."""
    return training.learn_confusions(I.part_pairs(spark, sf))


@query
def sweep_alignment(spark, sf):
    swept = P.sweep_pairs(I.noisy_pairs(spark, sf)).select(*SK, F.inline("sweeps"))
    return swept.select(*SK, "cfg", F.round("score", 6).alias("score"), "ref_aln", "hyp_aln")


@query
def best_alignment(spark, sf):
    best = P.align_by_sweep(I.noisy_pairs(spark, sf))
    return best.select(*SK, "cfg", F.round("score", 6).alias("score"), "ref_aln", "hyp_aln")


@query
def gaps_restore_inputs(spark, sf):
    """Alignments without their gaps are the two sentences again."""
    best = P.align_by_sweep(I.noisy_pairs(spark, sf))
    ungapped = {c: F.replace(f"{c}_aln", F.lit(K.GAP), F.lit("")).alias(c) for c in ("ref", "hyp")}
    return best.select(
        *SK, *ungapped.values(), (F.length("ref_aln") == F.length("hyp_aln")).alias("same_length"),
    )


@query
def column_pairs(spark, sf):
    return P.column_pairs(I.padded_turns(spark, sf), TURN)


@query
def forward_confusions(spark, sf):
    return I.turn_confusions(spark, sf)


@query
def reverse_confusions(spark, sf):
    return confusion.reverse_table(I.padded_turns(spark, sf))


@query
def merged_confusions(spark, sf):
    padded = I.padded_turns(spark, sf)
    return confusion.merge_tables(
        confusion.reverse_table(padded.where(F.col("turn") % 2 == 0)),
        confusion.reverse_table(padded.where(F.col("turn") % 2 == 1)),
    )


@query
def learned_confusions(spark, sf):
    return training.learn_confusions(I.noisy_pairs(spark, sf))


@query
def confusions_of_clips(spark, sf):
    return training.learn_from_clips(*I.clips(spark, sf), I.predictions(spark, sf))


@query
def part_clip_confusions(spark, sf):
    """Learned from the test split of clips whose sentences are descriptions of parts."""
    return training.learn_from_clips(*I.part_clips(spark, sf))


@query
def reverse_fit(spark, sf):
    """The whole reverse table of the noisy pairs, summed up by chunk length."""
    fitted = training.fit_reverse(I.noisy_pairs(spark, sf))
    return fitted.groupBy(F.length("chunk").alias("chunk_chars")).agg(
        F.count(F.lit(1)).alias("entries"),
        F.sum("cnt").alias("windows"),
        F.sum(F.when(F.col("chunk") == F.col("replacement"), F.col("cnt")).otherwise(0)).alias("same"),
    )


@query
def top_confusions(spark, sf):
    """Documents, cleaned, corrupted, aligned: what is confused most often."""
    learned = training.learn_confusions(I.noisy_pairs(spark, sf))
    return learned.where(F.col("chunk") != F.col("replacement")).orderBy(
        F.desc("cnt"), "chunk", "replacement"
    ).limit(100)


# --- noise and suggestions -------------------------------------------------

@query
def corrupted_corpus(spark, sf):
    return I.noisy_pairs(spark, sf)


@query
def corrupted_turns(spark, sf):
    """Corruption with a table learned from the data."""
    return noise.corrupt(I.turns(spark, sf).select(*TURN, "ref"), TURN, "ref", I.turn_confusions(spark, sf), 3, truncate_to=3)


@query
def noisy_training_pairs(spark, sf):
    return training.noisy_training_pairs(I.sentences(spark, sf), SK, I.seed_table(spark), word_tokens, 5)


@query
def known_spans(spark, sf):
    """Where the suggestion walk may step: per name and place, the lengths."""
    parts = I.table(spark, sf, "part").select("p_partkey", "p_name")
    spans = suggest.known_spans(parts, ["p_partkey"], "p_name", I.turn_confusions(spark, sf))
    return spans.select("p_partkey", "at", "len", "chunk")


@query
def suggestions(spark, sf):
    parts = I.table(spark, sf, "part").select("p_partkey", "p_name")
    table = confusion.reverse_table(I.padded_turns(spark, sf)).persist()
    return suggest.suggestions(parts, ["p_partkey"], "p_name", table, seed=2)


@query
def weighted_picks(spark, sf):
    found = confusion.candidates(I.turn_confusions(spark, sf))
    seeded = found.top.withColumn("rs", row_seed(1, F.col("chunk")))
    rows = seeded.select("*", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    rows = rows.withColumn("_at", F.pmod(wide_draw(F.col("rs"), F.col("k")), F.col("total")))
    return confusion.drawn(rows, found, ["chunk", "k"]).select("chunk", "k", F.col("_repl").alias("repl"))


# --- aggregations and statistics -------------------------------------------

@query
def word_error_rate(spark, sf):
    return wer.word_error_rate(I.turns(spark, sf)).select("edits", "ref_words", F.round("wer", 9).alias("wer"))


@query
def clip_word_error_rate(spark, sf):
    """Whole recognised texts of the test split."""
    return wer.word_error_rate(training.test_pairs(*I.clips(spark, sf), I.predictions(spark, sf)))


@query
def turn_word_edits(spark, sf):
    """Turns, line by line of their words: pairs below the one-byte code limit
    and above it."""
    return wer.scored_pairs(I.turns(spark, sf)).select(*TURN, "edits", "ref_words")


@query
def longest_tokenisation(spark, sf):
    rows = training.window_rows(I.sentences(spark, sf), SK).withColumn("t", T.words(F.col("window")))
    return training.longest_tokens(rows, ["doc_id"], "t")


@query
def vocabulary_size(spark, sf):
    return chartok.vocabulary_size(_char_vocab(spark, sf))


@query
def ngram_counts(spark, sf):
    return lm.ngram_counts(I.sentences(spark, sf), "sentence")


@query
def language_model(spark, sf):
    counts = lm.ngram_counts(I.sentences(spark, sf), "sentence").persist()
    m = lm.kneser_ney(counts)
    counts.unpersist()
    return m.select(
        "order", "ngram", F.round("logp", 6).alias("logp"), F.round("log_backoff", 6).alias("log_backoff")
    )


@query
def bpe_word_counts(spark, sf):
    return bpe.word_counts(I.sentences(spark, sf), "sentence")


@query
def bpe_first_pairs(spark, sf):
    return bpe.pair_counts(bpe.symbol_words(bpe.word_counts(I.sentences(spark, sf), "sentence")))


def _bpe(spark, sf):
    both = corpus.corpora(
        I.sentences(spark, sf).select("sentence"), I.noisy_pairs(spark, sf).select(F.col("hyp").alias("sentence"))
    )
    return bpe.train_bpe(both, "sentence", K.VOCAB_SIZE)


@query
def bpe_merges(spark, sf):
    return _bpe(spark, sf).merges


@query
def bpe_vocabulary(spark, sf):
    return _bpe(spark, sf).vocab


@query
def char_vocabulary(spark, sf):
    return _char_vocab(spark, sf)


# --- token operators -------------------------------------------------------

@query
def bpe_tokens(spark, sf):
    done = bpe.tokenize(I.sentences(spark, sf), "sentence", _bpe(spark, sf), "tokens")
    return done.select(*SK, F.array_join("tokens", " ").alias("tokens"))


@query
def bpe_round_trip(spark, sf):
    """Ids and back: the words again, separated by single spaces."""
    model = _bpe(spark, sf)
    ids = bpe.tokenize(I.sentences(spark, sf), "sentence", model)
    return bpe.detokenize(ids, SK, "ids", model)


@query
def bpe_training_pairs(spark, sf):
    return training.noisy_training_pairs(
        I.sentences(spark, sf), SK, I.seed_table(spark), bpe.tokenizer(_bpe(spark, sf)), 5
    )


@query
def char_token_strings(spark, sf):
    return chartok.char_tokens(I.turns(spark, sf), "ref").select(*TURN, F.array_join("tokens", " ").alias("tokens"))


@query
def char_token_ids(spark, sf):
    """Ids under the vocabulary of the benchmark texts; other characters drop."""
    vocab = chartok.char_vocabulary(I.table(spark, sf, "benchmark").select(F.lower("text").alias("t")), "t")
    done = chartok.char_ids(I.turns(spark, sf), TURN, "ref", vocab)
    return done.select(*TURN, F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query
def ctc_decode(spark, sf):
    f = I.frames(spark, sf).withColumn("scores", ctc.keep_symbol_scores(F.col("frame")))
    return ctc.greedy_decode(f, block=64)


# --- limits, unions, listings ----------------------------------------------

@query
def head_lines(spark, sf):
    return corpus.head(lines_of(I.docs(spark, sf)), ["doc_id", "line_no"], 1000)


@query
def head_lines_default(spark, sf):
    """As many lines as the small corpus of the reference setup has."""
    return corpus.head(lines_of(I.docs(spark, sf)), ["doc_id", "line_no"])


@query
def union_corpora(spark, sf):
    b = I.table(spark, sf, "benchmark").withColumnRenamed("item_id", "doc_id")
    return corpus.corpora(I.sentences(spark, sf), corpus.clean_corpus(b))


@query
def split_listings(spark, sf):
    train, test = I.clips(spark, sf)
    parts = [C.by_split(train, test, m).withColumn("list", F.lit(m)) for m in ("train", "test")]
    raw = C.train_sentences(train).withColumn("list", F.lit("train as listed"))
    heard = C.predictions_of_test(test, I.predictions(spark, sf)).select(
        "path", F.col("predicted").alias("sentence"), F.lit("heard").alias("list")
    )
    return corpus.corpora(*parts, raw, heard)


@query
def validation_pairs(spark, sf):
    pairs = training.test_pairs(*I.clips(spark, sf), I.predictions(spark, sf)).unionByName(
        I.turns(spark, sf).select(
            F.concat_ws("-", F.lit("turn"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("path"),
            "ref", "hyp",
        )
    )
    return training.validation_pairs(pairs, word_tokens)

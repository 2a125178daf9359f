"""Fixed values that define the semantics of the library."""

# --- fixed values: alphabet of recognised text, in order -------------------
ALPHABET = " '-abcdefghijklmnopqrstuvwxyzàáèéìíòóùúš"
# Hyphen is listed in the alphabet but cleaning removes it.
CLEAN_ALPHABET = " 'abcdefghijklmnopqrstuvwxyzàáèéìíòóùúš"
GAP = "?"

# --- fixed values: sizes ---------------------------------------------------
MIN_WORDS_EXCLUSIVE = 3        # a kept sentence has more words than this
MIN_CHARS_EXCLUSIVE = 4        # a scored pair has more characters than this
MAX_TOKENS = 32                # token budget of one training sequence
WORD_WINDOW = 22               # int(0.7 * MAX_TOKENS)
WORD_STRIDE = 11               # WORD_WINDOW // 2
SPLIT_TOKENS = 25              # int(0.8 * MAX_TOKENS)
CHAR_WINDOW = 100
CHAR_STRIDE = 25
SMALL_CORPUS_LINES = 400_000
INPUT_SPLIT_BYTES = 16_000_000
VOCAB_SIZE = 40_000
LM_ORDER = 3
CONFUSION_ORDER = 3
MAX_GRAM = 12
N_SUGGESTIONS = 100
ALIGN_BAND = 10
LENGTH_RATIO_CUT = 0.8
CHUNK_SIZES = (1, 2, 3, 4)
# (window, stride) pairs tried by the sliding re-alignment, in this order.
SWEEP_CONFIGS = ((3, 2), (6, 2), (7, 3), (8, 3), (9, 5))

# --- fixed values: special tokens ------------------------------------------
START, END, PAD, UNK = "[START]", "[END]", "[PAD]", "[UNK]"
BPE_SPECIALS = (UNK, START, END, PAD)
CHAR_SPECIALS = ((START, 1), (END, 2), (PAD, 3), (UNK, 4))
FIRST_CHAR_ID = 5
WORD_END = "_"
OOV_BUCKETS_BPE = 5
OOV_BUCKETS_CHAR = 1
TOKEN_SEP, PAIR_SEP = "~", "|"
LM_BOS, LM_EOS, LM_UNK = "<s>", "</s>", "<unk>"

# --- fixed values: columns kept from a frame of recogniser scores ----------
LOGIT_BLANK_COLUMN = 0
LOGIT_FIRST_SYMBOL_COLUMN = 4
# Score index 0 is the blank, index k > 0 is the k-th alphabet symbol.
CTC_BLANK = 0

# --- fixed values: file endings --------------------------------------------
AUDIO_EXT, VECTOR_EXT, LOGITS_EXT, PREDICTION_EXT = ".mp3", ".array", ".logits", ".txt"

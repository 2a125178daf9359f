"""Line, sentence, word and cleaning expressions (all JVM-side)."""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

from misheard import constants as K


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value worked out once per row. Anything named
    inside a lambda is otherwise evaluated again for each element."""
    return F.transform(F.array(value), use)[0]


def lines(text: Column) -> Column:
    """Physical lines of a text; a trailing line break adds no empty line."""
    return bind(
        F.split(text, r"\r\n|\r|\n", -1),
        lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p),
    )


def sentences(line: Column) -> Column:
    """Split after `.`, `!` or `?` when whitespace follows."""
    return F.split(line, r"(?<=[.!?])[ \t\n\r\f]+", -1)


def purify(text: Column, alphabet: str = K.CLEAN_ALPHABET) -> Column:
    """Lower-case, delete everything outside the alphabet, trim."""
    allowed = "".join("\\" + c if c in r"\]^-[" else c for c in alphabet)
    return F.trim(F.regexp_replace(F.lower(text), f"[^{allowed}]", ""))


def words(text: Column) -> Column:
    """Whitespace-separated words."""
    return F.filter(F.split(text, " +"), lambda w: w != "")


# The published word rules of the Penn Treebank, in order. Quotes that
# open, punctuation, brackets, dashes; then, between blanks, quotes that close,
# endings and contractions.
WORD_RULES = (
    (r"([«“‘„]|`+)", " $1 "),
    (r'^"', " `` "),
    (r"([ (\[{<])(\"|'')", "$1 `` "),
    (r"'([a-ce-lo-ru-zA-CE-LO-RU-Z0-9_])([^\p{L}\p{N}_]|$)", "' $1$2"),
    (r"([^.])(\.)([\])}>\"'»”’ ]*)$", "$1 $2 $3 "),
    (r"([:,])([^0-9])", " $1 $2"),
    (r"([:,])$", " $1 "),
    (r"(\.{2,})", " $1 "),
    (r"([;@#$%&?!*])", " $1 "),
    (r"([^'])' ", "$1 ' "),
    (r"([\]\[(){}<>])", " $1 "),
    (r"(--)", " $1 "),
    (r"^(.*)$", " $1 "),
    (r"([»”’])", " $1 "),
    (r"('')", " $1 "),
    (r'"', " '' "),
    (r"([^' ])('[sSmMdD]|') ", "$1 $2 "),
    (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", "$1 $2 "),
    (r" +", "  "),
    (r"(?i)([^\p{L}\p{N}_])(can)(not)([^\p{L}\p{N}_])", "$1 $2 $3 $4"),
    (r"(?i)([^\p{L}\p{N}_])(gim|lem)(me)([^\p{L}\p{N}_])", "$1 $2 $3 $4"),
    (r"(?i)([^\p{L}\p{N}_])(gon|wan)(na)([^\p{L}\p{N}_])", "$1 $2 $3 $4"),
    (r"(?i)([^\p{L}\p{N}_])(got)(ta)([^\p{L}\p{N}_])", "$1 $2 $3 $4"),
    (r"(?i)([^\p{L}\p{N}_])(d)('ye)([^\p{L}\p{N}_])", "$1 $2 $3 $4"),
    (r"(?i)([^\p{L}\p{N}_])(more)('n)([^\p{L}\p{N}_])", "$1 $2 $3 $4"),
    (r"(?i) ('t)(is|was)([^\p{L}\p{N}_])", " $1 $2 $3"),
)


# The same rules in their order, in runs that need one of these strings to match at all
# (none: always applied); those of contractions are looked for in lower case.
RULE_RUNS = (
    (("«", "“", "‘", "„", "`", '"', "'"), WORD_RULES[:4]),
    ((), WORD_RULES[4:5]),
    ((":", ","), WORD_RULES[5:7]),
    (("..",), WORD_RULES[7:8]),
    ((), WORD_RULES[8:9]),
    (("'",), WORD_RULES[9:10]),
    ((), WORD_RULES[10:11]),
    (("--",), WORD_RULES[11:12]),
    ((), WORD_RULES[12:13]),
    (("»", "”", "’", "'", '"'), WORD_RULES[13:18]),
    ((), WORD_RULES[18:19]),
    (("cannot", "gimme", "lemme", "gonna", "wanna", "gotta", "d'ye", "more'n", "'tis", "'twas"), WORD_RULES[19:]),
)


def _apply_rules(marked: Column, rules: tuple) -> Column:
    for pattern, put in rules:
        marked = F.regexp_replace(marked, pattern, put)
    return marked


def _where_needed(needed: tuple, rules: tuple) -> Callable[[Column], Column]:
    def apply(m: Column) -> Column:
        low = F.lower(m) if any(len(x) > 2 for x in needed) else m
        found = reduce(Column.__or__, [F.contains(low, F.lit(x)) for x in needed])
        return F.when(found, _apply_rules(m, rules)).otherwise(m)

    return apply


def rule_words(sentence: Column) -> Column:
    """Words of a sentence by `WORD_RULES`: punctuation, quotes, endings and parts of
    contractions are words of their own; line breaks and tabs are blanks."""
    marked = F.regexp_replace(sentence, r"[ \t\n\r\f]+", " ")
    for needed, rules in RULE_RUNS:
        marked = bind(marked, _where_needed(needed, rules)) if needed else _apply_rules(marked, rules)
    return words(marked)


def chars(text: Column) -> Column:
    """The characters of a string; the empty string has none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


def long_enough(words_col: Column) -> Column:
    return F.size(words_col) > K.MIN_WORDS_EXCLUSIVE


def both_long_enough(a: Column, b: Column) -> Column:
    return (F.length(a) > K.MIN_CHARS_EXCLUSIVE) & (F.length(b) > K.MIN_CHARS_EXCLUSIVE)


def within_budget(a: Column, b: Column, budget: int = K.MAX_TOKENS) -> Column:
    """Both token arrays, start and end markers included, are below the budget."""
    return (F.size(a) < budget) & (F.size(b) < budget)


def render_pair(corrupted: Column, clean: Column) -> Column:
    """One training line: `t~t~t|t~t`."""
    return F.concat_ws(
        K.PAIR_SEP, F.array_join(corrupted, K.TOKEN_SEP), F.array_join(clean, K.TOKEN_SEP)
    )


def with_markers(tokens: Column) -> Column:
    return F.concat(F.array(F.lit(K.START)), tokens, F.array(F.lit(K.END)))


def is_audio(path: Column) -> Column:
    return F.lower(path).endswith(K.AUDIO_EXT)


def clip_path(directory: str, clip: Column, ext: str = "") -> Column:
    return F.concat(F.lit(directory.rstrip("/") + "/"), clip, F.lit(ext))

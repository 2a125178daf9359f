"""Secret scans: plain patterns, and the guess cost of values in a credential
context.

The guess cost of a value is the smallest sum, over all ways to cut it into
words of a ranked list, dates, repeats, keyboard walks and brute-force spans, of
the bits each part takes to guess. The cut is found by dynamic programming from
left to right; brute-force spans cost the same for every character, so they need
no segments of their own and long values stay linear. Values at or over
`min_bits` after a word such as "password" or "bearer", also as the end of a name
such as DB_PASSWORD, are spans of kind guess. Values that name a secret instead of
holding it (variables, calls, addresses without a password, paths) are none.
Repeats are seen for blocks of up to 8 characters; longer blocks count as their parts.

The ranked list is learned from the corpus (`learn_words`), after a few words that
are tried first when passwords are guessed. A word is learned if it follows several
different words, so that a secret in many copies of one text is not.

Spans are (kind, start, end) in code points of the whole text, end exclusive.
Null and empty texts have none, empty tables give no rows and teach no words.
Documents are independent: map only, but for the counts of words; ids may be null or
repeat; other columns, clashing names too, are passed on by `redact` only.
"""

import hashlib
import re
from math import log2

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from misheard.llm.common import cut, free_name

# The patterns of the plain kinds.
ASSIGN = re.compile(
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "guess")

# Words that announce a credential, alone or as parts of a name (DB_PASSWORD,
# dbPassword, secret_key_base), and the value that follows them, after the name of
# an authorization scheme or not.
CONTEXT = re.compile(
    r"""(?:(?<![A-Za-z0-9])|(?<=[a-z0-9])(?=[A-Z]))(?i:(?:pass(?:word|wd|phrase|code|key)?|pwd|pin|secret|token"""
    r"""|auth(?:orization)?|bearer|login|credentials?|(?:api|access|private|secret)[_-]?key)"""
    r"""(?:[_-]?(?:key|token|secret|value|base|hash|prod|dev|test|\d{1,4})){0,3}["']?[ \t]*(?:=>|[:=])[ \t]*["']?"""
    r"""(?:(?:bearer|basic|token)[ \t]+)?)([^\s"'<>,;]{6,})""",
    re.ASCII,
)
# A bearer token after white space alone; in prose the word is followed by words.
BEARER = re.compile(
    r"""(?<![A-Za-z0-9])(?i:bearer)[ \t]+(?=[^\s"'<>,;]*(?:[0-9]|[a-z][A-Z]))([^\s"'<>,;]{6,})""", re.ASCII
)
CONTEXT_WORDS = ("pass", "pwd", "pin", "secret", "token", "auth", "bearer", "login", "credential", "key")
MIN_BITS = 40.0

# Words that are tried first when passwords are guessed, by rank.
COMMON_WORDS = tuple(
    """password qwerty letmein welcome admin dragon monkey master login sunshine princess football
    baseball shadow superman batman trustno access flower hello freedom whatever secret summer winter
    spring autumn love iloveyou ashley michael jordan hunter ranger tigger soccer hockey killer george
    charlie andrew thomas jessica pepper ginger cookie banana orange purple yellow silver golden diamond
    computer internet server system root user guest test testing example sample demo default change
    changeme temp temporary private public key token pass word account office company manager support
    service backup database mysql oracle windows linux google apple amazon phone mobile family friend
    angel baby sweet lucky magic star money power house coffee music guitar matrix""".split()
)
# Rows of a keyboard and sequences that fingers or eyes follow.
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz", "1qaz2wsx3edc4rfv")
_STEPS = {r[k] + r[k + 1] for row in ROWS for r in (row, row[::-1]) for k in range(len(row) - 1)}
_LEET = str.maketrans("4@3105$7", "aaeiosst")
_DATE = re.compile(
    r"(?:19|20)\d\d([-/.]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])"
    r"|(?:0[1-9]|[12]\d|3[01])([-/.]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d"
)
_REPEAT = re.compile(r"(.{1,8}?)\1{2,}", re.S)
_CLASSES = ((re.compile("[a-z]"), 26), (re.compile("[A-Z]"), 26), (re.compile("[0-9]"), 10),
            (re.compile("[^a-zA-Z0-9]"), 33))


# First parts of names that hold settings in programs.
HOLDERS = "self this cls os process env environ config conf settings options args request req ctx secrets vault app".split()
# What names a secret: a variable, a setting, a call or an index, an address
# without a password in it, a path of plain names.
REFERENCE = re.compile(
    r"\$\{?\w.*|\{\{.*|%\w+%|\$\(.*"
    r"|(?:" + "|".join(HOLDERS) + r")(?:\.[A-Za-z_]\w*)+\W*"
    r"|[A-Za-z_]+(?:(?:\.|::|->)[A-Za-z_]+)*(?:\[|\(|\[.*\][,;.)]*|\(.*\)[,;.)]*)"
    r"|[a-z][a-z0-9+]*://[^@?#]*"
    r"|(?:~|\.{1,2})?(?:/(?:[a-z]+(?:[._-][a-z]+)*[0-9]{0,3}|[0-9]{1,4}))+/?[.)]*",
    re.S,
)
_VALUE = re.compile(r"""[^\s"'<>,;]+""")

# Learned words: of 3 to 32 letters, at most MAX_WORDS by falling count, seen after
# words of at least CONTEXTS kinds.
MAX_WORDS = 50_000
CONTEXTS = 4
_TOKEN = re.compile(r"\S+")
_KEPT_WORDS = 100_000      # held by a task at once


class Ranks:
    """Words by rank from 1."""

    def __init__(self, words: tuple = ()):
        every = dict.fromkeys((*COMMON_WORDS, *words))
        self.of = {w: n + 1 for n, w in enumerate(every)}
        self.longest = max(map(len, self.of))


COMMON = Ranks()


def _word(token: str) -> str:
    """The word in a token of running text, else an empty string."""
    word = token.strip("()[]\"'“”«».,;:!?¿¡")
    return word.lower() if 3 <= len(word) <= 32 and word.isalpha() and word[1:].islower() else ""


def learn_words(
    docs: DataFrame, text_col: str = "text", most: int = MAX_WORDS, contexts: int = CONTEXTS
) -> tuple[str, ...]:
    """The words of all texts by falling count, then code point.

    Tasks send summed counts. At most `most` words are read by the driver: those
    above the lowest step of the counts, an eighth of a doubling, that keeps this.
    """

    def run(batches):
        counts: dict[str, list[int]] = {}
        known: dict[str, str] = {}

        def rows():
            out = pa.RecordBatch.from_arrays(
                [pa.array(counts, pa.string()), pa.array([n for n, _ in counts.values()], pa.int64()),
                 pa.array([m - (1 << 64) if m >> 63 else m for _, m in counts.values()], pa.int64())],
                names=["word", "n", "after"],
            )
            counts.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                before = "."
                for m in _TOKEN.finditer(text.as_py() or ""):
                    token = m[0]
                    word = known.get(token)
                    if word is None:
                        if len(known) >= _KEPT_WORDS:
                            known.clear()
                        word = known[token] = _word(token)
                    if word:
                        bit = 1 << (31 * ord(before[0]) + 7 * ord(before[-1]) + len(before) & 63)
                        seen = counts.get(word)
                        if seen is None:
                            counts[word] = [1, bit]
                        else:
                            seen[0] += 1
                            seen[1] |= bit
                    before = token
                if len(counts) >= _KEPT_WORDS:     # after each text: a batch may hold many words
                    yield rows()
        if counts:
            yield rows()

    counted = docs.select(text_col).mapInArrow(run, "word string, n long, after long")
    counted = counted.groupBy("word").agg(F.sum("n").alias("n"), F.bit_or("after").alias("after"))
    counted = cut(counted.where(F.bit_count("after") >= contexts).select("word", "n"))
    step = F.floor(8 * F.log2("n")).cast("int")
    room, least = most, None
    for row in sorted(counted.groupBy(step.alias("step")).count().collect(), reverse=True):
        room -= row["count"]
        if room < 0:
            break
        least = row["step"]
    if least is None:
        return ()
    found = counted.where(step >= least).collect()
    return tuple(r.word for r in sorted(found, key=lambda r: (-r.n, r.word)))


def segments(value: str, words: Ranks | tuple, per_char: float):
    """(start, end, bits) of the parts that are cheaper than brute force."""
    ranks = words if isinstance(words, Ranks) else Ranks(words)
    rank, longest = ranks.of, ranks.longest
    low, plain = value.lower(), value.lower().translate(_LEET)
    n = len(value)
    if len(low) == len(plain) == n:
        for start in range(n):
            for end in range(start + 3, min(n, start + longest) + 1):
                r = rank.get(plain[start:end])
                if r:
                    part = value[start:end]
                    case = 0 if part.islower() or not any(c.isupper() for c in part) else 1 if part[1:].islower() else 2
                    yield start, end, log2(r + 1) + case + (low[start:end] != plain[start:end])
        start = 0
        for k in range(1, n + 1):
            if k == n or low[k - 1 : k + 1] not in _STEPS:
                if k - start >= 3:
                    yield start, k, log2(2 * len(ROWS) * 10 * (k - start))
                start = k
    for m in _DATE.finditer(value):
        yield m.start(), m.end(), log2(366 * 120) if m.end() - m.start() > 4 else log2(120)
    for m in _REPEAT.finditer(value):
        block = len(m[1])
        yield m.start(), m.end(), block * per_char + log2((m.end() - m.start()) // block)


def guess_bits(value: str, ranks: Ranks = COMMON) -> float:
    """The least number of bits that tell the value, over all segmentations."""
    per_char = log2(sum(size for seen, size in _CLASSES if seen.search(value)) or 1)
    ending: dict[int, list[tuple[int, float]]] = {}
    for start, end, bits in segments(value, ranks, per_char):
        ending.setdefault(end, []).append((start, bits))
    cost = [0.0]
    for at in range(1, len(value) + 1):
        best = cost[-1] + per_char
        for start, bits in ending.get(at, ()):
            best = min(best, cost[start] + bits)
        cost.append(best)
    return cost[-1]


def scan(text: str | None, ranks: Ranks = COMMON, min_bits: float = MIN_BITS):
    """(kind number, start, end, start of the secret itself) of all spans, by
    start, then kind, then end."""
    text = text or ""
    low = text.lower()
    found = [(1, m.start(), m.end(), m.start()) for m in ACCESS.finditer(text)]
    found += [(2, m.start(), m.end(), m.start()) for m in HEX.finditer(text)]
    if ":" in text or "=" in text:
        if any(w in low for w in ASSIGN_WORDS):
            found += [
                (0, m.start(), m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6
            ]
    values = set()
    if (":" in text or "=" in text) and any(w in low for w in CONTEXT_WORDS):
        values |= {m.span(1) for m in CONTEXT.finditer(text)}
    if "bearer" in low:
        values |= {m.span(1) for m in BEARER.finditer(text)}
    found += [
        (3, a, b, a) for a, b in values
        if not REFERENCE.fullmatch(text, a, b) and guess_bits(text[a:b], ranks) >= min_bits
    ]
    return sorted(found, key=lambda f: (f[1], f[0], f[2]))


def _joined(found) -> str:
    return ",".join(f"{KINDS[k]}:{start}:{end}" for k, start, end, _ in found)


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: tuple = (),
    min_bits: float = MIN_BITS,
) -> DataFrame:
    """(id, spans): array of (kind, start, end) of every document. `words` are ranked
    words, as `learn_words` gives them."""
    ranks = Ranks(words)

    def run(batches):
        for batch in batches:
            found = [scan(t.as_py(), ranks, min_bits) for t in batch.column(1)]
            spans = [[{"kind": KINDS[k], "start": s, "end": e} for k, s, e, _ in f] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPANS)], names=[id_col, "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        run, f"{id_col} {kind}, spans array<struct<kind: string, start: long, end: long>>"
    )


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def digests(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: tuple = ()
) -> DataFrame:
    """(id, n_assign, n_access, n_hex, n_guess, base_sha256, spans string)."""
    ranks = Ranks(words)

    def run(batches):
        for batch in batches:
            found = [scan(t.as_py(), ranks) for t in batch.column(1)]
            counts = [pa.array([sum(f[0] == k for f in x) for x in found], pa.int64()) for k in range(4)]
            base = [hashlib.sha256(_joined(f for f in x if f[0] < 3).encode()).hexdigest() for x in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(base, pa.string()), pa.array([_joined(x) for x in found], pa.string())],
                names=[id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        run,
        f"{id_col} {kind}, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string",
    )


def _is_plain(value: str, ranks: Ranks, min_bits: float) -> bool:
    """Whether an assigned value is a word of running text, and none of those that
    are tried first as passwords."""
    value = value.rstrip(".")
    plain = value.isalpha() and value[1:].islower() and value.lower() in ranks.of and value.lower() not in COMMON.of
    return plain and guess_bits(value, ranks) < min_bits


def without_secrets(text: str | None, mark: str, ranks: Ranks = COMMON, min_bits: float = MIN_BITS) -> str | None:
    """The text with every secret replaced; the words before a value stay, and so do
    assigned values that are plain words or name a secret instead of holding it."""
    found = [
        f for f in scan(text, ranks, min_bits)
        if f[0] or not (
            REFERENCE.fullmatch(_VALUE.match(text, f[3])[0]) or _is_plain(text[f[3] : f[2]], ranks, min_bits)
        )
    ]
    if not found:
        return text
    out, at = [], 0
    for start, end in sorted((f[3], f[2]) for f in found):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(
    docs: DataFrame, text_col: str = "text", length_col: str | None = None, mark: str = "[SECRET]", words: tuple = ()
) -> DataFrame:
    """`docs` with secrets replaced by `mark`; `length_col`, if given, is set to
    the new length of changed texts."""
    ranks = Ranks(words)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: without_secrets(t, mark, ranks))

    new = free_name(docs, "_new")
    rows = docs.withColumn(new, clean(text_col))
    same = F.col(new).eqNullSafe(F.col(text_col))
    changed = {text_col: F.col(new)}
    if length_col:
        changed[length_col] = F.when(same, F.col(length_col)).otherwise(F.length(new).cast(docs.schema[length_col].dataType))
    return rows.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns])

"""Words that differ by one letter, found in a trie of letter counts.

The words of the corpus are counted; each is a vector of its letters counted by group,
and the vectors form a trie, one group per level. One inserted letter raises one count
by one (a surplus), a replaced one also lowers one (a deficit), so a depth-first search
that may spend one surplus and one deficit meets every near word; the words of the
leaves it reaches are verified letter by letter. Of a near pair only one side searches:
the shorter word, or the one whose vector comes first, so the surplus is spent before
the deficit and every pair is met once.

The upper levels of the trie are the key that deals the words to tasks: each word lies
in one subtree and asks in all subtrees its budget reaches. As many levels are used as
keep the largest subtree near `subtree_words`; subtrees beyond that even so are cut into
blocks of words and blocks of askers, each pair of blocks in one task, so no task holds
more than a block of either, and no word or pair is left out.

Null and empty texts have no words; a null id counts as an empty string in the rule of
altered words; repeated rows count as often as they stand; an empty table gives an empty
one; columns besides id and text are not looked at. Ties go to the word that comes first
by code points.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from misheard.llm.common import attach, cut
from misheard.operators.joins import lookup_join

# --- fixed values -----------------------------------------------------------
RUN = "[A-Za-zÀ-ÿ]+"
ALTERED = 97               # one occurrence in so many loses a letter
MIN_LETTERS, MIN_COUNT, LEAD = 5, 3, 2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# All letters of a run are below 256; a letter's group is its code modulo GROUPS.
GROUPS = 16
LEVELS = (5, 14, 9, 1, 3, 4, 15, 2, 12, 13, 0, 7, 8, 6, 11, 10)    # groups from frequent to rare
TOP_LEVELS = 4
SUBTREE_WORDS, ASKERS = 20_000, 100_000
_VERIFY_BYTES = 1 << 24
# A subtree's key is the sum of its counts times these, so a step changes it by one of them.
_ODD = np.random.default_rng(42).integers(0, 2**63, GROUPS, np.uint64) * np.uint64(2) + np.uint64(1)


def corpus_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): runs of letters, lower-cased from A-Z alone, of which one occurrence
    in ALTERED, told by a checksum of id and run, loses one letter. Partial counts come
    before the shuffle."""
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0))).alias("run"),
    ).where(F.length("run") >= MIN_LETTERS)
    low = F.when(F.lower("run") == F.col("run"), F.col("run")).otherwise(F.translate("run", _UPPER, _LOWER))
    marked = runs.select("id", low.alias("run")).select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    without = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    word = F.when(F.col("h") % ALTERED == 0, without).otherwise(F.col("run"))
    return (
        marked.select(word.alias("word")).where(F.length("word") >= MIN_LETTERS)
        .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_COUNT)
    )


class Words:
    """Words of a batch as their letters, one byte each, end to end."""

    def __init__(self, column: pa.Array) -> None:
        column = column.cast(pa.large_binary())
        ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        # letters from 0xC0 on are two bytes, of which the first one is 0xC3
        lead = raw == 0xC3
        self.letters = raw.copy()
        self.letters[1:][lead[:-1]] += 0x40
        self.letters = self.letters[~lead]
        self.ends = (ends - ends[0]) - np.concatenate([[0], np.cumsum(lead)])[ends - ends[0]]
        self.size = np.diff(self.ends)

    def vectors(self) -> np.ndarray:
        """Letters counted by group, in the order of the levels."""
        row = np.repeat(np.arange(len(self.size)), self.size)
        counts = np.bincount(row * GROUPS + self.letters % GROUPS, minlength=len(self.size) * GROUPS)
        return counts.reshape(-1, GROUPS)[:, list(LEVELS)]

    def matrix(self, at: np.ndarray) -> np.ndarray:
        """The letters of words of one length, a row each."""
        return self.letters[self.ends[at][:, None] + np.arange(self.size[at[0]])]


def reached(tops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of the subtrees a search from these upper levels reaches: the row's own,
    one with a surplus, or one with a surplus and, further down, a deficit."""
    odd = _ODD[: tops.shape[1]]
    own = tops.astype(np.uint64) @ odd
    every = np.arange(len(tops))
    rows, keys = [every], [own]
    for i in range(len(odd)):
        rows.append(every)
        keys.append(own + odd[i])
        for j in range(i + 1, len(odd)):
            some = np.flatnonzero(tops[:, j])
            rows.append(some)
            keys.append(own[some] + odd[i] - odd[j])
    return np.concatenate(rows), np.concatenate(keys)


def _placed(words: DataFrame, depth: int, search: bool) -> DataFrame:
    """(path, word, n): each word in its subtree, or in all where its search leads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops = Words(batch.column(0)).vectors()[:, :depth]
            if search:
                at, keys = reached(tops)
                batch = batch.take(pa.array(at))
            else:
                keys = tops.astype(np.uint64) @ _ODD[:depth]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *batch.columns], names=["path", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "path long, word string, n long")


def _affordable(extra: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Whether the budget left pays for the rest of a vector, level by level."""
    if not extra.shape[1]:
        return np.ones(len(extra), bool)
    ups, downs = extra == 1, extra == -1
    up, down = ups.sum(axis=1), downs.sum(axis=1)
    after = ups.argmax(axis=1) < downs.argmax(axis=1)
    paid = (up <= (state == 0)) & (down <= np.where(state == 0, up, state == 1))
    return paid & ((up + down < 2) | after) & (np.abs(extra) <= 1).all(axis=1)


def _search(found: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (asker, word) that meet in a leaf. `found` are the vectors of the
    trie's words in sorted order, so a node is a range of them. The state of a search is
    0 at first, 1 after the surplus, 2 after the deficit."""
    askers, words = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

    def visit(lo: int, hi: int, level: int, who: np.ndarray, state: np.ndarray) -> None:
        if (found[lo] == found[hi - 1]).all():           # a single leaf below
            who = who[_affordable(found[lo, level:] - asked[who, level:], state)]
            askers.append(np.repeat(who, hi - lo))
            words.append(np.tile(np.arange(lo, hi), len(who)))
            return
        column, want = found[lo:hi, level], asked[who, level]
        edges = [0, *(np.flatnonzero(np.diff(column)) + 1).tolist(), hi - lo]
        for a, b in zip(edges, edges[1:]):
            extra = column[a] - want
            go = (extra == 0) | (extra == 1) & (state == 0) | (extra == -1) & (state == 1)
            if go.any():
                visit(lo + a, lo + b, level + 1, who[go], state[go] + (extra[go] != 0))

    if len(found) and len(asked):
        visit(0, len(found), 0, np.arange(len(asked)), np.zeros(len(asked), np.int64))
    return np.concatenate(askers), np.concatenate(words)


def one_edit(shorter: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """Row by row, whether two words differ by exactly one letter; `longer` has as many
    columns as `shorter`, or one more."""
    n = shorter.shape[1]
    if longer.shape[1] == n:
        return (shorter != longer).sum(axis=1) == 1
    head = np.logical_and.accumulate(shorter == longer[:, :n], axis=1).sum(axis=1)
    tail = np.logical_and.accumulate((shorter == longer[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= n


def _verified(asking: Words, held: Words, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which index pairs are words one letter apart."""
    size_a, size_b = asking.size[a], held.size[b]
    near = np.zeros(len(a), bool)
    kind = 2 * size_a + (size_b - size_a)                # a word found is as long, or one longer
    for k in np.flatnonzero(np.bincount(kind)).tolist():
        size, rows = k // 2, np.flatnonzero(kind == k)
        step = max(1, _VERIFY_BYTES // (size + 1))
        for start in range(0, len(rows), step):
            part = rows[start : start + step]
            near[part] = one_edit(asking.matrix(a[part]), held.matrix(b[part]))
    return near


def _meet(left: pa.Table, right: pa.Table) -> pa.Table:
    """Near pairs of the words of one block of a subtree and one block of askers."""
    left, right = left.combine_chunks(), right.combine_chunks()
    held, asking = (Words(t["word"].combine_chunks()) for t in (left, right))
    found, asked = held.vectors(), asking.vectors()
    order = np.lexsort(found.T[::-1])
    a, b = _search(found[order], asked)
    b = order[b]
    near = _verified(asking, held, a, b)
    a, b = a[near], b[near]
    out = pa.table({
        "a": right["word"].take(pa.array(a)), "n_a": right["n"].take(pa.array(a)),
        "b": left["word"].take(pa.array(b)), "n_b": left["n"].take(pa.array(b)),
    })
    # of two words with one vector both ask: the first one counts
    return out.filter(pc.or_(pa.array((asked[a] != found[b]).any(axis=1)), pc.less(out["a"], out["b"])))


def near_pairs(
    words: DataFrame, top_levels: int = TOP_LEVELS, subtree_words: int = SUBTREE_WORDS, askers: int = ASKERS
) -> DataFrame:
    """(a, n_a, b, n_b): every pair of `words` (word, n; distinct) one letter apart, once."""
    depth = top_levels
    while True:
        placed = _placed(words, depth, False)
        sizes = cut(placed.groupBy("path").agg(F.count(F.lit(1)).alias("words")))
        if depth >= GROUPS or (sizes.agg(F.max("words")).first()[0] or 0) <= subtree_words:
            break
        depth = min(GROUPS, depth + 2)
    search = _placed(words, depth, True)
    asking = search.groupBy("path").agg(F.count(F.lit(1)).alias("askers"))
    blocks = lambda n, size: F.ceil(F.col(n) / F.lit(float(size))).cast("int")
    sizes = cut(sizes.join(asking, "path").select(
        "path", "words", "askers", blocks("words", subtree_words).alias("w"), blocks("askers", askers).alias("q")
    ))

    def dealt(rows: DataFrame, count: str, own: str, other: str, seed: int) -> DataFrame:
        """Rows in a block of their own kind, copied for each block of the other."""
        met = attach(rows, sizes.select("path", count, "w", "q"), ["path"], count, ["word"])
        block = F.pmod(F.xxhash64("word", F.lit(seed)), F.col(own)).cast("int")
        copies = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        return met.select("path", "word", "n", block.alias(own), copies.alias(other)).select("path", "w", "q", "word", "n")

    def named(rows: DataFrame, count: str, own: str, other: str, seed: int) -> DataFrame:
        return dealt(rows, count, own, other, seed).groupBy("path", "w", "q")

    held, asks = named(placed, "words", "w", "q", 1), named(search, "askers", "q", "w", 2)
    return held.cogroup(asks).applyInArrow(_meet, "a string, n_a long, b string, n_b long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words (word, form) whose form is not null: the last form reached.
    Each round doubles the steps taken; forms have ever larger counts, so it ends."""
    last = cut(forms.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        further = last.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = lookup_join(last, further, ["root"], "left", ["word"])
        done = cut(step.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
        last = done.select("word", "root")
        if done.where("moved").isEmpty():
            return last


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **sizes: int) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the corpus."""
    words = cut(corpus_words(docs, id_col, text_col))
    pairs = cut(near_pairs(words, **sizes))
    both = pairs.select(F.col("a").alias("word"), "b", "n_b").unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("b"), F.col("n_a").alias("n_b"))
    )
    first: Column = F.min(F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("word")))
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), first.alias("first"))
    top = -F.col("first.less")
    has = F.col("first").isNotNull() & (top >= LEAD * F.col("n"))
    rows = cut(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has, F.col("first.word")).alias("form"), F.when(has, top).alias("form_n"),
    ))
    rooted = rows.join(roots(rows.select("word", "form")), "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

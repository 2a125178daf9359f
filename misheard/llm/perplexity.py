"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model.

The model is trained per language on the trusted documents, over symbols of
folded text (lower case, digits alike, white space alike; a code point beyond 16
bits is one symbol). Four symbols are packed into one 64-bit key, so counting,
continuation counts, discounts, and back-off weights are groupings and joins of
long keys, sharded by Spark.

Documents are dealt to blocks of bounded text by a hash of the row. The distinct
n-grams of a block are joined to the probabilities, which are worked out once per
distinct n-gram of the corpus, and each block is scored against its own n-grams.
A document is rejected if its perplexity exceeds `slack` times the `quantile` of
the trusted documents of its language. Text of repeated words is as easy to predict
as good text is, so its perplexity cannot tell it: a document is also rejected if its
own n-grams are too even, their entropy as a share of the largest one for its length
being less than `even_slack` times the low quantile of the trusted documents. That
share needs no model, so it is the same for documents in and out of the training.

Texts that are null or empty have no perplexity, nor have languages without
trusted text (a null language is one of its own); they are kept. Equal rows get
equal results. All documents that are labelled good are trusted; every count covers
all documents.
"""

import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from misheard.llm.common import attach, cut, free_name, parts_for
from misheard.operators.joins import is_small, lookup_join, spread_join

ORDER = 4
QUANTILE = 0.99
SLACK = 2.5
EVEN_SLACK = 0.9
BLOCK_CHARS = 16 << 20
# Rows of three short columns that are broadcast at most; more are shuffled.
BROADCAST_GRAMS = 500_000
# No discount is less, whatever the counts of counts say.
LEAST_DISCOUNT = 1e-3
# Logarithms of perplexity are counted in bins of this width for quantiles.
BIN = 0.001
_SLICE = 1 << 20


@lru_cache(maxsize=1)
def _folding() -> np.ndarray:
    """Symbol of every code point below 2^16; 0 is kept for the start."""
    table = np.arange(1 << 16, dtype=np.uint16)
    for i in range(1 << 16):
        c = chr(i)
        low = c.lower()
        if c.isspace():
            table[i] = ord(" ")
        elif unicodedata.category(c) == "Nd":
            table[i] = ord("0")
        elif len(low) == 1 and ord(low) < 1 << 16:
            table[i] = ord(low)
    table[0] = 0xFFFE
    return table


def ngrams(text: str, order: int = ORDER):
    """Packed n-grams of a text, one per symbol, in slices."""
    folding = _folding()
    before = np.zeros(order - 1, np.uint16)
    for k in range(0, len(text), _SLICE):
        points = np.frombuffer(text[k : k + _SLICE].encode("utf-32-le", "surrogatepass"), "<u4")
        symbols = np.concatenate([before, folding[np.minimum(points, 0xFFFF)]])
        wide = symbols.astype(np.int64)
        n = len(points)
        packed = wide[:n].copy()
        for j in range(1, order):
            packed <<= 16
            packed |= wide[j : j + n]
        yield packed
        before = symbols[len(symbols) - order + 1 :]


def _row_key(id_col: str, text_col: str, lang_col: str) -> Column:
    return F.xxhash64(id_col, text_col, lang_col)


class _Counter:
    """Distinct values and how often each occurs, in no order. Values are held
    as they come up to a slice's worth, then as counts."""

    def __init__(self):
        self.raw, self.held, self.parts = [], 0, []

    def add(self, values: np.ndarray) -> None:
        self.raw.append(values)
        self.held += len(values)
        if self.held >= _SLICE:
            self._fold()

    def _fold(self) -> None:
        if self.raw:
            codes, values = pd.factorize(np.concatenate(self.raw))
            self.parts.append((values, np.bincount(codes, minlength=len(values))))
            self.raw, self.held = [], 0
        if len(self.parts) > 1:
            codes, values = pd.factorize(np.concatenate([v for v, _ in self.parts]))
            counts = np.bincount(codes, np.concatenate([c for _, c in self.parts]), len(values))
            self.parts = [(values, counts.astype(np.int64))]

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        self._fold()
        return self.parts[0] if self.parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def own_share(counts: np.ndarray) -> float:
    """Entropy of the n-grams of a text as a share of that of distinct ones; one
    for texts of less than two symbols."""
    n = counts.sum()
    return float(1 - (counts * np.log(counts)).sum() / (n * np.log(n))) if n > 1 else 1.0


def gram_counts(rows: DataFrame, order: int) -> DataFrame:
    """(lang, gram, c) from (lang, text, trusted): all n-grams of all documents
    with their number in trusted ones."""

    def run(batches):
        for batch in batches:
            langs, texts, trusted = (batch.column(k).to_pylist() for k in range(3))
            by: dict[tuple, _Counter] = {}
            for k, text in enumerate(texts):
                counter = by.setdefault((langs[k], trusted[k]), _Counter())
                for g in ngrams(text or "", order):
                    counter.add(g)
            for (lang, good), counter in by.items():
                values, counts = counter.counts()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(values), pa.string()), pa.array(values),
                     pa.array(counts if good else np.zeros(len(values), np.int64))],
                    names=["lang", "gram", "c"],
                )

    made = rows.mapInArrow(run, "lang string, gram long, c long")
    return made.groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def _suffix(gram: Column, symbols: int) -> Column:
    return gram if symbols == 4 else gram.bitwiseAND(F.lit((1 << (16 * symbols)) - 1))


def _per_lang(rows: DataFrame, table: DataFrame, how: str, salt_by: list[str]) -> DataFrame:
    """Join to a table with one row per language. A language may hold most rows, so they
    stay where they are as long as the counted languages are few, and are spread if not."""
    return lookup_join(rows, cut(table), ["lang"], how, salt_by)


def levels(counts: DataFrame, order: int) -> list[tuple[DataFrame, DataFrame]]:
    """From the highest order down: (lang, gram, part) with the discounted share
    of a seen n-gram, and (lang, context, back) with the weight of what is left.

    The highest order counts occurrences, the others distinct symbols before."""
    found, level = [], counts
    for k in range(order, 0, -1):
        of = [F.count(F.when(F.col("c") == r, 1)).alias(f"n{r}") for r in (1, 2, 3, 4)]
        y = F.try_divide("n1", F.col("n1") + 2 * F.col("n2"))

        def discount(r):
            raw = F.lit(r) - (r + 1) * y * F.try_divide(f"n{r + 1}", f"n{r}")
            # above zero, so that every context leaves some weight to unseen symbols
            bounded = F.greatest(F.lit(LEAST_DISCOUNT), F.least(F.lit(float(r)), raw))
            # too little text to tell: half a count per step
            return F.when(raw.isNull(), F.lit(r / 2)).otherwise(bounded).alias(f"d{r}")

        per_lang = level.groupBy("lang").agg(*of).select("lang", *[discount(r) for r in (1, 2, 3)])
        spent = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        cuts = _per_lang(level, per_lang, "inner", ["gram"]).select(
            "lang", "gram", "c", F.shiftrightunsigned("gram", 16).alias("context"), spent.alias("spent")
        )
        contexts = cuts.groupBy("lang", "context").agg(F.sum("c").alias("total"), F.sum("spent").alias("left"))
        parts = cuts.join(contexts, ["lang", "context"]).select(
            "lang", "gram", ((F.col("c") - F.col("spent")) / F.col("total")).alias("part")
        )
        found.append((cut(parts), cut(contexts.select("lang", "context", (F.col("left") / F.col("total")).alias("back")))))
        if k > 1:
            level = level.groupBy("lang", _suffix(F.col("gram"), k - 1).alias("gram")).agg(F.count(F.lit(1)).alias("c"))
            level = cut(level)
    return found


def log_probabilities(grams: DataFrame, counts: DataFrame, order: int) -> DataFrame:
    """(lang, gram, logp) of the distinct n-grams given, null where the language
    has no model."""
    made = levels(counts, order)
    symbols = made[-1][0].groupBy("lang").agg((F.lit(1.0) / (F.count(F.lit(1)) + 1)).alias("p"))
    out = _per_lang(grams.select("lang", "gram"), symbols, "left", ["gram"])
    for k, (parts, backs) in zip(range(1, order + 1), reversed(made)):
        out = (
            out.withColumn("_g", _suffix(F.col("gram"), k)).withColumn("_c", F.shiftrightunsigned("_g", 16))
            .join(parts.withColumnRenamed("gram", "_g"), ["lang", "_g"], "left")
            .join(backs.withColumnRenamed("context", "_c"), ["lang", "_c"], "left")
            .select("lang", "gram", (F.coalesce("part", F.lit(0.0)) + F.coalesce("back", F.lit(1.0)) * F.col("p")).alias("p"))
        )
    return out.select("lang", "gram", F.log("p").alias("logp"))


def block_scores(rows: DataFrame, scored: DataFrame, blocks: int, order: int) -> DataFrame:
    """(id, key, lang, trusted, symbols, logp, own) of every row of (key, lang, trusted,
    text, id)."""
    # both uses below read the same shuffle of the texts
    dealt = rows.withColumn("block", F.pmod("key", F.lit(blocks)).cast("int")).repartition(blocks, "block")

    def distinct(batches):
        held: dict[tuple, list] = {}
        for batch in batches:
            langs, texts, block = (batch.column(k).to_pylist() for k in (1, 3, 5))
            for k, text in enumerate(texts):
                parts = held.setdefault((block[k], langs[k]), [])
                parts += map(pd.unique, ngrams(text or "", order))
                if len(parts) > 256:
                    parts[:] = [pd.unique(np.concatenate(parts))]
        for (b, lang), parts in held.items():
            if parts:
                grams = pd.unique(np.concatenate(parts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(grams), b, np.int32)), pa.array([lang] * len(grams), pa.string()), pa.array(grams)],
                    names=["block", "lang", "gram"],
                )

    wanted = dealt.mapInArrow(distinct, "block int, lang string, gram long")
    met = attach(wanted, scored, ["lang", "gram"], "n", ["block"], max_rows=BROADCAST_GRAMS).select("block", "lang", "gram", "logp")

    def score(texts: pa.Table, grams: pa.Table) -> pa.Table:
        langs_of = np.asarray(grams.column("lang").to_pylist(), object)
        gram, logp = np.asarray(grams.column("gram")), np.asarray(grams.column("logp"), np.float64)
        index = {}
        for lang in set(langs_of):
            of = langs_of == lang
            index[lang] = (pd.Index(gram[of]), logp[of])
        symbols, sums, own = [], [], []
        for lang, text in zip(texts.column("lang").to_pylist(), texts.column("text")):
            n, total, counter = 0, 0.0, _Counter()
            for g in ngrams(text.as_py() or "", order):
                grams_of, values = index[lang]
                total += float(values[grams_of.get_indexer(g)].sum())
                n += len(g)
                counter.add(g)
            own.append(own_share(counter.counts()[1]))
            symbols.append(n)
            sums.append(total)
        return pa.table({
            "id": texts.column("id"), "key": texts.column("key"), "lang": texts.column("lang"), "trusted": texts.column("trusted"),
            "symbols": pa.array(symbols, pa.int64()), "logp": pa.array(sums, pa.float64()), "own": pa.array(own, pa.float64()),
        })

    return dealt.groupBy("block").cogroup(met.groupBy("block")).applyInArrow(
        score, f"id {rows.schema['id'].dataType.simpleString()}, key long, lang string, trusted boolean, symbols long, logp double, own double"
    )


def limits(scores: DataFrame, quantile: float, slack: float) -> DataFrame:
    """(lang, limit): the largest log perplexity that is kept."""
    bins = scores.where("trusted and nats is not null").groupBy("lang", F.floor(F.col("nats") / BIN).alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )
    along = Window.partitionBy("lang").orderBy("bin")
    whole = Window.partitionBy("lang")
    reached = F.sum("n").over(along) >= F.lit(quantile) * F.sum("n").over(whole)
    return (
        bins.withColumn("at", F.when(reached, F.col("bin"))).groupBy("lang")
        .agg(((F.min("at") + 1) * BIN + F.log(F.lit(slack))).alias("limit"))
    )


def least_shares(scores: DataFrame, quantile: float, even_slack: float) -> DataFrame:
    """(lang, least): the smallest entropy share of own n-grams that is kept."""
    bins = scores.where("trusted and nats is not null").groupBy("lang", F.floor(F.col("own") / BIN).alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )
    along = Window.partitionBy("lang").orderBy("bin")
    reached = F.sum("n").over(along) >= F.lit(1 - quantile) * F.sum("n").over(Window.partitionBy("lang"))
    return (
        bins.withColumn("at", F.when(reached, F.col("bin"))).groupBy("lang")
        .agg((F.min("at") * BIN * even_slack).alias("least"))
    )


def trusted_ids(labels: DataFrame, id_col: str) -> DataFrame:
    """The ids of all documents that are labelled good."""
    return labels.where(F.col("quality") == 1).select(id_col).where(F.col(id_col).isNotNull()).distinct()


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    order: int = ORDER, quantile: float = QUANTILE, slack: float = SLACK,
    even_slack: float = EVEN_SLACK,
) -> DataFrame:
    """(id, key, lang, perplexity, limit, kept) of every row; key is `_row_key`,
    lang empty for null."""
    ids = cut(trusted_ids(labels, id_col).withColumn("_good", F.lit(True)))
    rows = docs.select(
        id_col, _row_key(id_col, text_col, lang_col).alias("key"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.col(text_col).alias("text"),
    )
    # broadcast where the ids are few, else shuffled; an id that most rows repeat is spread
    rows = lookup_join(rows, ids, [id_col], "left", ["key"]).select(
        "key", "lang", F.coalesce("_good", F.lit(False)).alias("trusted"), "text", F.col(id_col).alias("id")
    )
    grams = cut(gram_counts(rows.select("lang", "text", "trusted"), order))
    counts = grams.where("c > 0")
    blocks = parts_for(docs, F.length(text_col), BLOCK_CHARS)
    scored = cut(log_probabilities(grams, counts, order).withColumn("n", F.lit(blocks).cast("long")))
    scores = block_scores(rows, scored, blocks, order)
    modelled = counts.select("lang").distinct().withColumn("modelled", F.lit(True))
    scores = _per_lang(scores, modelled, "left", ["key"])
    nats = F.when((F.col("symbols") > 0) & F.col("modelled"), -F.col("logp") / F.col("symbols"))
    scores = cut(scores.select("id", "key", "lang", "trusted", nats.alias("nats"), "own"))
    bounds = limits(scores, quantile, slack).join(least_shares(scores, quantile, even_slack), "lang")
    return _per_lang(scores, bounds, "left", ["key"]).select(
        F.col("id").alias(id_col), "key", "lang", F.exp("nats").alias("perplexity"), F.exp("limit").alias("limit"),
        F.coalesce((F.col("nats") <= F.col("limit")) & (F.col("own") >= F.col("least")), F.lit(True)).alias("kept"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              lang_col: str = "lang", **options) -> DataFrame:
    """`docs` without the rejected rows."""
    key = free_name(docs, "_key")
    rejected = cut(
        classify(docs, labels, id_col, text_col, lang_col, **options).where("not kept")
        .groupBy(F.col("key").alias(key)).agg(F.count(F.lit(1)).alias("_n"))
    )
    named = docs.withColumn(key, _row_key(id_col, text_col, lang_col))
    if is_small(rejected):
        kept = named.join(F.broadcast(rejected), key, "left_anti")
    else:
        kept = spread_join(named, rejected, [key], "left_anti", [id_col], left_rows="_n")
    return kept.drop(key)

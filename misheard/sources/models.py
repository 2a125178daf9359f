"""Learned tables: confusions, subword models, language models. Parquet holds them
for Spark, JSON exchanges them with other programs."""

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from misheard.constants import BPE_SPECIALS, UNK, WORD_END
from misheard.operators.bpe import BpeModel
from misheard.operators.lm import arpa_lines
from misheard.sources.text import write_lines

CONFUSIONS = "chunk string, replacement string, cnt long"
VOCAB = "token string, id int"
MERGES = "rank int, left string, right string"
LM = "order int, ngram string, prob double, backoff double, logp double, log_backoff double"


def save_confusions(table: DataFrame, path: str) -> None:
    table.select("chunk", "replacement", "cnt").write.mode("overwrite").parquet(path)


def load_confusions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CONFUSIONS).parquet(path)


def save_confusions_json(table: DataFrame, path: str) -> None:
    """JSON lines, one per chunk and page of 4,096 replacements: {"chunk": ..., "counts":
    [[replacement, count], ...]}. Parts are written by their own tasks, and a chunk
    of very many replacements is spread over pages."""
    page = F.pmod(F.xxhash64("replacement"), F.greatest(F.ceil(F.col("n") / 4096), F.lit(1)))
    sizes = table.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))
    paged = table.join(sizes, "chunk").select("chunk", "replacement", "cnt", page.alias("page"))
    entry = F.struct("replacement", "cnt")
    rows = paged.groupBy("chunk", "page").agg(F.array_sort(F.collect_list(entry)).alias("counts"))
    rows.select("chunk", "counts").write.mode("overwrite").json(path)


def load_confusions_json(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("chunk string, counts array<struct<replacement: string, cnt: long>>").json(path)
    return rows.select("chunk", F.inline("counts"))


def save_bpe(model: BpeModel, path: str) -> None:
    model.vocab.write.mode("overwrite").parquet(f"{path}/vocab")
    model.merges.write.mode("overwrite").parquet(f"{path}/merges")


def load_bpe(spark: SparkSession, path: str, suffix: str = WORD_END) -> BpeModel:
    return BpeModel(
        spark.read.schema(VOCAB).parquet(f"{path}/vocab"), spark.read.schema(MERGES).parquet(f"{path}/merges"), suffix
    )


# Tokens of a model that is written as one JSON document; a larger one stays Parquet.
MAX_JSON_TOKENS = 1_000_000


def save_bpe_json(model: BpeModel, path: str) -> None:
    """One JSON document in the format of the tokenizers library, in the only part file
    of the folder `path`. Raises if the model has more than MAX_JSON_TOKENS tokens."""
    spark = model.vocab.sparkSession
    tokens = model.vocab.count()
    if tokens > MAX_JSON_TOKENS:
        raise ValueError(f"{tokens} tokens are too many for one JSON document")
    vocab = model.vocab.select("token", "id").collect()        # bounded by the check above
    merges = model.merges.orderBy("rank").collect()             # fewer than tokens
    special = [
        {"id": r.id, "content": r.token, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False,
         "special": True}
        for r in sorted(vocab, key=lambda r: r.id) if r.token in BPE_SPECIALS
    ]
    parts = {"type": "BPE", "dropout": None, "unk_token": UNK, "continuing_subword_prefix": None,
             "end_of_word_suffix": model.suffix, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
    parts |= {"vocab": {r.token: r.id for r in vocab}, "merges": [[r.left, r.right] for r in merges]}
    document = {"version": "1.0", "truncation": None, "padding": None, "added_tokens": special, "normalizer": None,
                "pre_tokenizer": {"type": "Whitespace"}, "post_processor": None, "decoder": None, "model": parts}
    text = spark.createDataFrame([(json.dumps(document, ensure_ascii=False),)], "value string")
    text.coalesce(1).write.mode("overwrite").text(path)


def load_bpe_json(spark: SparkSession, path: str) -> BpeModel:
    """The model of such a document, also of one whose merges are strings "left right"."""
    text = spark.read.text(path, wholetext=True)
    inner = F.from_json("value", "model struct<end_of_word_suffix: string, vocab: map<string, int>, merges: array<string>>")
    model = text.select(inner["model"].alias("m"))
    vocab = model.select(F.explode("m.vocab").alias("token", "id"))
    pair = F.when(F.col("merge").startswith("["), F.from_json("merge", "array<string>")).otherwise(F.split("merge", " "))
    merges = model.select(F.posexplode("m.merges").alias("rank", "merge")).select("rank", pair.alias("p"))
    suffix = model.select("m.end_of_word_suffix").first()[0]
    return BpeModel(vocab, merges.select("rank", F.col("p")[0].alias("left"), F.col("p")[1].alias("right")), suffix or "")


def save_lm(model: DataFrame, path: str) -> None:
    model.write.mode("overwrite").parquet(path)


def load_lm(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LM).parquet(path)


def write_arpa(model: DataFrame, path: str, single_file: bool = False) -> None:
    """ARPA text, sorted; part files in name order form one file."""
    write_lines(arpa_lines(model), path, "value", ["section", "ngram"], single_file)

"""Greedy decoding of frame scores: best symbol per frame, repeats collapsed,
blanks dropped."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from misheard import constants as K

FRAMES_PER_BLOCK = 4096


def keep_symbol_scores(frame: Column) -> Column:
    """The blank's score and those of the alphabet, out of a whole frame."""
    return F.concat(
        F.slice(frame, K.LOGIT_BLANK_COLUMN + 1, 1),
        F.slice(frame, K.LOGIT_FIRST_SYMBOL_COLUMN + 1, len(K.ALPHABET)),
    )


def best_symbol(scores: Column) -> Column:
    """Index of the highest score, the first on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def greedy_decode(
    frames: DataFrame,
    path: str = "path",
    frame_no: str = "frame_no",
    scores: str = "scores",
    alphabet: str = K.ALPHABET,
    block: int = FRAMES_PER_BLOCK,
) -> DataFrame:
    """(path, predicted). A clip may hold any share of all frames: repeats are
    collapsed and joined per block of frames, blocks are joined per clip."""
    ids = frames.select(
        path,
        frame_no,
        best_symbol(F.col(scores)).alias("id"),
        F.floor(F.col(frame_no) / F.lit(float(block))).cast("long").alias("_block"),
    )
    within = Window.partitionBy(path, "_block").orderBy(frame_no)
    marked = ids.withColumn("_prev", F.lag("id").over(within))
    symbol = F.substr(F.lit(alphabet), F.col("id"), F.lit(1))
    keep = (F.col("id") != K.CTC_BLANK) & (F.col("_prev").isNull() | (F.col("_prev") != F.col("id")))
    blocks = marked.groupBy(path, "_block").agg(
        F.min_by("id", frame_no).alias("_first"),
        F.max_by("id", frame_no).alias("_last"),
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.when(keep, F.struct(F.col(frame_no), symbol.alias("s"))))),
                lambda x: x["s"],
            ),
            "",
        ).alias("_text"),
    )
    # the first symbol of a block is a repeat if the block before ended with it
    before = F.lag("_last").over(Window.partitionBy(path).orderBy("_block"))
    repeated = (F.col("_first") == before) & (F.col("_first") != K.CTC_BLANK)
    joined = blocks.withColumn(
        "_text", F.when(repeated, F.substr("_text", F.lit(2))).otherwise(F.col("_text"))
    )
    return joined.groupBy(path).agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("_block", "_text"))), lambda x: x["_text"]), ""
        ).alias("predicted")
    )

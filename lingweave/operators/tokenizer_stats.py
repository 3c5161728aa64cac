"""Word frequencies and tokenizer statistics, and BPE training on a word table."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: Buckets of word counts, in report order.
BUCKETS = ("freq_1", "freq_2_5", "freq_6_50", "freq_gt_50")
BUCKET_BOUNDS = (1, 5, 50)
LONG_WORD = 12

Encoder = Callable[[Column], Column]


def length_encoder(unknown: str | None = None) -> Encoder:
    """A deterministic stand-in for a subword encoder: one id per word, 4 plus its length modulo 20; words equal to ``unknown`` are unknown."""

    def encode(c: Column) -> Column:
        one = lambda w: (F.when(w == unknown, 1).otherwise(4 + F.length(w) % 20) if unknown else 4 + F.length(w) % 20).cast("int")
        return F.transform(F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0)), one)

    return encode


def sentencepiece_encoder(model_path: str) -> Encoder:
    """Encodes with a SentencePiece model, loaded once in each Python worker."""
    loaded: dict = {}

    @F.pandas_udf("array<int>")
    def encode(texts: pd.Series) -> pd.Series:
        if model_path not in loaded:
            import sentencepiece

            loaded[model_path] = sentencepiece.SentencePieceProcessor(model_file=model_path)
        return pd.Series(loaded[model_path].encode(texts.fillna("").tolist(), num_threads=1))

    return lambda c: encode(c)


def sentencepiece_detokeniser(model_path: str) -> Callable[[Column], Column]:
    """Texts of ids by a SentencePiece model, loaded once in each Python worker."""
    loaded: dict = {}

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        if model_path not in loaded:
            import sentencepiece

            loaded[model_path] = sentencepiece.SentencePieceProcessor(model_file=model_path)
        return pd.Series([loaded[model_path].decode([int(i) for i in row]) for row in ids], dtype=object)

    return lambda c: decode(c)


def sides(pairs: DataFrame) -> DataFrame:
    """Both texts of each pair as rows: the pair's columns, ``side`` (0 source, 1 target) and ``sentence``."""
    return pairs.select("*", F.inline(F.array(F.struct(F.lit(0).alias("side"), F.col("pl").alias("sentence")), F.struct(F.lit(1).alias("side"), F.col("en").alias("sentence")))))


def word_frequencies(pairs: DataFrame) -> DataFrame:
    """``word, cnt, first_row, first_side, first_place``: lower-cased words of both sides, and where each is met first (source before target)."""
    placed = sides(pairs.select("row_index", "pl", "en")).select("row_index", "side", F.posexplode(X.words(F.col("sentence"))).alias("place", "word"))
    grouped = placed.groupBy("word").agg(F.count("*").alias("cnt"), F.min(F.struct("row_index", "side", "place")).alias("f"))
    return grouped.select("word", "cnt", F.col("f.row_index").alias("first_row"), F.col("f.side").alias("first_side"), F.col("f.place").alias("first_place"))


def rank95(n: Column) -> Column:
    """The place (from 1) of the 95th percentile among ``n`` sorted values."""
    return F.least(n, F.floor(n * F.lit(0.95).cast("double")) + 1)


def percentile95(values: DataFrame, group: list[str], value: str) -> DataFrame:
    """The discrete 95th percentile of ``value`` in each group, from counts of distinct values: no group is ever held in full."""
    counted = values.groupBy(*group, value).agg(F.count("*").alias("_n"))
    order = Window.partitionBy(*group).orderBy(value)
    running = counted.select(*group, value, F.sum("_n").over(order).alias("_upto"), F.sum("_n").over(Window.partitionBy(*group)).alias("_all"))
    return running.where(F.col("_upto") >= rank95(F.col("_all"))).groupBy(*group).agg(F.min(value).alias("p95"))


def split_stats(pairs: DataFrame, encode: Encoder, unk: int = 1) -> DataFrame:
    """One row per split: ``rows, words, pieces, unk, mean_pieces, p95_pieces, pieces_per_word, unk_rate``; quotients of nothing are 0."""
    sized = sides(pairs.select("split", "pl", "en")).select("split", X.word_count(F.col("sentence")).alias("words"), encode(F.col("sentence")).alias("ids"))
    sized = sized.select("split", "words", F.size("ids").alias("n"), F.size(F.filter("ids", lambda x: x == unk)).alias("unk"))
    sums = sized.groupBy("split").agg((F.count("*") / 2).cast("long").alias("rows"), F.sum("words").alias("words"), F.sum("n").alias("pieces"), F.sum("unk").alias("unk"), F.avg("n").alias("mean"))
    share = lambda a, b: F.when(F.col(b) == 0, 0.0).otherwise(F.col(a) / F.col(b))
    joined = sums.join(percentile95(sized, ["split"], "n"), "split")
    return joined.select("split", "rows", "words", "pieces", "unk", F.col("mean").alias("mean_pieces"), F.col("p95").cast("long").alias("p95_pieces"), share("pieces", "words").alias("pieces_per_word"), share("unk", "pieces").alias("unk_rate"))


def bucket(cnt: Column) -> Column:
    out = F.lit(BUCKETS[-1])
    for name, bound in reversed([*zip(BUCKETS, BUCKET_BOUNDS, strict=False)]):
        out = F.when(cnt <= bound, name).otherwise(out)
    return out


def long_word_stats(frequencies: DataFrame, encode: Encoder, min_length: int = LONG_WORD) -> DataFrame:
    """``bucket, types, mean_pieces, p95_pieces`` of long words by frequency; all buckets are listed."""
    spark = frequencies.sparkSession
    sized = frequencies.where(F.length("word") >= min_length).select(bucket(F.col("cnt")).alias("bucket"), F.size(encode(F.col("word"))).alias("n"))
    found = sized.groupBy("bucket").agg(F.count("*").alias("types"), F.avg("n").alias("mean")).join(percentile95(sized, ["bucket"], "n"), "bucket")
    names = spark.range(1).select(F.explode(F.array(*map(F.lit, BUCKETS))).alias("bucket"))
    return names.join(found, "bucket", "left").select("bucket", F.coalesce("types", F.lit(0)).alias("types"), F.coalesce("mean", F.lit(0.0)).alias("mean_pieces"), F.coalesce("p95", F.lit(0)).cast("long").alias("p95_pieces"))


def top_long_words(frequencies: DataFrame, encode: Encoder, min_length: int = LONG_WORD, limit: int = 30) -> DataFrame:
    """The most frequent long words, ties by first encounter: ``rank, word, cnt, pieces``."""
    top = frequencies.where(F.length("word") >= min_length).orderBy(F.desc("cnt"), "first_row", "first_side", "first_place").limit(limit)
    order = Window.orderBy(F.desc("cnt"), "first_row", "first_side", "first_place")
    return top.select(F.row_number().over(order).alias("rank"), "word", "cnt", F.size(encode(F.col("word"))).alias("pieces"))


def symbols(frequencies: DataFrame) -> DataFrame:
    """Words as arrays of characters, the first of them marked as the start of a word: ``symbols, cnt``."""
    chars = F.regexp_extract_all("word", F.lit(r"(?s)."), F.lit(0))
    return frequencies.select(F.transform(chars, lambda c, i: F.when(i == 0, F.concat(F.lit("▁"), c)).otherwise(c)).alias("symbols"), "cnt")


def pair_counts(table: DataFrame) -> DataFrame:
    """How often two symbols stand side by side: ``left, right, n``."""
    pairs = F.transform(F.sequence(F.lit(1), F.size("symbols") - 1), lambda i: F.struct(F.element_at("symbols", i).alias("left"), F.element_at("symbols", i + 1).alias("right")))
    return table.where(F.size("symbols") > 1).select("cnt", F.inline(pairs)).groupBy("left", "right").agg(F.sum("cnt").alias("n"))


def merge(table: DataFrame, left: str, right: str) -> DataFrame:
    """The table with each occurrence of a pair merged, from the left."""
    step = lambda done, s: F.when((F.size(done) > 0) & (F.element_at(done, -1) == left) & (s == right), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.lit(left + right)))).otherwise(F.concat(done, F.array(s)))
    return table.select(F.aggregate("symbols", F.array().cast("array<string>"), step).alias("symbols"), "cnt")


def train_bpe(frequencies: DataFrame, merges: int) -> list[tuple[str, str]]:
    """The first ``merges`` merges, each the most frequent pair (ties: the least by text).  Only the best pair of each round reaches the driver."""
    spark = frequencies.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        raise ValueError("set spark.checkpoint.dir: the word table is checkpointed every few rounds")
    table, found = symbols(frequencies).checkpoint(), []
    for n in range(merges):
        best = pair_counts(table).orderBy(F.desc("n"), "left", "right").first()
        if best is None or best["n"] < 1:
            break
        found.append((best["left"], best["right"]))
        table = merge(table, *found[-1])
        if n % 8 == 7:
            table = table.checkpoint()
    return found

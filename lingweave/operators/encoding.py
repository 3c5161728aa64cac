"""Encoding pairs to ids, batching and padding, masks: array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BOS, EOS, PAD, EncodingConfig
from .tokenizer_stats import Encoder


def encode_pairs(pairs: DataFrame, encode: Encoder) -> DataFrame:
    """``row_index, src_ids, tgt_in_ids, tgt_out_ids, overlength`` needs ``with_overlength``; here the three arrays."""
    ids = pairs.select("row_index", encode(F.col("pl")).alias("s"), encode(F.col("en")).alias("t"))
    end, start = F.array(F.lit(EOS)), F.array(F.lit(BOS))
    return ids.select("row_index", F.concat("s", end).alias("src_ids"), F.concat(start, "t").alias("tgt_in_ids"), F.concat("t", end).alias("tgt_out_ids"))


def with_overlength(encoded: DataFrame, max_seq_len: int) -> DataFrame:
    longest = F.greatest(F.size("src_ids"), F.size("tgt_in_ids"), F.size("tgt_out_ids"))
    return encoded.withColumn("overlength", longest > max_seq_len)


def examples(pairs: DataFrame, encode: Encoder, config: EncodingConfig = EncodingConfig(), limit: int | None = None) -> DataFrame:
    """Encoded examples; ``limit`` counts rows of the file, before any is dropped."""
    rows = pairs if limit is None else pairs.where(F.col("row_index") < limit)
    marked = with_overlength(encode_pairs(rows, encode), config.max_seq_len)
    return (marked.where("not overlength") if config.drop_overlength else marked).drop("overlength")


def load_stats(pairs: DataFrame, encode: Encoder, config: EncodingConfig = EncodingConfig()) -> DataFrame:
    """``rows_in, overlength, examples``."""
    marked = with_overlength(encode_pairs(pairs, encode), config.max_seq_len)
    kept = F.count_if(~F.col("overlength")) if config.drop_overlength else F.count("*")
    return marked.agg(F.count("*").alias("rows_in"), F.count_if("overlength").alias("overlength"), kept.alias("examples"))


#: Parameter: indices of a stretch that is numbered by one task.
STRETCH = 1 << 16


def chunked(rows: DataFrame, size: int, index: str = "row_index") -> DataFrame:
    """Adds ``batch_id``: the chunk of ``size`` in which a row's place among the rows given lies, in the order of ``index``.

    Stretches of the index are counted and numbered each by itself, and the counts before a stretch are added; no task sees more rows than a stretch has.
    """
    if size <= 0:
        raise ValueError("the size of a batch must be positive")
    marked = rows.withColumn("_stretch", F.floor(F.col(index) / STRETCH))
    counts = marked.groupBy("_stretch").agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_stretch", before.alias("_before"))
    place = F.row_number().over(Window.partitionBy("_stretch").orderBy(index)) - 1
    numbered = marked.withColumn("_place", place).join(offsets, "_stretch")
    return numbered.withColumn("batch_id", F.floor((F.col("_before") + F.col("_place")) / size)).drop("_stretch", "_place", "_before")


def rounded(length: Column, multiple: int | None) -> Column:
    return length if not multiple or multiple <= 1 else (F.ceil(length / multiple) * multiple).cast("int")


def padded(ids: Column, length: Column) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(PAD), (length - F.size(ids)).cast("int")))


def pad_batches(encoded: DataFrame, multiple: int | None = 8, columns: tuple[str, ...] = ("src_ids", "tgt_in_ids", "tgt_out_ids")) -> DataFrame:
    """Pads every array to its batch's longest, rounded up."""
    batch = Window.partitionBy("batch_id")
    longest = encoded.withColumns({f"_{c}": rounded(F.max(F.size(c)).over(batch), multiple) for c in columns})
    return longest.withColumns({c: padded(F.col(c), F.col(f"_{c}")) for c in columns}).drop(*[f"_{c}" for c in columns])


def pad_mask(ids: Column) -> Column:
    return F.transform(ids, lambda x: x == PAD)


def causal_mask(size: Column) -> Column:
    """True above the diagonal: what a position may not see."""
    places = F.sequence(F.lit(0), size - 1)
    return F.transform(places, lambda i: F.transform(places, lambda j: j > i))


def attention_masks(src_pad: Column, tgt_pad: Column) -> tuple[Column, Column]:
    """What may be seen: source positions that are no padding; target positions that are no padding and not ahead."""
    src = F.transform(src_pad, lambda p: ~p)
    places = F.sequence(F.lit(0), F.size(tgt_pad) - 1)
    tgt = F.transform(places, lambda i: F.transform(tgt_pad, lambda p, j: ~p & (j <= i)))
    return src, tgt


def collate(encoded: DataFrame, multiple: int | None = 8) -> DataFrame:
    """One row per batch: ``batch_id, src, tgt_in, tgt_out, src_pad, tgt_pad, causal``.  A batch is bounded by its size."""
    rows = pad_batches(encoded, multiple)
    grouped = rows.groupBy("batch_id").agg(F.sort_array(F.collect_list(F.struct("row_index", "src_ids", "tgt_in_ids", "tgt_out_ids"))).alias("r"))
    pick = lambda n: F.transform("r", lambda x: x[n])
    mask = lambda n: F.transform("r", lambda x: pad_mask(x[n]))
    return grouped.select("batch_id", pick("src_ids").alias("src"), pick("tgt_in_ids").alias("tgt_in"), pick("tgt_out_ids").alias("tgt_out"), mask("src_ids").alias("src_pad"), mask("tgt_in_ids").alias("tgt_pad"), causal_mask(F.size(F.get("r", F.lit(0))["tgt_in_ids"])).alias("causal"))


def shuffled(rows: DataFrame, seed: int) -> DataFrame:
    """A seeded order that does not depend on partitions: by hash of the row's place."""
    return rows.orderBy(F.xxhash64("row_index", F.lit(seed)), "row_index")


def validation_rows(train: DataFrame, validation: DataFrame, overfit: bool) -> DataFrame:
    """In overfit mode the training rows validate."""
    return train if overfit else validation


def without_specials(ids: Column) -> Column:
    """Ids to decode: padding, start and end go, unknown stays."""
    return F.filter(ids, lambda x: ~x.isin(PAD, BOS, EOS))

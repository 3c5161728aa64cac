"""Token counts by a digest cache.

The content of each text is normalised (null becomes empty; a byte-level tokenizer sees every character, so nothing else may
change) and digested; the tokenizer's own file is digested as its version.  Both digests are joined to a stored cache of counts.  Only distinct
misses are encoded, and their counts are appended to the cache.

Defined results: a null text counts as empty; empty text has no tokens; rows that repeat an id are counted each; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import path_exists, quoted, scratch_path, small_batches, stored, text_or_empty

CACHE_SCHEMA = "digest binary, version binary, n_tokens long"


def tokenizer_version(tokenizer_path: str) -> bytes:
    """The digest of the tokenizer's file."""
    with open(tokenizer_path, "rb") as f:
        return hashlib.sha256(f.read()).digest()


def counter(tokenizer_path: str):
    """A function that counts a text's tokens; what it remembers goes with it."""
    from .pieces import LibraryParts, SpaceLedPieces

    library = LibraryParts(tokenizer_path, lambda ids: bytes(len(ids)))
    pieces = SpaceLedPieces(lambda s: len(library.ids(s)), room=48 << 20, specials=library.specials)
    return lambda text: sum(pieces.values(text))


def _encode_misses(tokenizer_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer_path)
        for batch in batches:
            counts = pa.array([count(x) for x in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts], ["digest", "n_tokens"])

    return run


def read_cache(spark: SparkSession, cache_path: str, version: bytes) -> DataFrame:
    """The counts stored for one version of a tokenizer, one row per digest."""
    if not path_exists(spark, cache_path):
        return spark.createDataFrame([], "digest binary, n_tokens long")
    cached = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
    return cached.where(F.col("version") == F.lit(version)).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row of ``docs``; new counts are appended to the cache at ``cache_path``.

    Two passes read the texts: the first gives the digests and the one row that stands for each missing digest, the second
    sends those rows alone to the encoder.  A digest that a third of all rows share is thus encoded once, and copies of it are dealt by their ids, not to one task.
    """
    spark = docs.sparkSession
    small_batches(spark)
    cache_path = cache_path or scratch_path(spark, "token-cache")
    version = tokenizer_version(tokenizer_path)
    text = text_or_empty(text_col)
    keyed = docs.select(F.col(quoted(id_col)).alias("doc_id"), text.alias("content"), F.unhex(F.sha2(text, 256)).alias("digest"))

    # The row that stands for a digest is that with the least hash of its id; rows that repeat both lie in one partition of the join and are one row after it.
    placed = keyed.select("digest", F.xxhash64("doc_id").alias("place"), "content")
    missing = placed.groupBy("digest").agg(F.min("place").alias("place")).join(read_cache(spark, cache_path, version), "digest", "left_anti")
    todo = placed.join(missing, ["digest", "place"], "left_semi").groupBy("digest", "place").agg(F.first("content").alias("content")).select("digest", "content")
    fresh = todo.mapInArrow(_encode_misses(tokenizer_path), "digest binary, n_tokens long")
    fresh.select("digest", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(cache_path)

    # Stored first: the join then reads the counts as they are, and a digest that very many rows share can be split among tasks.
    counts = stored(read_cache(spark, cache_path, version), "counts")
    sized = keyed.select("doc_id", "digest", F.octet_length("content").cast("long").alias("n_bytes"))
    return sized.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

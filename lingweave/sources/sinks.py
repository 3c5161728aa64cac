"""Sinks of the corpus stages; bulk data is written by executors, reports by the driver from small aggregates."""

from __future__ import annotations

import json
from collections.abc import Iterable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def write_clean(rows: DataFrame, path: str, one_file: bool = False) -> None:
    """Kept pairs as zstd parquet in row order; ``one_file`` for consumers that ask for a single file."""
    ordered = rows.select("pl", "en", "row_index").repartitionByRange("row_index").sortWithinPartitions("row_index").drop("row_index")
    (ordered.coalesce(1) if one_file else ordered).write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_removed(rows: DataFrame, path: str) -> None:
    rows.repartitionByRange("split_rank", "row_index").sortWithinPartitions("split_rank", "row_index").drop("split_rank").write.mode("overwrite").json(path)


def write_labels(labels: DataFrame, path: str) -> None:
    """Label lines, all together and by split."""
    lines = labels.select(F.col("split").alias("s"), F.col("row_index").alias("i"), F.col("label").alias("l"))
    lines.write.mode("overwrite").json(f"{path}/all")
    lines.withColumn("split", F.col("s")).write.mode("overwrite").partitionBy("split").json(f"{path}/by_split")


def write_batches(batches: DataFrame, path: str) -> None:
    batches.write.mode("overwrite").json(f"{path}/all")
    batches.withColumn("part", F.col("split")).write.mode("overwrite").partitionBy("part").json(f"{path}/by_split")


def bad_sentences(labelled: DataFrame) -> DataFrame:
    """``split, count, records`` (JSON) of rows labelled bad."""
    bad = labelled.where("label = 0").select("split", F.struct("row_index", "pl", "en").alias("record"))
    grouped = bad.groupBy("split").agg(F.count("*").alias("count"), F.sort_array(F.collect_list("record")).alias("records"))
    return grouped.select("split", "count", F.to_json("records").alias("records"))


def corpus_lines(pairs: DataFrame) -> DataFrame:
    """Two lines per pair, source first, newlines as spaces: ``row_index, side, line``."""
    clean = lambda n: F.replace(F.col(n), F.lit("\n"), F.lit(" "))
    sides = F.array(F.struct(F.lit(0).alias("side"), clean("pl").alias("line")), F.struct(F.lit(1).alias("side"), clean("en").alias("line")))
    return pairs.select("row_index", F.inline(sides))


def write_corpus(pairs: DataFrame, path: str) -> int:
    lines = corpus_lines(pairs)
    lines.repartitionByRange("row_index", "side").sortWithinPartitions("row_index", "side").select("line").write.mode("overwrite").text(path)
    return 2 * pairs.count()


#: Quotes are doubled and white space at the ends of texts stays, so that what was written can be read back.
TSV = {"sep": "\t", "header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_translations(rows: DataFrame, path: str) -> None:
    rows.repartitionByRange("index").sortWithinPartitions("index").write.mode("overwrite").options(**TSV).csv(path)


def read_translations(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What ``write_translations`` wrote; empty texts, which the format does not tell from nulls, are empty."""
    return spark.read.options(**TSV, multiLine=True).schema(schema).csv(path).fillna("")


def write_json(data: dict[str, Any], path: str | Path, sort: bool = False) -> None:
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(json.dumps(data, indent=2, sort_keys=sort), encoding="utf-8")


def append_log(path: str | Path, event: dict[str, Any]) -> None:
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    with p.open("a", encoding="utf-8") as f:
        f.write(json.dumps(event) + "\n")


def write_lines(path: str | Path, lines: Iterable[str]) -> None:
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text("\n".join(lines) + "\n", encoding="utf-8")

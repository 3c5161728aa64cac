"""Scans of parallel corpora and of label files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import SPLITS

#: The nested schema of a raw split.
RAW = T.StructType([T.StructField("translation", T.StructType([T.StructField("pl", T.StringType()), T.StructField("en", T.StringType())]))])
LABEL_CODES = {"bad": 0, "uncertain": 1, "good": 2}


def resolve_split(spark: SparkSession, folder: str, pattern: str) -> str:
    """The one file of ``folder`` that matches ``pattern``, on any file system that Spark reaches; none or several are an error."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    names = sorted(s.getPath().toString() for s in found or [])
    if len(names) != 1:
        raise FileNotFoundError(f"{pattern} matches {len(names)} files in {folder}, not one")
    return names[0]


def scan_raw(spark: SparkSession, path: str, split: str, order: tuple[str, ...] = SPLITS) -> DataFrame:
    """A raw split: ``split, split_rank, row_index`` (the row's place in its file), ``translation``."""
    rows = spark.read.schema(RAW).parquet(path)
    return rows.select(F.lit(split).alias("split"), F.lit(order.index(split)).alias("split_rank"), F.col("_metadata.row_index").alias("row_index"), "translation")


def scan_splits(spark: SparkSession, folder: str, patterns: dict[str, str], order: tuple[str, ...] = SPLITS) -> DataFrame:
    """All splits as one relation."""
    parts = [scan_raw(spark, resolve_split(spark, folder, patterns[s]), s, order) for s in order]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stringified(c: Column) -> Column:
    """A null reads as the text ``None``."""
    return F.coalesce(c.cast("string"), F.lit("None"))


def scan_pairs(spark: SparkSession, path: str, source: str = "pl", target: str = "en", keep: tuple[Column, ...] = ()) -> DataFrame:
    """Pairs of a raw or a clean split, whichever its schema shows: ``row_index, pl, en`` and ``keep``; nulls are stringified, a missing struct field is empty."""
    rows = spark.read.parquet(path)
    place = F.col("_metadata.row_index").alias("row_index")
    if {source, target} <= set(rows.columns):
        return rows.select(*keep, place, stringified(F.col(source)).alias("pl"), stringified(F.col(target)).alias("en"))
    if "translation" in rows.columns:
        fields = rows.schema["translation"].dataType.fieldNames()
        side = lambda n: stringified(F.col(f"translation.{n}")) if n in fields else F.lit("")
        return rows.select(*keep, place, side(source).alias("pl"), side(target).alias("en"))
    raise ValueError(f"{path} has neither {source} and {target} nor translation")


def numbered_pairs(spark: SparkSession, path: str) -> DataFrame:
    """``scan_pairs`` of one file or a folder of files, with ``row_index`` counted on through the files in the order of their names.

    Only a row for each file is gathered.
    """
    of = F.col("_metadata.file_path")
    files = spark.read.parquet(path).select(of.alias("file"), F.col("_metadata.row_index").alias("at")).groupBy("file").agg((F.max("at") + 1).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = files.select("file", before.alias("before"))
    return scan_pairs(spark, path, keep=(of.alias("file"),)).join(starts, "file").select((F.col("row_index") + F.col("before")).alias("row_index"), "pl", "en")


def limited(rows: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` rows by place."""
    return rows if n is None else rows.where(F.col("row_index") < n)


def count_rows(spark: SparkSession, path: str) -> int:
    """Rows of a parquet file, from its footers alone."""
    return spark.read.parquet(path).count()


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file in order: ``line_no, line``.  The number grows with the place in the file but may have gaps."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.trim("value").alias("line")).where("line <> ''")


def parse_labels(lines: DataFrame) -> DataFrame:
    """``line_no, split, row_index, label`` of label lines in the short form ``s, i, l`` or the long form; others have nulls."""
    parsed = lines.withColumn("j", F.from_json("line", "s string, i long, l string, split string, row_index long, label string"))
    code = F.coalesce("j.l", "j.label")
    # Any whole number counts as a label; whether it is accepted is for the cleaning to say.
    label = F.when(code.rlike(r"^\s*[+-]?\d{1,9}\s*$"), F.trim(code).cast("int"))
    for name, value in LABEL_CODES.items():
        label = F.when(code == name, value).otherwise(label)
    return parsed.select("line_no", F.coalesce("j.s", "j.split").alias("split"), F.coalesce("j.i", "j.row_index").alias("row_index"), label.alias("label"))


def last_labels(parsed: DataFrame) -> DataFrame:
    """The last label of each row of a known split: ``split, row_index, label``."""
    known = parsed.where(F.col("split").isin(*SPLITS) & F.col("row_index").isNotNull() & F.col("label").isNotNull())
    return known.groupBy("split", "row_index").agg(F.max_by("label", "line_no").alias("label"))


def label_load_stats(parsed: DataFrame) -> DataFrame:
    """One row per known split and one for all (null split): lines ``loaded``, ``duplicates``; and ``unknown_split`` over all."""
    known = F.col("split").isin(*SPLITS)
    seen = parsed.where(F.col("row_index").isNotNull() & F.col("label").isNotNull())
    repeats = Window.partitionBy("split", "row_index").orderBy("line_no")
    marked = seen.withColumn("again", (F.row_number().over(repeats) > 1) & known).withColumn("known", F.coalesce(known, F.lit(False)))
    marked = marked.withColumn("split", F.when(F.col("known"), F.col("split")).otherwise("unknown"))
    rolled = marked.rollup("split").agg(F.count_if("known").alias("loaded"), F.count_if("again").alias("duplicates"), F.count_if(~F.col("known")).alias("unknown_split"))
    return rolled.where("split is null or split <> 'unknown'")


def parse_batches(lines: DataFrame) -> DataFrame:
    """``line_no, split, batch_index, size`` of batch-log lines."""
    parsed = lines.withColumn("j", F.from_json("line", "split string, batch_index int, size int"))
    return parsed.select("line_no", "j.split", "j.batch_index", "j.size").where("split is not null and batch_index is not null")

"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark alone, so any store that Spark reaches will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset and the master is local, as in tests, a temporary folder is made and set for this context; on a cluster that is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    found = spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    local = tempfile.mkdtemp(prefix="lingweave-")
    atexit.register(shutil.rmtree, local, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(local)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back.

    This cuts the lineage: what reads the result survives the loss of any executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.scratch = path
    return found


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``stored`` wrote, once nothing that is still to run reads them."""
    for df in tables:
        discard_path(df.sparkSession, df.scratch)


def discard_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder; for small intermediate tables of iterations."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


#: Parameter: bytes of rows that go to Python at once.
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
ARROW_BATCH = 1 << 20


def small_batches(spark: SparkSession) -> None:
    """Lets rows travel to Python in small batches, unless the session says how large they are to be: a row may hold a long text, and a task holds a batch several times."""
    if not spark._jsparkSession.conf().contains(ARROW_BYTES):
        spark.conf.set(ARROW_BYTES, ARROW_BATCH)


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(quoted(column)), F.lit(""))


def quoted(column: str) -> str:
    """A column name as it stands, dots and all."""
    return "`" + column.replace("`", "``") + "`"


def fresh(name: str, columns: list[str]) -> str:
    """``name``, with underscores before it until no column has it (whatever the case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: The ASCII letters whose case is folded where only A-Z may change.
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def remainder(id_column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(quoted(id_column)).cast("string"), F.lit("")), "UTF-8")) % modulus


#: Parameter: keys that take no more bytes than this are broadcast, others are shuffled.
KEY_BROADCAST_BYTES = 32 << 20


def text_digest(text_col: str) -> Column:
    return F.unhex(F.md5(text_or_empty(text_col)))


def by_keys(docs: DataFrame, keys: DataFrame, how: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose id and text digest are (``left_semi``) or are not (``left_anti``) among ``keys`` (``doc_id, digest``, checkpointed).

    The size of the keys is measured: small ones are broadcast, so the texts are not shuffled.
    """
    key, digest = fresh("_key_id", docs.columns), fresh("_key_digest", docs.columns)
    keys = keys.select(F.col("doc_id").alias(key), F.col("digest").alias(digest))
    if keys.count() * 48 <= KEY_BROADCAST_BYTES:
        keys = F.broadcast(keys)
    return docs.join(keys, F.col(quoted(id_col)).eqNullSafe(F.col(key)) & (text_digest(text_col) == F.col(digest)), how)

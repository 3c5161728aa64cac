"""Token ids in length-delimited binary records.

One shard is one data file and one index file.  A data file starts with ``HEADER``; each record in it is

    u64 length of the payload | u32 masked crc32 of those 8 bytes | payload | u32 masked crc32 of the payload

with the payload ``u8 has_id | u8 bytes per id | i64 doc_id | ids``, all little-endian.  An id takes two bytes where the vocabulary
allows it, else four.  The index file holds the offset of each record as u64, so records can be read in any order.  A checksum is
masked by rotating it right by 15 bits and adding ``MASK``, so that a checksum of data with checksums inside is no trivial value.

Documents are dealt to shards by ranges of the id and, for ids that many rows share, of how the text begins, and sorted within them (nulls first, equal ids by text).  Every attempt of a task writes files of its own
names; the manifest, written by Spark's committer, lists those of the attempts that counted.  A lost executor thus costs its running tasks only.
Data and index files go through Arrow's file systems (local folders, HDFS, S3, GCS), with credentials as Arrow finds them; the manifest goes through Spark.

Defined results: a null text counts as empty, so its record holds the end id alone; rows that repeat an id have a record each; a null
id is kept and comes first; an empty table gives a manifest without shards and an empty result.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import quoted, small_batches, text_or_empty

HEADER = b"LWREC\x00\x01\x00"
MASK = 0xA282EAD8
MANIFEST = "shard int, file string, n_records long, n_tokens long, n_bytes long"
RECORD = "shard int, place long, doc_id long, start long, n_tokens long, ids array<long>, ids_le binary"
_LENGTH, _SUM, _HEAD = struct.Struct("<Q"), struct.Struct("<I"), struct.Struct("<BBq")


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = _LENGTH.pack(len(payload))
    return b"".join((length, _SUM.pack(masked(length)), payload, _SUM.pack(masked(payload))))


def unframe(data, at: int) -> tuple[bytes, int]:
    """The payload of the record at ``at`` and where the next one starts; a wrong checksum is an error."""
    length = bytes(data[at : at + 8])
    if len(length) < 8 or _SUM.unpack(data[at + 8 : at + 12])[0] != masked(length):
        raise ValueError(f"the length of the record at {at} is damaged")
    end = at + 12 + _LENGTH.unpack(length)[0]
    payload = bytes(data[at + 12 : end])
    if len(data) < end + 4 or _SUM.unpack(data[end : end + 4])[0] != masked(payload):
        raise ValueError(f"the record at {at} is damaged")
    return payload, end + 4


def pack(doc_id: int | None, ids: bytes, width: int) -> bytes:
    return _HEAD.pack(doc_id is not None, width, doc_id or 0) + ids


def unpack(payload: bytes):
    """The document's id and its token ids as an array of u32."""
    import numpy as np

    has, width, doc_id = _HEAD.unpack_from(payload)
    return (doc_id if has else None), np.frombuffer(payload, {2: "<u2", 4: "<u4"}[width], offset=_HEAD.size).astype("<u4")


def file_system(path: str):
    """The file system of a path and the path in it; a path without scheme is local."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class SpacelessEncoder:
    """Encodes with the tokenizers library, which drops white space here, and remembers what it made of each part of a word."""

    def __init__(self, tokenizer_path: str, end_id: int, room: int = 320 << 20):
        from tokenizers import Tokenizer

        from .pieces import LibraryParts, SpacelessPieces

        tokenizer = Tokenizer.from_file(tokenizer_path)
        self.width = 2 if tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        kind = "H" if self.width == 2 else "I"
        library = LibraryParts(tokenizer_path, lambda ids: array(kind, ids).tobytes(), room // 2, tokenizer)
        self.pieces = SpacelessPieces(library, room // 2)
        self.end = array(kind, [end_id]).tobytes()

    def encode(self, text: str) -> bytes:
        return b"".join(self.pieces.values(text)) + self.end


def write_token_records(docs: DataFrame, out_dir: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every text, appends ``end_id``, and writes the shards in ascending order of the id; returns the manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        task = TaskContext.get()
        shard, name = task.partitionId(), f"shard-{task.partitionId():06d}-{task.taskAttemptId()}"
        encoder, store, offsets, at, n_tokens = SpacelessEncoder(tokenizer_path, end_id), None, [], len(HEADER), 0
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part, framed = batch.slice(start, 256), []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = encoder.encode(text)
                    framed.append(frame(pack(doc_id, ids, encoder.width)))
                    offsets.append(at)
                    at += len(framed[-1])
                    n_tokens += len(ids) // encoder.width
                if store is None:
                    store, folder = file_system(out_dir)
                    store.create_dir(folder, recursive=True)
                    data = store.open_output_stream(f"{folder}/{name}.rec")
                    data.write(HEADER)
                data.write(b"".join(framed))
        if store is not None:
            data.close()
            with store.open_output_stream(f"{folder}/{name}.idx") as index:
                index.write(np.array(offsets, "<u8").tobytes())
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "file": [name], "n_records": [len(offsets)], "n_tokens": [n_tokens], "n_bytes": [at]})

    small_batches(docs.sparkSession)
    ordered = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), text_or_empty(text_col).alias("content")).repartitionByRange("doc_id", F.substring("content", 1, 32)).sortWithinPartitions("doc_id", "content")
    ordered.mapInArrow(run, MANIFEST).write.parquet(f"{out_dir}/manifest")
    return read_manifest(docs.sparkSession, out_dir)


def read_manifest(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{out_dir}/manifest")


def read_token_records(spark: SparkSession, out_dir: str, with_ids: bool = True) -> DataFrame:
    """Every record of a folder, read through the index files and checked.

    ``shard, place`` (in the shard), ``doc_id, start`` (ids of all records before it), ``n_tokens, ids, ids_le`` (little-endian u32).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for shard, name, before in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                store, folder = file_system(out_dir)
                with store.open_input_stream(f"{folder}/{name}.idx") as f:
                    offsets = np.frombuffer(f.read(), "<u8").tolist()
                with store.open_input_file(f"{folder}/{name}.rec") as f:
                    if f.read(len(HEADER)) != HEADER:
                        raise ValueError(f"{name} is no file of records")
                    size = f.size()
                    for start in range(0, len(offsets), 256):
                        part = offsets[start : start + 256]
                        f.seek(part[0])
                        data = memoryview(f.read((offsets[start + 256] if start + 256 < len(offsets) else size) - part[0]))
                        found = [unpack(unframe(data, at - part[0])[0]) for at in part]
                        sizes = [len(x) for _, x in found]
                        starts = (before + np.cumsum([0, *sizes[:-1]])).tolist()
                        before += sum(sizes)
                        ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(np.concatenate([x for _, x in found]).astype(np.int64))) if with_ids else pa.nulls(len(part), pa.list_(pa.int64()))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([shard] * len(part), pa.int32()), pa.array(range(start, start + len(part)), pa.int64()), pa.array([d for d, _ in found], pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), ids, pa.array([x.tobytes() for _, x in found], pa.binary())],
                            ["shard", "place", "doc_id", "start", "n_tokens", "ids", "ids_le"],
                        )

    # One row per shard: the window sees the manifest alone.
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    manifest = read_manifest(spark, out_dir)
    shards = manifest.select("shard", "file", F.coalesce(before, F.lit(0)).alias("before"))
    # A task for each shard: the rows are few and small, so left alone they would be read by one.
    return shards.repartition(max(1, manifest.count()), "shard").mapInArrow(run, RECORD)

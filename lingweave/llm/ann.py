"""Approximate nearest neighbours by a permutation index.

Every vector is represented by the order of its nearest pivots.  Rows are dealt to shards by a hash of their id; a shard holds, for each pivot, an inverted file of
the rows that have the pivot among their ``POSTED`` nearest, with its place in their order.  A query walks the files of its own nearest pivots and sums what is common,
which ranks rows by the footrule distance of the orders (places beyond the last one posted count as the next one).  The best share of each shard is ranked again by the cosine of the original
vectors in double precision, and the best of all shards are the answer.

Pivots are the first ``PIVOTS`` different vectors of the four times as many rows with the least hash of their id, so fitting looks at a bounded sample, and a vector that many rows share is one
pivot; every row is indexed.  ``SHARE`` of a shard, at least ``LEAST``
rows, is reranked: that is the index's approximation, with no cap besides.  The tests measure recall against brute force.

Defined results: vectors that are null, zero, hold a null or a number that is not finite, or are not of the most frequent length (the smaller at ties) take no part;
rows that repeat an id count once, the least vector of them; a row is no neighbour of its own id; equal cosines go by the smaller id, as do equal footrules; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import quoted, small_batches, stored

#: Parameters: pivots; nearest pivots posted for each row; rows of a shard; share of a shard that is reranked, and rows of it at least; queries sent at once.
PIVOTS, POSTED, SHARD, SHARE, LEAST, BLOCK = 512, 64, 4096, 0.15, 200, 4096


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, v`` (array of doubles) of the rows that take part, one for each id."""
    v = F.col(quoted(vector_col))
    rows = vectors.where(F.col(quoted(id_col)).isNotNull() & v.isNotNull()).select(F.col(quoted(id_col)).cast("long").alias("id"), v.cast("array<double>").alias("v"))
    infinite = float("inf")
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite)) & F.exists("v", lambda x: x != 0)
    rows = rows.where(whole).groupBy("id").agg(F.min("v").alias("v"))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (size["n"] if size else 0))


def places(unit: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """For each row the pivots from the nearest to the farthest; the smaller pivot first at ties."""
    return np.argsort(-(unit @ pivots.T), axis=1, kind="stable").astype(np.int16)


def scaled(v: np.ndarray) -> np.ndarray:
    """Each row times a power of two that brings its largest component near 1: no square overflows, and cosines stay the same to the last bit."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])


def lengths(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v * v).sum(axis=1))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The cosine of each row of ``x`` with ``y``; equal rows get equal values to the last bit."""
    x, y = scaled(x), scaled(y[None])
    return (x * y).sum(axis=1) / (lengths(x) * lengths(y))


def _units(v: np.ndarray) -> np.ndarray:
    v = scaled(v)
    return v / lengths(v)[:, None]


def build_index(rows: DataFrame, pivots: np.ndarray, n_shards: int, posted: int = POSTED) -> DataFrame:
    """The index, a stored table with a row for each shard: ids, vectors, and for each pivot its inverted file (row numbers and places), all as packed arrays."""

    def build(part: pa.Table) -> pa.Table:
        order = np.argsort(part.column("id").to_numpy(), kind="stable")
        ids = part.column("id").to_numpy()[order]
        v = np.array(part.column("v").to_pylist(), np.float64)[order]
        near = places(_units(v), pivots)[:, :posted]
        # Postings sorted by pivot; within a file by row number.
        flat = near.reshape(-1)
        by_pivot = np.argsort(flat, kind="stable")
        row, place = (by_pivot // near.shape[1]).astype("<u4"), (by_pivot % near.shape[1]).astype("<u2")
        ends = np.searchsorted(flat[by_pivot], np.arange(len(pivots) + 1)).astype("<u4")
        return pa.table({"ids": [ids.astype("<i8").tobytes()], "vectors": [v.astype("<f8").tobytes()], "rows": [row.tobytes()], "places": [place.tobytes()], "ends": [ends.tobytes()]})

    sharded = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(n_shards)))
    return stored(sharded.groupBy("shard").applyInArrow(build, "ids binary, vectors binary, rows binary, places binary, ends binary"), "permutation-index")


def search_shard(shard: dict, queries: np.ndarray, query_ids: np.ndarray, orders: np.ndarray, k: int, posted: int, share: float, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query of a block its ``k`` nearest in a shard: the query's id, ids, cosines."""
    ids = np.frombuffer(shard["ids"], "<i8")
    # Equal rows get equal cosines to the last bit, whatever else the shard or the block holds.
    v, queries = scaled(np.frombuffer(shard["vectors"], "<f8").reshape(len(ids), -1)), scaled(queries)
    length, asked = lengths(v), lengths(queries)
    rows, where, ends = np.frombuffer(shard["rows"], "<u4"), np.frombuffer(shard["places"], "<u2").astype(np.int32), np.frombuffer(shard["ends"], "<u4")
    posted = min(posted, orders.shape[1])
    n = min(len(ids), max(least, int(np.ceil(share * len(ids)))))
    tie = len(ids) - 1 - np.arange(len(ids))
    for q, q_length, query_id, order in zip(queries, asked, query_ids, orders, strict=True):
        # What two orders have in common: the footrule is a constant less twice this sum.
        common = np.zeros(len(ids), np.int64)
        for place, p in enumerate(order[:posted]):
            a, b = ends[p], ends[p + 1]
            common[rows[a:b]] += posted - np.maximum(where[a:b], place)
        # Rows are numbered by id, so of equal sums the smaller ids come first.
        key = common * len(ids) + tie
        best = np.argpartition(-key, n - 1)[:n] if n < len(ids) else np.arange(len(ids))
        best = best[ids[best] != query_id]
        score = (v[best] * q).sum(axis=1) / (length[best] * q_length)
        top = np.lexsort((ids[best], -score))[:k]
        yield int(query_id), ids[best][top], score[top]


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS, posted: int = POSTED, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each row where ``is_query`` (of the column ``id``) holds."""
    spark = vectors.sparkSession
    small_batches(spark)
    out = "query_id long, vec_id long, score double"
    rows = stored(usable(vectors, id_col, vector_col), "vectors")
    n = rows.count()
    # A bounded sample: the pivots.
    sample = rows.orderBy(F.xxhash64("id", F.lit("pivot")), "id").limit(4 * pivots).collect()
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    anchors = _units(np.array([*dict.fromkeys(tuple(r["v"]) for r in sample)][:pivots]))
    index = build_index(rows, anchors, -(-n // SHARD), posted)
    asked = rows.where(is_query)
    n_blocks = -(-asked.count() // BLOCK) or 1
    found = None
    for i in range(n_blocks):
        # The stated queries go through in blocks of about BLOCK rows against all shards.
        block = asked.where(F.pmod(F.xxhash64("id", F.lit("block")), F.lit(n_blocks)) == i).orderBy("id").collect()
        if not block:
            continue
        q = np.array([r["v"] for r in block])
        sent = spark.sparkContext.broadcast((q, np.array([r["id"] for r in block]), places(_units(q), anchors)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            queries, query_ids, orders = sent.value
            for batch in batches:
                for shard in batch.to_pylist():
                    hits = [*search_shard(shard, queries, query_ids, orders, k, posted, share, least)]
                    sizes = [len(x) for _, x, _ in hits]
                    yield pa.RecordBatch.from_pydict({"query_id": pa.array(np.repeat([x for x, _, _ in hits], sizes), pa.int64()), "vec_id": pa.array(np.concatenate([x for _, x, _ in hits]), pa.int64()), "score": pa.array(np.concatenate([x for _, _, x in hits]), pa.float64())})

        part = index.repartition(-(-n // SHARD)).mapInArrow(run, out)
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

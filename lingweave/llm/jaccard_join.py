"""N-gram Jaccard join by grouped prefixes, and the components of its links.

Two documents link when their sets of word shingles have a Jaccard similarity of at least ``NUMERATOR / DENOMINATOR``.  All sets are sorted by one global order, rare
shingles first; two sets that link then share a shingle among their prefixes.  Documents with equal sets are one set; sets with equal prefixes and size are one
group.  Groups post their prefixes; groups that meet in a posting list are filtered by size, by the places where they meet and by a bound on the difference of their sets,
then expanded to their sets, which are verified in full.

Not every pair of a posting list is expanded.  First each member is verified against the one before it in its list, in an order that differs from list to list, and each set
against one of its group: this already joins large groups of near copies.  Then the pairs that meet, pass the filters and do not yet share a component are expanded and verified.  A link within
a component found already changes no component, so nothing is lost.

The bound is a parity: for each of some bins whether an odd number of a set's hashes fall in it.  Where the bins of two sets differ, at least one element lies in one
set alone, and linked sets may differ by a set share of their sizes at most.

The global order is by counts of hashed shingles in a sketch of fixed size over all documents, then by hash.  Any total order gives exact results; counts keep
frequent shingles out of prefixes.  Lists of shingles that the sketch knows to be frequent are dealt out by salt.

Defined results: a null text and a text without words have the empty set, which links with nothing; a text with fewer words than a shingle has one shingle; documents that
repeat an id are taken each for itself, and a component's id is its smallest id that is not null; a null id alone has a null component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_keys, checkpointed, discard, fresh, quoted, small_batches, stored, text_digest, text_or_empty

#: Parameters: words of a shingle; similarity as a fraction; bits of the sketch and of a chunk of it; bytes of ids that may be broadcast.
WORDS, NUMERATOR, DENOMINATOR, SKETCH_BITS, CHUNK_BITS, BROADCAST_BYTES = 4, 85, 100, 21, 16, 32 << 20
#: A shingle's weight is UNIT times the binary logarithm of its count; from HOT on, or where its bin of the sketch holds CROWDED times as much as the mean, it counts as frequent.
UNIT, CROWDED = 512, 8
HOT = 12 * UNIT
#: Hashes below this are countable, a quarter of all; what is not comes last in the global order.
COUNTABLE, UNCOUNTED = 1 << 62, 0x7FFF
#: Parameter: others in a list that each set still apart meets before all pairs that are apart do.
MEETINGS = 8
#: Parameter: 64-bit words of the parity that travels with postings.
PARITY_WORDS = 16


def shingles(text: str, size: int) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles; A-Z are folded, and words are split at ASCII white space alone."""
    from xxhash import xxh3_64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(size, len(words))
    whole = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        whole = (whole ^ h[i : len(h) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        whole ^= whole >> np.uint64(32)
    return np.unique(whole)


def sketch_counts(texts: DataFrame, size: int) -> np.ndarray:
    """Weights of hashed shingles by the leading bits of the hash, from counts over all texts (one column)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int32)
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                found = [shingles(t, size) for t in batch.column(0).slice(start, 128).to_pylist()]
                at, n = np.unique(np.concatenate(found) >> np.uint64(64 - SKETCH_BITS), return_counts=True)
                total[at.astype(np.int64)] += n.astype(np.int32)
        at = np.flatnonzero(total)
        chunk, n = at >> CHUNK_BITS, total[at]
        cuts = np.searchsorted(chunk, np.arange((1 << SKETCH_BITS - CHUNK_BITS) + 1))
        for c, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if b > a:
                kind = "<u1" if n[a:b].max() < 256 else "<u8"
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([c], pa.int32()), "at": [(at[a:b] & (1 << CHUNK_BITS) - 1).astype("<u2").tobytes()], "n": [n[a:b].astype(kind).tobytes()]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, at, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                places = np.frombuffer(at, "<u2")
                sums.setdefault(c, np.zeros(1 << CHUNK_BITS, np.int64))[places] += np.frombuffer(n, "<u1" if len(n) == len(places) else "<u8").astype(np.int64)
        for c, x in sums.items():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([c], pa.int32()), "weight": [np.rint(UNIT * np.log2(1.0 + x)).astype("<u2").tobytes()]})

    chunks = texts.mapInArrow(count, "chunk int, at binary, n binary").repartition("chunk").mapInArrow(add, "chunk int, weight binary")
    weights = np.zeros((1 << SKETCH_BITS - CHUNK_BITS, 1 << CHUNK_BITS), np.uint16)
    for row in chunks.collect():  # of fixed size, whatever the input
        weights[row["chunk"]] = np.frombuffer(row["weight"], "<u2")
    return weights.reshape(-1)


def _needed(n: int, numerator: int, denominator: int) -> int:
    return -(-numerator * n // denominator)


def _prefix_length(n: int, numerator: int, denominator: int) -> int:
    return n - _needed(n, numerator, denominator) + 1 if n else 0


def parity(hashes: np.ndarray) -> bytes:
    """For each of a power of two of bins, at least as many as hashes, whether it holds an odd number of them.

    Where two sets' bins differ, at least one element lies in one set alone, so the number of such bins is a lower bound of their symmetric difference.
    """
    bins = 1 << max(6 + (PARITY_WORDS - 1).bit_length(), (len(hashes) - 1).bit_length() if len(hashes) else 0)
    odd = np.bincount((hashes & np.uint64(bins - 1)).astype(np.int64), minlength=bins) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """The lower bound from two parities; the longer one is folded to the length of the shorter."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    short = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(z.reshape(-1, short), axis=0) for z in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def parity_words(whole: bytes) -> list[int]:
    """A parity folded to ``PARITY_WORDS`` numbers."""
    x = np.frombuffer(whole, np.uint8)
    return np.bitwise_xor.reduce(x.reshape(-1, 8 * PARITY_WORDS), axis=0).view(np.int64).tolist()


def hot_from(weights: np.ndarray) -> int:
    """The weight from which a bin of the sketch counts as frequent: bins grow with the input, so it is also measured by their mean."""
    mean = float((np.exp2(weights / UNIT) - 1).mean())
    return max(HOT, int(UNIT * np.log2(1 + CROWDED * mean)))


def early_tokens(h: np.ndarray, length: int, weights: np.ndarray, hot: int) -> tuple[np.ndarray, int]:
    """The hashes that may be among the first ``length`` of a set's order, as tokens, and how many of them are countable.

    A token is a weight above 48 bits of the hash.  Countable ones have weight 0 until they are counted, or the sketch's weight where that is frequent; the others, taken only where
    the countable ones are too few, have the last weight and go by hash.
    """
    n = int(np.searchsorted(h, np.uint64(COUNTABLE)))
    first, rest = h[:n], h[n:length]
    w = weights[(first >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64)
    first = np.where(w >= hot, w, np.uint64(0)) << np.uint64(48) | first & np.uint64((1 << 48) - 1)
    return np.concatenate([first, np.uint64(UNCOUNTED << 48) | rest >> np.uint64(16)]).view(np.int64), n


def signatures(docs: DataFrame, size: int, numerator: int, denominator: int) -> tuple[DataFrame, int]:
    """``doc_id, digest`` (of the text), ``n, sig`` (digest of the set), ``parity, folded`` (its words), ``countable, early`` (see ``early_tokens``) for each document, as a stored table; and the weight of frequent shingles."""
    counted = sketch_counts(docs.select("content"), size)
    hot, weights = hot_from(counted), docs.sparkSession.sparkContext.broadcast(counted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = weights.value
        for whole in batches:
            for start in range(0, whole.num_rows, 128):
                batch = whole.slice(start, 128)
                sizes, sigs, parities, words, countable, early = [], [], [], [], [], []
                for text in batch.column(2).to_pylist():
                    h = shingles(text, size)
                    n = len(h)
                    tokens, some = early_tokens(h, _prefix_length(n, numerator, denominator), weight, hot)
                    sizes.append(n)
                    sigs.append(hashlib.md5(h.tobytes()).digest())
                    parities.append(parity(h))
                    words.append(parity_words(parities[-1]))
                    countable.append(some)
                    early.append(tokens)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, early)]), pa.int32()), pa.array(np.concatenate(early)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(parities, pa.binary()), pa.array(words, pa.list_(pa.int64())), pa.array(countable, pa.int32()), lists], ["doc_id", "digest", "n", "sig", "parity", "folded", "countable", "early"])

    longs = T.ArrayType(T.LongType())
    schema = docs.select("doc_id").schema.add("digest", "binary").add("n", "long").add("sig", "binary").add("parity", "binary").add("folded", longs).add("countable", "integer").add("early", longs)
    return stored(docs.select("doc_id", text_digest("content").alias("digest"), "content").mapInArrow(run, schema), "signatures"), hot


def _salt(token: Column, by: Column, hot: int) -> Column:
    """0, or for a frequent token one of as many numbers as its count asks for, by a hash of ``by`` that differs from token to token."""
    weight = F.shiftrightunsigned(token, 48)
    parts = F.pow(F.lit(2.0), F.least(F.floor((weight - hot) / UNIT) + 1, F.lit(20))).cast("long")
    return F.when((weight >= hot) & (weight < UNCOUNTED), F.pmod(F.xxhash64(by, token), parts)).otherwise(F.lit(0)).cast("int")


def prefixes(sets: DataFrame, numerator: int, denominator: int, hot: int) -> DataFrame:
    """``sid, n, alone`` (countable shingles that no other set has), ``folded, prefix`` (array of ``place, token``) of the sets that share a shingle of their prefix with another set.

    Countable shingles are counted exactly; those of one set alone come first in the order and are posted nowhere, for they can meet nothing.  Most sets are left out by that: their
    prefix is theirs alone.
    """
    posted = sets.select("sid", F.posexplode("early").alias("at", "token"))
    held = posted.withColumn("salt", _salt(F.col("token"), F.col("sid"), hot))
    counted = held.withColumn("count", F.count("*").over(Window.partitionBy("token", "salt")))
    weight = F.shiftrightunsigned("token", 48)
    frequent = (weight >= hot) & (weight < UNCOUNTED)
    shared = counted.where(frequent | (F.col("count") > 1))
    by_count = F.least(F.rint(UNIT * F.log2(F.col("count").cast("double"))).cast("long"), F.lit(hot - 1))
    shared = shared.select("sid", F.when(weight == 0, F.shiftleft(by_count, 48).bitwiseOR(F.col("token"))).otherwise(F.col("token")).alias("token"), "at")
    held_by_others = F.count_if(F.shiftrightunsigned("token", 48) < UNCOUNTED).alias("counted")
    lists = shared.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("token", "at"))).alias("shared"), held_by_others)
    length = F.col("n") - F.ceil(F.col("n") * numerator / denominator) + 1
    known = lists.join(sets.select("sid", "n", "countable", "folded"), "sid").withColumn("alone", F.col("countable") - F.col("counted"))
    place = lambda t, i: F.when(F.shiftrightunsigned(t["token"], 48) < UNCOUNTED, F.col("alone") + i).otherwise(t["at"]).cast("int")
    prefix = F.filter(F.transform("shared", lambda t, i: F.struct(place(t, i).alias("place"), t["token"].alias("token"))), lambda t: t["place"] < length)
    return known.select("sid", F.col("n").cast("int").alias("n"), F.col("alone").cast("int").alias("alone"), "folded", prefix.alias("prefix")).where(F.size("prefix") > 0)


def _close(n1: Column, n2: Column, numerator: int, denominator: int) -> Column:
    return F.least(n1, n2) * denominator >= F.greatest(n1, n2) * numerator


def _may_link(n1: Column, p1: Column, n2: Column, p2: Column, numerator: int, denominator: int) -> Column:
    """The size filter, and the overlap still possible when sets of sizes n1 and n2 meet at places p1 and p2 of their orders."""
    most = F.least(p1, p2) + 1 + F.least(n1 - p1, n2 - p2) - 1
    return _close(n1, n2, numerator, denominator) & (most * (numerator + denominator) >= (n1 + n2) * numerator)


def verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, size: int, numerator: int, denominator: int) -> DataFrame:
    """The pairs ``a, b`` of set ids that link.

    Parities, a bit for each element, first rule out pairs whose symmetric difference is too large.  For the others the texts of one document for each set are read again and
    compared in full.
    """

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m, x, y = (batch.column(i).to_pylist() for i in range(6))
            # The difference of linked sets is at most (denominator - numerator) / (denominator + numerator) of the sum of their sizes.
            rest = [i for i in range(len(a)) if least_difference(x[i], y[i]) * (denominator + numerator) <= (n[i] + m[i]) * (denominator - numerator)]
            yield pa.RecordBatch.from_pydict({"a": pa.array([a[i] for i in rest], pa.int64()), "b": pa.array([b[i] for i in rest], pa.int64())})

    one = sets.select(F.col("sid").alias("a"), F.col("n").alias("n_a"), F.col("parity").alias("parity_a"))
    other = sets.select(F.col("sid").alias("b"), F.col("n").alias("n_b"), F.col("parity").alias("parity_b"))
    some = checkpointed(pairs.join(one, "a").join(other, "b").select("a", "b", "n_a", "n_b", "parity_a", "parity_b").mapInArrow(near, "a long, b long"))
    wanted = some.select(F.explode(F.array("a", "b")).alias("sid")).distinct().join(sets.select("sid", "sig", "doc"), "sid").select("sid", "sig", "doc")
    wanted = checkpointed(wanted)
    ids = wanted.select("doc").distinct()

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                found = [shingles(t, size).tobytes() for t in batch.column(0).slice(start, 128).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.md5(x).digest() for x in found], pa.binary()), pa.array(found, pa.binary())], ["sig", "hashes"])

    if ids.count() * 24 <= BROADCAST_BYTES:
        ids = F.broadcast(ids)
    texts = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("doc")), "left_semi").select("content")
    # Documents that repeat an id may have other sets: the digest decides.
    hashes = texts.mapInArrow(again, "sig binary, hashes binary").join(wanted.select("sid", "sig"), "sig").groupBy("sid").agg(F.first("hashes").alias("hashes"))
    hashes = stored(hashes, "sets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, x, y = (batch.column(i).to_pylist() for i in range(4))
            linked = []
            for i in range(len(a)):
                u, v = np.frombuffer(x[i], np.uint64), np.frombuffer(y[i], np.uint64)
                both = len(u) + len(v) - len(np.union1d(u, v))
                if denominator * both >= numerator * (len(u) + len(v) - both):
                    linked.append(i)
            yield pa.RecordBatch.from_pydict({"a": pa.array([a[i] for i in linked], pa.int64()), "b": pa.array([b[i] for i in linked], pa.int64())})

    left = hashes.select(F.col("sid").alias("a"), F.col("hashes").alias("x"))
    right = hashes.select(F.col("sid").alias("b"), F.col("hashes").alias("y"))
    linked = checkpointed(some.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"))
    discard(hashes)
    return linked


def components(edges: DataFrame) -> DataFrame:
    """``sid, label`` for each end of an edge ``a, b``: the smallest id that it can reach.  Labels pass along edges and then along labels, until none changes."""
    both = checkpointed(edges.union(edges.select("b", "a")).distinct())
    labels = checkpointed(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("sid"), F.least("a", "m").alias("label")))
    while True:
        near = both.join(labels.select(F.col("sid").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        nearer = labels.join(near, F.col("sid") == F.col("a")).select("sid", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        nearer = checkpointed(nearer)
        jump = nearer.select(F.col("sid").alias("label"), F.col("label").alias("next"))
        jumped = checkpointed(nearer.join(jump, "label", "left").select("sid", "old", F.least("label", F.coalesce("next", "label")).alias("label")))
        labels = jumped.select("sid", "label")
        if jumped.where("old <> label").isEmpty():
            return labels


def _with_labels(sets: DataFrame, labels: DataFrame) -> DataFrame:
    return sets.join(labels, "sid", "left").withColumn("label", F.coalesce("label", "sid"))


def _edges(labels: DataFrame) -> DataFrame:
    """Edges that give the components of ``labels``."""
    return labels.where("sid <> label").select(F.col("label").alias("a"), F.col("sid").alias("b"))


def _open_rows(met: DataFrame, labelled: DataFrame) -> DataFrame:
    """``token, sid, n, place, label, folded`` of the sets in lists whose members are not one component yet; of lists with the same members the first alone, as its shingle is the first that any two of them share."""
    span = checkpointed(labelled.groupBy("gid").agg(F.min("label").alias("low"), F.max("label").alias("high")))
    sides = met.select("token", "gid", "n", "place").join(span, "gid")
    members = F.count("*").alias("size"), F.bit_xor(F.xxhash64("gid")).alias("m1"), F.bit_xor(F.xxhash64("gid", F.lit(1))).alias("m2")
    open_lists = sides.groupBy("token").agg(*members, F.min("low").alias("least"), F.max("high").alias("most")).where("least <> most")
    first = open_lists.groupBy("size", "m1", "m2").agg(F.min("token").alias("token")).select("token")
    rows = met.select("token", "gid", "n", "place").join(first, "token", "left_semi").join(labelled, "gid")
    return checkpointed(rows.select("token", "sid", "n", "place", "label", "folded"))


def similarity_components(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each document, besides ``digest`` (of the text) and ``component`` (equal for documents of one component; null for the empty set)."""
    small_batches(documents.sparkSession)
    docs = documents.select(F.col(quoted(id_col)).alias("doc_id"), text_or_empty(text_col).alias("content"))
    signed, hot = signatures(docs, size, numerator, denominator)
    full = signed.where("n > 0")
    distinct = full.groupBy("sig").agg(F.first(F.struct("n", "parity", "folded", "countable", "early")).alias("s"), F.min("doc_id").alias("doc"))
    sets = stored(distinct.select(F.monotonically_increasing_id().alias("sid"), "sig", "s.*", "doc"), "sets")

    # Groups of equal size and prefix, by 128 bits of hashes; a group's id is half of them: should two groups share it, their sets are verified as those of one.
    # Shingles that a set has alone belong to its prefix, so a set that has any is a group of its own.
    own = F.when(F.col("alone") > 0, F.col("sid"))
    two = [F.xxhash64("n", "prefix", own).alias("gid"), F.xxhash64(F.lit(1), "prefix", own, "n").alias("twin")]
    grouped = stored(prefixes(sets, numerator, denominator, hot).select("sid", "n", "alone", "folded", "prefix", *two), "prefixes")
    groups = grouped.groupBy("gid", "twin").agg(F.first("n").alias("n"), F.first("alone").alias("alone"), F.first("prefix").alias("prefix"))

    # Postings of the prefixes; only lists of two and more go on.
    may = lambda n1, p1, n2, p2: _may_link(n1, p1, n2, p2, numerator, denominator)
    posted = groups.select("gid", "n", "alone", F.inline("prefix")).withColumn("salt", _salt(F.col("token"), F.col("gid"), hot))
    weight = F.shiftrightunsigned("token", 48)
    lists = Window.partitionBy("token", "salt").orderBy(F.xxhash64("gid", "token"), "gid")
    # The member with the least share of shingles of its own: what others were copied from, or close to it.
    hub = F.min(F.struct(F.col("alone") / F.col("n"), F.xxhash64("gid"), "gid", "n", "place")).over(Window.partitionBy("token", "salt"))
    placed = posted.select("*", F.lag(F.struct("gid", "n", "place")).over(lists).alias("before"), F.lead("gid").over(lists).alias("next"), hub.alias("hub"))
    alive = placed.where(F.col("before").isNotNull() | F.col("next").isNotNull() | (weight >= hot))
    beside = F.when(may(F.col("before.n"), F.col("before.place"), F.col("n"), F.col("place")), F.col("before.gid"))
    around = F.when((F.col("hub.gid") != F.col("gid")) & may(F.col("hub.n"), F.col("hub.place"), F.col("n"), F.col("place")), F.col("hub.gid"))
    met = stored(alive.select("token", "n", "place", "gid", beside.alias("beside"), around.alias("hub")), "postings")

    # First each member beside the one before it in the list and beside the list's hub, and each group around one of its sets.
    near = lambda n1, n2, w1, w2: F.coalesce(sum((F.bit_count(F.get(w1, F.lit(i)).bitwiseXOR(F.get(w2, F.lit(i)))) for i in range(PARITY_WORDS)), F.lit(0)) * (denominator + numerator) <= (n1 + n2) * (denominator - numerator), F.lit(True))
    centre = checkpointed(grouped.groupBy("gid").agg(F.min(F.struct("sid", "n", "folded")).alias("c"), F.count("*").alias("members")).select("gid", F.col("c.sid").alias("centre"), F.col("c.n").alias("n"), F.col("c.folded").alias("folded"), "members"))
    c1, c2 = (centre.select(F.col("gid").alias(g), F.col("centre").alias(s), F.col("n").alias(f"n{s}"), F.col("folded").alias(f"w{s}")) for g, s in (("gid1", "a"), ("gid", "b")))
    beside = met.select("gid", F.explode(F.array("beside", "hub")).alias("beside")).where("beside is not null")
    next_to = beside.select(F.least("gid", "beside").alias("gid"), F.greatest("gid", "beside").alias("gid1")).distinct()
    across = next_to.join(c1, "gid1").join(c2, "gid").where(near(F.col("na"), F.col("nb"), F.col("wa"), F.col("wb"))).select("a", "b")
    inside = grouped.select("sid", "gid").join(centre.where("members > 1").select("gid", "centre"), "gid").where("sid <> centre").select(F.col("centre").alias("a"), F.col("sid").alias("b"))
    stars = verified(across.union(inside).distinct(), sets, docs, size, numerator, denominator)
    labels = components(stars)

    # Lists still open: what is apart meets several others first, in another order of the list, then all it may link with.  A set that joined a component drops out of its lists' pairs.
    labelled = checkpointed(_with_labels(grouped.select("sid", "gid", "folded"), labels))
    some = _open_rows(met, labelled)
    order = Window.partitionBy("token", "salt").orderBy(F.xxhash64("sid", "token", F.lit(2)), "sid")
    salted = some.withColumn("salt", _salt(F.col("token"), F.col("sid"), hot))
    others = F.array(*[F.lag(F.struct(F.col("sid").alias("b"), F.col("n").alias("n_b"), F.col("place").alias("place_b"), F.col("label").alias("label_b"), F.col("folded").alias("folded_b")), k).over(order) for k in range(1, MEETINGS + 1)])
    beside = salted.withColumn("others", others).select("sid", "n", "place", "label", "folded", F.explode("others").alias("o")).where("o is not null").select("sid", "n", "place", "label", "folded", "o.*").where("label <> label_b")
    beside = beside.where(may(F.col("n"), F.col("place"), F.col("n_b"), F.col("place_b")) & near(F.col("n"), F.col("n_b"), F.col("folded"), F.col("folded_b")))
    more = verified(beside.select(F.least("sid", "b").alias("a"), F.greatest("sid", "b").alias("b")).distinct(), sets, docs, size, numerator, denominator)
    labels = components(_edges(labels).union(more))

    rows = _open_rows(met, checkpointed(_with_labels(grouped.select("sid", "gid", "folded"), labels)))
    names = ("sid", "n", "place", "label", "folded")
    x, y = (rows.select("token", *[F.col(n).alias(f"{n}_{s}") for n in names]) for s in ("x", "y"))
    bound = near(F.col("n_x"), F.col("n_y"), F.col("folded_x"), F.col("folded_y"))
    meet = x.join(y, (x["token"] == y["token"]) & (F.col("sid_x") < F.col("sid_y")) & (F.col("label_x") != F.col("label_y")) & may(F.col("n_x"), F.col("place_x"), F.col("n_y"), F.col("place_y")) & bound)
    rest = verified(meet.select(F.col("sid_x").alias("a"), F.col("sid_y").alias("b")).distinct(), sets, docs, size, numerator, denominator)
    # Links found before need not be walked again: their labels stand for them.
    final = components(_edges(labels).union(rest))

    of_set = checkpointed(_with_labels(sets.select("sid", "sig", "doc"), final))
    discard(sets, grouped, met)
    least = of_set.groupBy("label").agg(F.min("doc").alias("least"))
    known = of_set.join(least, "label").select(F.col("sig").alias("set_sig"), "label", "least")
    result = signed.select("doc_id", "digest", "n", "sig").join(known, F.col("sig") == F.col("set_sig"), "left")
    return result.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"), "digest", F.col("label").alias("component"))


def one_of_each(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``documents`` with all their columns, but of each component only the document with the smallest id (of equal ids, the least digest of the text; of equal rows, one)."""
    found = similarity_components(documents, id_col, text_col).where("component is not null")
    row = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("digest"))
    keys = checkpointed(found.groupBy("component", "doc_id", "digest").agg(F.count("*").alias("n")))
    first = keys.groupBy("component").agg(F.min(row).alias("first"))
    judged = keys.join(first, "component").select("doc_id", "digest", "n", (row == F.col("first")).alias("stays"))
    rest = checkpointed(judged.where("not stays or n > 1"))
    kept = by_keys(documents, rest.where("not stays"), "left_anti", id_col, text_col)
    repeated = rest.where("stays")
    if repeated.isEmpty():
        return kept
    names = [F.col(quoted(c)) for c in documents.columns]
    digest = fresh("_digest", documents.columns)
    again = by_keys(kept, repeated, "left_semi", id_col, text_col).withColumn(digest, text_digest(text_col)).dropDuplicates([id_col, digest]).select(*names)
    return by_keys(kept, repeated, "left_anti", id_col, text_col).unionByName(again)

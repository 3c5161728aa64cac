"""Toxicity by logistic regression, trained with FTRL-proximal over hashed word n-grams and skip-grams.

A text's features are the hashed words, their beginnings of four and five letters (so that inflected forms share features), pairs of
neighbours, and pairs with one word between; each counts once per text.  Every coordinate has its own learning rate, and L1 keeps most weights at
zero, so the weights are a short list that travels to all tasks.

Learning uses a bounded sample: at most ``SAMPLE`` labelled texts of either label, those with the least hash of their id.  The intercept is
then set back to the share of toxic texts among all labelled rows.

Defined results: a null text counts as empty; an empty text gets the score of the intercept; without labelled rows every score is 0;
where labels of one id differ, the text counts as toxic; an id that many rows have is learned from once, from the least of its texts; repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, quoted, remainder, small_batches, text_or_empty
from .pieces import Memory

#: Parameters: texts of either label to learn from at most; texts of the sample that a feature must occur in; FTRL's alpha, beta, L1 and L2; passes.
SAMPLE, MIN_TEXTS, ALPHA, BETA, L1, L2, PASSES = 8_000, 3, 0.15, 1.0, 4.0, 0.1, 4
THRESHOLD = 0.3
#: Parameters: bits of the hashes of words, of their beginnings and of pairs; each kind of feature has a range of its own, so that the many pairs of a long text do not fall on words.
WORD_BITS, FIVE_BITS, FOUR_BITS, PAIR_BITS = 22, 21, 20, 23
FIVE_AT, FOUR_AT, PAIR_AT, SIZE = 1 << 22, (1 << 22) + (1 << 21), 1 << 23, 1 << 24


def _word(piece: str) -> int:
    """Hashes of the word and of its two beginnings, side by side in one number; -1 if nothing in the piece is a letter or digit."""
    word = piece.lower()
    if not word.isalnum():
        word = "".join(filter(str.isalnum, word))
        if not word:
            return -1
    whole = word.encode()
    five, four = (whole[:5], whole[:4]) if len(whole) == len(word) else (word[:5].encode(), word[:4].encode())
    return zlib.crc32(b"w" + whole) >> 32 - WORD_BITS << FIVE_BITS + FOUR_BITS | zlib.crc32(b"5" + five) >> 32 - FIVE_BITS << FOUR_BITS | zlib.crc32(b"4" + four) >> 32 - FOUR_BITS


#: Parameter: bytes of the words whose hashes a task remembers.
WORD_ROOM = 64 << 20


def word_memory() -> Memory:
    """Hashes of words, for one task."""
    return Memory(_word, WORD_ROOM)


def feature_indices(text: str, hashes: Memory) -> np.ndarray:
    """The hashed features of a whole text, with repeats."""
    words = np.fromiter(map(hashes.__getitem__, text.split()), np.int64)
    words = words[words >= 0]
    word, five, four = words >> FIVE_BITS + FOUR_BITS, words >> FOUR_BITS & (1 << FIVE_BITS) - 1, words & (1 << FOUR_BITS) - 1
    mix = lambda a, b, k: (a * 0x9E3779B1 + b * 0x85EBCA77 + k) * 0xC2B2AE3D >> 13 & (1 << PAIR_BITS) - 1
    return np.concatenate([word, FIVE_AT + five, FOUR_AT + four, PAIR_AT + mix(word[:-1], word[1:], 1), PAIR_AT + mix(word[:-2], word[2:], 2)])


def train_ftrl(features: np.ndarray, ends: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """FTRL-proximal over examples in order; the indices with weights that are not zero, the weights, the intercept.

    ``features`` (int32) has the distinct feature indices of all examples one after the other, ``ends`` where each example's end; it is overwritten, so that no more than two arrays of its
    size are held at a time.
    """
    ordered = np.sort(features)
    # Sorted, an index that MIN_TEXTS texts have is equal to the one so many places on, and its first place is where the one before differs.
    often = ordered[MIN_TEXTS - 1 :] == ordered[: max(0, len(ordered) - MIN_TEXTS + 1)]
    often[1:] &= ordered[1 : len(often)] != ordered[: max(0, len(often) - 1)]
    used = ordered[: len(often)][often]
    del ordered, often
    start = filled = 0
    kept = []
    for end in ends.tolist():
        at = features[start:end]
        place = np.searchsorted(used, at)
        place = place[used[np.minimum(place, len(used) - 1)] == at] if len(used) else place[:0]
        features[filled : filled + len(place)] = place
        filled, start = filled + len(place), end
        kept.append(filled)
    ends = np.array([0, *kept])
    examples = [*zip(ends[:-1].tolist(), ends[1:].tolist(), labels.tolist(), strict=True)]
    z, n = np.zeros(len(used)), np.zeros(len(used))
    bias_z = bias_n = 0.0

    def weights(at):
        rest = z[at]
        return np.where(np.abs(rest) <= L1, 0.0, (np.sign(rest) * L1 - rest) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(PASSES):
        for start, end, label in examples:
            at = features[start:end]
            w, bias = weights(at), -bias_z / ((BETA + bias_n**0.5) / ALPHA)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -30, 30))) - label
            n_at = n[at]
            z[at] += g - (np.sqrt(n_at + g * g) - np.sqrt(n_at)) / ALPHA * w
            n[at] = n_at + g * g
            bias_z += g - ((bias_n + g * g) ** 0.5 - bias_n**0.5) / ALPHA * bias
            bias_n += g * g
    at = np.flatnonzero(np.abs(z) > L1)
    return used[at], weights(at), -bias_z / ((BETA + bias_n**0.5) / ALPHA)


class Model:
    """Sparse weights by feature index (ascending), and the intercept (None: nothing was learned)."""

    def __init__(self, at: np.ndarray, weights: np.ndarray, intercept: float | None):
        self.at, self.weights, self.intercept, self.known = np.asarray(at, np.int64), np.asarray(weights, np.float64), intercept, None

    def __getstate__(self):
        return self.__dict__ | {"known": None}

    def score(self, text: str, hashes: Memory) -> float:
        if self.intercept is None:
            return 0.0
        if self.known is None:
            self.known = np.zeros(SIZE, bool)
            self.known[self.at] = True
        at = feature_indices(text, hashes)
        at = np.unique(at[self.known[at]])
        return float(1 / (1 + np.exp(-np.clip(self.weights[np.searchsorted(self.at, at)].sum() + self.intercept, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fits on labelled rows where ``learn_from`` (of ``id_col``) holds."""
    small_batches(docs.sparkSession)
    key = F.col(quoted(id_col))
    known = labels.where(key.isNotNull() & F.col(quoted(label_col)).isNotNull()).where(learn_from).groupBy(key.alias("id")).agg(F.max(F.col(quoted(label_col)).cast("int")).alias("label"))
    totals = {int(r["label"] > 0): r["count"] for r in known.groupBy((F.col("label") > 0).cast("int").alias("label")).count().collect()}
    if len(totals) < 2:
        return Model(np.zeros(0), np.zeros(0), None)
    least = F.xxhash64("id")
    # Bounded by the parameter, so it may be broadcast.
    chosen = known.where("label > 0").orderBy(least, "id").limit(sample).union(known.where("label <= 0").orderBy(least, "id").limit(sample)).select("id", (F.col("label") > 0).cast("int").alias("label"))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_memory()
        for batch in batches:
            found = [np.unique(feature_indices(t, hashes)).astype("<i4").tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["place", "label", "at"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, sizes, labels = [], [], []
        for batch in batches:
            labels += batch.column(1).to_pylist()
            lists = batch.column(2).to_pylist()
            sizes += [len(x) // 4 for x in lists]
            parts.append(np.frombuffer(b"".join(lists), "<i4"))
        features, filled = np.empty(sum(sizes), "<i4"), 0
        while parts:  # each goes as it is copied
            part = parts.pop(0)
            features[filled : filled + len(part)] = part
            filled += len(part)
        at, weights, intercept = train_ftrl(features, np.cumsum(sizes, dtype=np.int64), np.array(labels, int))
        toxic = sum(labels)
        shift = np.log(totals[1] / totals[0]) - np.log(max(toxic, 1) / max(len(labels) - toxic, 1))
        yield pa.RecordBatch.from_pydict({"at": pa.array([-1, *at], pa.int32()), "weight": pa.array([intercept + shift, *weights], pa.float64())})

    # An id that many rows have counts once, with the least of its texts.
    texts = docs.where(key.isNotNull()).select(key.alias("id"), text_or_empty(text_col).alias("content")).join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("content").alias("content"))
    # The order of learning is by another hash than the choice, or labels would come in runs.
    examples = texts.select(F.xxhash64("id", F.lit("order")).alias("place"), "label", "content").mapInArrow(featured, "place long, label int, at binary")
    # One task learns, from the bounded sample, in an order that does not depend on the partitions.
    rows = examples.repartition(1).sortWithinPartitions("place", "at").mapInArrow(train, "at int, weight double").toPandas()
    bias = rows[rows["at"] < 0]
    rest = rows[rows["at"] >= 0].sort_values("at")
    return Model(rest["at"].to_numpy(), rest["weight"].to_numpy(), float(bias["weight"].iloc[0]) if len(bias) else None)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), named: str = "score") -> DataFrame:
    """``doc_id`` (and the columns in ``keep``) and the score in a column ``named`` so, for each row."""
    small_batches(docs.sparkSession)
    shown = [*dict.fromkeys((id_col, *keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_memory()
        for batch in batches:
            scores = [model.score(t, hashes) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], [*shown, named])

    schema = docs.select([F.col(quoted(n)) for n in shown]).schema.add(named, "double")
    return docs.select(*[F.col(quoted(n)) for n in shown], text_or_empty(text_col).alias(fresh("_content", shown))).mapInArrow(run, schema)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learns from labelled rows whose crc32 of the id modulo 4 is not 2 and scores all: ``doc_id, held_out, score, predicted``."""
    model = fit(docs, labels, remainder(id_col, 4) != 2, id_col, text_col)
    scored = score(docs, model, id_col, text_col)
    return scored.select(F.col(quoted(id_col)).alias("doc_id"), (remainder(id_col, 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

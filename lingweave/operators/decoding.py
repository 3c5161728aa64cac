"""Greedy and beam decoding over a ``step`` function, in Arrow batches.

A scorer makes ``step`` for a batch of sources: it maps prefixes (an int array, one row each) and the rows' sources to log-probabilities of the next id.  Any model that
gives these will do: the numpy transformer of this package, or a table in tests.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BOS, EOS, PAD, DecodingConfig

#: ``step(prefixes, rows)``: log-probabilities, one row for each prefix; ``rows`` tells which source each prefix belongs to.
Step = Callable[[np.ndarray, np.ndarray], np.ndarray]
Scorer = Callable[[np.ndarray], Step]


def penalised(score: float, length: int, alpha: float) -> float:
    return score if alpha <= 0 else score / max(1, length) ** alpha


def trimmed(tokens: list[int], eos: int = EOS) -> list[int]:
    return tokens[: tokens.index(eos) + 1] if eos in tokens else tokens


def pad_sources(sources: list[list[int]]) -> np.ndarray:
    width = max(map(len, sources), default=0)
    return np.array([s + [PAD] * (width - len(s)) for s in sources], np.int64).reshape(len(sources), width)


def greedy_one(step: Step, max_new: int, row: int = 0, bos: int = BOS, eos: int = EOS) -> list[int]:
    out = [bos]
    for _ in range(max_new):
        out.append(int(np.argmax(step(np.array([out]), np.array([row]))[0])))
        if out[-1] == eos:
            break
    return out


def greedy_batch(step: Step, n: int, max_new: int, bos: int = BOS, eos: int = EOS) -> list[list[int]]:
    """All rows grow together; finished ones keep emitting the end id until all are."""
    out, done, rows = np.full((n, 1), bos, np.int64), np.zeros(n, bool), np.arange(n)
    for _ in range(max_new):
        following = np.where(done, eos, np.argmax(step(out, rows), axis=1))
        out = np.concatenate([out, following[:, None]], axis=1)
        done |= following == eos
        if done.all():
            break
    return [trimmed(t, eos) for t in out.tolist()]


def _top(values: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest, largest first, earlier places first at ties."""
    return np.argsort(-values, kind="stable")[:k]


def beam_one(step: Step, max_new: int, config: DecodingConfig, row: int = 0, bos: int = BOS, eos: int = EOS) -> list[int]:
    """The single-sentence search: ended beams leave the pool, and candidates are ranked by penalised score at each step."""
    if config.beam_size <= 1:
        return greedy_one(step, max_new, row, bos, eos)
    rank = lambda item: penalised(item[1], len(item[0]), config.length_penalty)
    live, ended = [([bos], 0.0)], []
    for _ in range(max_new):
        ended += [x for x in live if x[0][-1] == eos]
        growing = [x for x in live if x[0][-1] != eos]
        if not growing:
            break
        # Prefixes of one round are equally long.
        scores = step(np.array([t for t, _ in growing]), np.full(len(growing), row))
        grown = [([*t, int(i)], s + float(p[i])) for (t, s), p in zip(growing, scores, strict=True) for i in _top(p, config.beam_size)]
        live = sorted(grown, key=rank, reverse=True)[: config.beam_size]
        if all(t[-1] == eos for t, _ in live):
            ended += live
            break
    return max(ended or live, key=rank)[0]


def beam_batch(step: Step, n: int, max_new: int, config: DecodingConfig, bos: int = BOS, eos: int = EOS) -> list[list[int]]:
    """The batched search: ended beams stay and take the end id at no cost, pruning is by raw score, and the penalty counts in the last choice only."""
    if config.beam_size <= 1:
        return greedy_batch(step, n, max_new, bos, eos)
    k = config.beam_size
    tokens = np.full((n, k, 1), bos, np.int64)
    scores = np.full((n, k), -np.inf)
    scores[:, 0] = 0.0
    rows = np.repeat(np.arange(n), k)
    for _ in range(max_new):
        following = np.array(step(tokens.reshape(n * k, -1), rows), float).reshape(n, k, -1)
        over = tokens[:, :, -1] == eos
        following[over] = -np.inf
        following[over, eos] = 0.0
        size = following.shape[2]
        total = (scores[:, :, None] + following).reshape(n, -1)
        best = np.argsort(-total, axis=1, kind="stable")[:, :k]
        scores = np.take_along_axis(total, best, axis=1)
        tokens = np.concatenate([np.take_along_axis(tokens, (best // size)[:, :, None], axis=1), (best % size)[:, :, None]], axis=2)
        if (tokens[:, :, -1] == eos).all():
            break
    out = []
    for beams, own in zip(tokens.tolist(), scores.tolist(), strict=True):
        choices = [trimmed(b, eos) for b in beams]
        out.append(max(zip(choices, own, strict=True), key=lambda x: penalised(x[1], len(x[0]), config.length_penalty))[0])
    return out


def decode(encoded: DataFrame, scorer: Scorer, config: DecodingConfig = DecodingConfig(), max_seq_len: int = 128) -> DataFrame:
    """``index, tokens`` for rows of ``index, src_ids``, in batches as large as the configuration says within each partition.

    A source longer than the model allows is an error.
    """
    max_new = min(config.max_new_tokens, max_seq_len - 1)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for start in range(0, part.num_rows, config.batch_size):
                piece = part.slice(start, config.batch_size)
                sources = piece.column(1).to_pylist()
                if any(len(s) > max_seq_len for s in sources):
                    raise ValueError(f"a source is longer than {max_seq_len} ids")
                found = beam_batch(scorer(pad_sources(sources)), len(sources), max_new, config)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(found, pa.list_(pa.int32()))], ["index", "tokens"])

    return encoded.select(F.col("index").cast("long").alias("index"), "src_ids").mapInArrow(run, "index long, tokens array<int>")


class TableScorer:
    """A scorer from a table of log-probabilities by last id; the source shifts nothing."""

    def __init__(self, table: np.ndarray):
        self.table = np.asarray(table, float)

    def __call__(self, sources: np.ndarray) -> Step:
        return lambda prefixes, rows: self.table[prefixes[:, -1]]

"""Corpus BLEU and chrF as distributed sums of n-gram matches.

The definitions are those of the papers (Papineni et al. 2002, Popović 2015) with the customary defaults: BLEU over 13a tokens up to order 4 with exponential smoothing,
chrF over characters without white space up to order 6 with beta 2.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLEU_ORDER, CHRF_ORDER, BETA = 4, 6, 2.0
#: Sentences whose n-grams are counted together; it bounds memory and changes no count.
ROWS_AT_ONCE = 32

#: The 13a tokenisation, in order.
TOKENISE_13A = (
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" $1 "),
    (r"([^0-9])([\.,])", r"$1 $2 "),
    (r"([\.,])([^0-9])", r" $1 $2"),
    (r"([0-9])(-)", r"$1 $2 "),
)
ENTITIES = (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))


def tokens_13a(c: Column) -> Column:
    for a, b in (("<skipped>", ""), ("-\n", ""), ("\n", " "), *ENTITIES):
        c = F.replace(c, F.lit(a), F.lit(b))
    c = F.concat(F.lit(" "), c, F.lit(" "))
    for pattern, to in TOKENISE_13A:
        c = F.regexp_replace(c, pattern, to)
    return F.regexp_extract_all(c, F.lit(r"(?U)[^\s\x1c-\x1f]+"), F.lit(0))


def dark(c: Column) -> Column:
    """A text without white space: its code points are chrF's characters."""
    return F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", "")


def overlaps(codes: np.ndarray, hyp: np.ndarray, ref: np.ndarray, order: int) -> np.ndarray:
    """``match, hyp, ref`` by order of the n-grams of sentences: ``codes`` holds the items of all hypotheses, then of all references, ``hyp`` and ``ref`` their numbers by sentence.

    An n-gram is one number made of its sentence and items; where that would outgrow 63 bits the numbers in use are numbered anew, so equality stays exact.
    """
    sizes = np.concatenate([hyp, ref])
    sentence, ends = np.repeat(np.concatenate([np.arange(len(hyp)), np.arange(len(ref))]), sizes), np.repeat(np.cumsum(sizes), sizes)
    letters, base = np.unique(codes, return_inverse=True)
    size, side, at = len(letters), np.arange(len(codes)) >= hyp.sum(), np.arange(len(codes))
    key, limit, found = sentence * size + base, len(hyp) * size, np.zeros((order, 3), np.int64)
    for n in range(1, order + 1):
        if n > 1:
            stay = ends[at] - at >= n
            at, key = at[stay], key[stay]
            if limit * size >= 1 << 62:
                known, key = np.unique(key, return_inverse=True)
                limit = len(known)
            key, limit = key * size + base[at + n - 1], limit * size
        if not len(at):
            break
        ordered = np.sort(key << 1 | side[at])
        starts = np.flatnonzero(np.concatenate([[True], ordered[1:] >> 1 != ordered[:-1] >> 1]))
        total, refs = np.diff(starts, append=len(ordered)), np.add.reduceat(ordered & 1, starts)
        found[n - 1] = np.minimum(refs, total - refs).sum(), len(ordered) - refs.sum(), refs.sum()
    return found


def _of_tokens(side: pa.Array) -> tuple[pa.Array, np.ndarray]:
    return side.flatten(), pc.fill_null(pc.list_value_length(side), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _of_characters(side: pa.Array) -> tuple[pa.Array, np.ndarray]:
    texts = [t or "" for t in side.to_pylist()]
    return pa.array(np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")), np.array([len(t) for t in texts], np.int64)


def _matches(rows: DataFrame, split: Callable[[Column], Column], items: Callable[[pa.Array], tuple[pa.Array, np.ndarray]], order: int) -> DataFrame:
    """``n, match, hyp, ref``: clipped matches and totals over all sentences, one to a row.

    A sentence's n-grams meet only each other, so they are counted where the row lies; each task passes on ``order`` rows of sums.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((order, 3), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                (h, hyp), (r, ref) = items(part.column(0)), items(part.column(1))
                codes = pa.concat_arrays([h, r])
                if len(codes):
                    sums += overlaps(codes.dictionary_encode().indices.to_numpy(), hyp, ref, order)
        yield pa.RecordBatch.from_pydict({"n": pa.array(range(1, order + 1), pa.int32())} | {c: sums[:, i] for i, c in enumerate(("match", "hyp", "ref"))})

    sides = rows.select(split(F.col("hypothesis")).alias("hypothesis"), split(F.col("reference")).alias("reference"))
    counted = sides.mapInArrow(run, "n int, match long, hyp long, ref long")
    return counted.groupBy("n").agg(*[F.sum(c).alias(c) for c in ("match", "hyp", "ref")]).where("hyp + ref > 0")


def _by_order(stats: DataFrame, order: int) -> DataFrame:
    """One row with ``match_n, hyp_n, ref_n``; orders without grams have zeros."""
    pick = lambda c, n: F.coalesce(F.sum(F.when(F.col("n") == n, F.col(c))), F.lit(0)).alias(f"{c}_{n}")
    return stats.agg(*[pick(c, n) for n in range(1, order + 1) for c in ("match", "hyp", "ref")])


def bleu_stats(rows: DataFrame) -> DataFrame:
    """``n, match, hyp, ref`` of 13a token n-grams for rows of ``index, hypothesis, reference``."""
    return _matches(rows, tokens_13a, _of_tokens, BLEU_ORDER)


def chrf_stats(rows: DataFrame) -> DataFrame:
    return _matches(rows, dark, _of_characters, CHRF_ORDER)


def bleu(rows: DataFrame) -> DataFrame:
    """One row: ``bleu``."""
    one = _by_order(bleu_stats(rows), BLEU_ORDER)
    orders = range(1, BLEU_ORDER + 1)
    empty = reduce(lambda a, n: a & (F.col(f"match_{n}") == 0), orders, F.lit(True))
    # An order without n-grams has a precision of 0, which makes the mean 0.
    empty = reduce(lambda a, n: a | (F.col(f"hyp_{n}") == 0), orders, empty)
    total, halvings = F.lit(0.0), F.lit(0)
    for n in orders:
        match, hyp = F.col(f"match_{n}"), F.col(f"hyp_{n}")
        halvings = halvings + F.when(match == 0, 1).otherwise(0)
        p = F.when(match == 0, 100.0 / (F.pow(F.lit(2.0), halvings) * F.greatest(hyp, F.lit(1)))).otherwise(100.0 * match / F.greatest(hyp, F.lit(1)))
        total = total + F.ln(p)
    brevity = F.when(F.col("hyp_1") >= F.col("ref_1"), 1.0).when(F.col("hyp_1") == 0, 0.0).otherwise(F.exp(1 - F.col("ref_1") / F.col("hyp_1")))
    return one.select(F.when(empty, 0.0).otherwise(brevity * F.exp(total / BLEU_ORDER)).alias("bleu"))


def chrf(rows: DataFrame) -> DataFrame:
    """One row: ``chrf``."""
    one = _by_order(chrf_stats(rows), CHRF_ORDER)
    orders = range(1, CHRF_ORDER + 1)
    used = lambda n: (F.col(f"hyp_{n}") > 0) & (F.col(f"ref_{n}") > 0)
    count = reduce(lambda a, n: a + F.when(used(n), 1).otherwise(0), orders, F.lit(0))
    mean = lambda side: reduce(lambda a, n: a + F.when(used(n), F.col(f"match_{n}") / F.col(f"{side}_{n}")).otherwise(0.0), orders, F.lit(0.0)) / F.greatest(count, F.lit(1))
    p, r = mean("hyp"), mean("ref")
    return one.select(F.when(p + r == 0, 0.0).otherwise(100 * (1 + BETA**2) * p * r / (BETA**2 * p + r)).alias("chrf"))

"""Formulas of the model and training stages as expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EOS, PAD


def inverse_sqrt_lr(step: Column, warmup: int) -> Column:
    """The learning-rate multiplier: rises linearly for ``warmup`` steps, then falls with the square root."""
    s, w = F.greatest(F.lit(1), step).cast("double"), float(max(1, warmup))
    return F.least(F.pow(s, F.lit(-0.5)), s * w**-1.5) * math.sqrt(w)


def length_penalised(score: Column, length: Column, alpha: float) -> Column:
    return score if alpha <= 0 else score / F.pow(F.greatest(F.lit(1), length), F.lit(alpha))


def sequence_length(ids: Column, eos: int = EOS) -> Column:
    """Ids up to the first end id, that one included; all if there is none."""
    at = F.array_position(ids, F.lit(eos))
    return F.when(at == 0, F.size(ids).cast("long")).otherwise(at)


def positional_encoding(position: Column, d_model: int) -> Column:
    """Sines at even, cosines at odd places."""
    angle = lambda i: position * F.exp((i - i % 2) * (-math.log(10000.0) / d_model))
    return F.transform(F.sequence(F.lit(0), F.lit(d_model - 1)), lambda i: F.when(i % 2 == 0, F.sin(angle(i))).otherwise(F.cos(angle(i))))


def log_softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    norm = F.ln(F.aggregate(F.transform(logits, lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x))
    return F.transform(logits, lambda x: x - top - norm)


def token_loss(log_probs: Column, target: Column, smoothing: float) -> Column:
    """Label-smoothed cross-entropy of one token."""
    nll = -F.element_at(log_probs, target + 1)
    spread = -F.aggregate(log_probs, F.lit(0.0), lambda a, x: a + x) / F.size(log_probs)
    return (1 - smoothing) * nll + smoothing * spread


def smoothed_loss(tokens: DataFrame, smoothing: float, group: list[str] | None = None) -> DataFrame:
    """Mean loss over tokens that are no padding: rows of ``logits, target``."""
    losses = tokens.where(F.col("target") != PAD).select(*(group or []), token_loss(log_softmax(F.col("logits")), F.col("target"), smoothing).alias("loss"))
    return losses.groupBy(*(group or [])).agg(F.avg("loss").alias("loss"))


def validation_loss(batch_losses: DataFrame) -> DataFrame:
    """The plain mean of batch losses; infinite without any."""
    return batch_losses.agg(F.coalesce(F.avg("loss"), F.lit(float("inf"))).alias("loss"))


def early_stopping(log: DataFrame, patience: int, group: list[str] | None = None) -> DataFrame:
    """For each validation (``step, loss``): ``best`` so far, ``improved``, ``waited`` (validations since the last improvement) and ``stop``.

    Gaps and islands: an improvement starts an island, and places within it count the wait.
    """
    keys = group or []
    order = Window.partitionBy(*keys).orderBy("step")
    before = F.min("loss").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = log.withColumn("improved", F.coalesce(F.col("loss") < before, F.lit(True))).withColumn("best", F.min("loss").over(order))
    islands = marked.withColumn("_island", F.sum(F.col("improved").cast("int")).over(order))
    waited = islands.withColumn("waited", F.row_number().over(Window.partitionBy(*keys, "_island").orderBy("step")) - 1)
    return waited.withColumn("stop", F.col("waited") >= patience).drop("_island")


def argmax(values: Column) -> Column:
    """The first place (from 0) of the largest element."""
    return F.array_position(values, F.array_max(values)) - 1


def best_hypotheses(beams: DataFrame, alpha: float) -> DataFrame:
    """The best of the hypotheses ``index, beam, tokens, score`` of each sentence by penalised score, the first at ties."""
    penalised = length_penalised(F.col("score"), sequence_length(F.col("tokens")), alpha)
    return beams.groupBy("index").agg(F.max_by(F.struct("beam", "tokens"), F.struct(penalised.alias("p"), (-F.col("beam")).alias("b"))).alias("w")).select("index", "w.beam", "w.tokens")

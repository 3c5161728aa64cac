"""The stages end to end: each reads its inputs, builds one plan, and writes its artifacts."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SPLITS, AuditConfig, CleaningConfig, DecodingConfig, EncodingConfig, PreauditConfig
from ..operators import audit as A
from ..operators import cleaning as C
from ..operators import decoding, encoding, metrics
from ..operators import tokenizer_stats as S
from ..sources import corpus, sinks
from . import reports


def audited_rows(raw: DataFrame) -> DataFrame:
    """Raw rows with a struct as the audit reads them."""
    return raw.select("split", "row_index", F.col("translation").isNotNull().alias("present"), F.col("translation.pl").alias("pl"), F.col("translation.en").alias("en"))


def clean(spark: SparkSession, raw_dir: str, patterns: dict[str, str], out_dir: str, config: CleaningConfig = CleaningConfig(), labels_path: str | None = None, accepted: tuple[int, ...] = C.ACCEPT_GOOD, audit: PreauditConfig = PreauditConfig()) -> dict[str, Any]:
    """Cleans the splits of a folder and writes kept pairs, removed rows, manifest; returns the manifest.

    The classified rows feed three outputs, so they are written once and read back.
    """
    raw = corpus.scan_splits(spark, raw_dir, patterns)
    if labels_path:
        labels = corpus.last_labels(corpus.parse_labels(corpus.numbered_lines(spark, labels_path)))
        classified = C.classify_labelled(audited_rows(raw), labels, config, audit, accepted)
    else:
        classified = C.classify(C.raw_texts(raw), config)
    staging = f"{out_dir}/_classified"
    classified.write.mode("overwrite").parquet(staging)
    stored = spark.read.schema(classified.schema).parquet(staging)
    for s in SPLITS:
        sinks.write_clean(stored.where((F.col("split") == s) & F.col("reason").isNull()), f"{out_dir}/{s}")
    removed = stored.where("reason is not null and not startswith(reason, 'preaudit_')").withColumn("split_rank", F.array_position(F.array(*map(F.lit, SPLITS)), F.col("split")))
    sinks.write_removed(removed, f"{out_dir}/removed")
    return reports.cleaning_manifest(stored, config, {"raw_dir": raw_dir, "processed_dir": out_dir, "removed_examples": f"{out_dir}/removed"}, {"labels": labels_path} if labels_path else None)


def audit(spark: SparkSession, raw: DataFrame, generate: Callable[[str], str], out_dir: str, config: AuditConfig = AuditConfig(), rules: PreauditConfig = PreauditConfig(), resume: bool = False) -> dict[str, Any]:
    """Audits raw rows: rules, batches, prompts, answers, labels.  With ``resume``, batches whose log line is there are not asked again."""
    ruled = C.preaudit(audited_rows(raw), rules)
    kept = ruled.where("reason is null").select("split", "row_index", "pl", "en")
    batched = A.batches(kept, config.batch_max_chars, config.max_rows_per_batch)
    todo = A.prompts(batched)
    log = f"{out_dir}/outcomes"
    if resume:
        todo = A.pending(todo, spark.read.parquet(log))
    attempts = A.validate(A.ask(todo, generate, config))
    attempts_path = f"{out_dir}/attempts"
    attempts.write.mode("append" if resume else "overwrite").parquet(attempts_path)
    # Settled from what is stored: no prompt is sent twice.
    stored = spark.read.schema(attempts.schema).parquet(attempts_path)
    outcomes = A.settle(stored, config.uncertain_ratio_rerun_threshold).join(stored.select("split", "batch_index", "row_ids").dropDuplicates(["split", "batch_index"]), ["split", "batch_index"])
    outcomes.write.mode("overwrite").parquet(log)
    labels = A.expand_labels(spark.read.parquet(log))
    sinks.write_labels(labels, f"{out_dir}/labels")
    dropped = {r["reason"]: r["count"] for r in ruled.where("reason is not null").groupBy("reason").count().collect()}
    counts = {r["split"]: {n: r[n] for n in ("good", "bad", "uncertain")} for r in A.label_counts(labels).collect()}
    return reports.audit_manifest(config, dropped, counts, {"labels": f"{out_dir}/labels", "outcomes": log})


def tokenizer_statistics(pairs: DataFrame, train: DataFrame, encode: S.Encoder, unk: int, vocab_size: int) -> list[str]:
    """The report of the tokenizer stage; only its tables reach the driver."""
    frequencies = S.word_frequencies(train)
    rows = lambda df: [r.asDict() for r in df.collect()]
    stats = {r["split"]: r for r in rows(S.split_stats(pairs, encode, unk))}
    buckets = {r["bucket"]: r for r in rows(S.long_word_stats(frequencies, encode))}
    top = sorted(rows(S.top_long_words(frequencies, encode)), key=lambda r: r["rank"])
    return reports.tokenizer_report([stats[s] for s in SPLITS if s in stats], [buckets[b] for b in S.BUCKETS], top, vocab_size)


def evaluate(pairs: DataFrame, encode: S.Encoder, scorer: decoding.Scorer, detokenise: Callable, config: DecodingConfig = DecodingConfig(), sizes: EncodingConfig = EncodingConfig(), limit: int | None = None) -> DataFrame:
    """Translations of ``row_index, pl, en``: ``index, source_pl, reference_en, hypothesis_en``.  ``detokenise`` maps a column of ids to one of text."""
    rows = corpus.limited(pairs, limit)
    encoded = encoding.encode_pairs(rows, encode).select(F.col("row_index").alias("index"), "src_ids")
    decoded = decoding.decode(encoded, scorer, config, sizes.max_seq_len)
    texts = decoded.select("index", detokenise(encoding.without_specials(F.col("tokens"))).alias("hypothesis_en"))
    return rows.select(F.col("row_index").cast("long").alias("index"), F.col("pl").alias("source_pl"), F.col("en").alias("reference_en")).join(texts, "index")


def scores(translations: DataFrame) -> tuple[float, float]:
    """BLEU and chrF of translations."""
    rows = translations.select("index", F.col("hypothesis_en").alias("hypothesis"), F.col("reference_en").alias("reference"))
    return metrics.bleu(rows).first()[0], metrics.chrf(rows).first()[0]

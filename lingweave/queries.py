"""The registered queries of the corpus operators, over a parallel corpus derived from ``documents``.

A document's first line is the source and the rest the target; its id modulo 10 tells the split.  ``labels`` stands for audit labels.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle
from .config import AuditConfig, CleaningConfig, DecodingConfig, EncodingConfig, PreauditConfig
from .functions import formulas as M
from .functions import text as X
from .operators import audit as A
from .operators import cleaning as C
from .operators import decoding as D
from .operators import encoding as E
from .operators import metrics as B
from .operators import tokenizer_stats as S
from .sources import corpus, sinks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``split, row_index, pl, en`` of the derived corpus; a document of one line has no target."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = F.instr("text", "\n")
    split = F.when(F.col("doc_id") % 10 == 0, "validation").when(F.col("doc_id") % 10 == 1, "test").otherwise("train")
    pl = F.when(cut > 0, F.substr("text", F.lit(1), cut - 1)).otherwise(F.col("text"))
    return docs.select(split.alias("split"), F.col("doc_id").alias("row_index"), pl.alias("pl"), F.when(cut > 0, F.substr("text", cut + 1)).alias("en"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``split, row_index, label``: toxic is bad, quality 1 good, the rest uncertain."""
    rows = table(spark, sf_dir, "labels")
    split = F.when(F.col("doc_id") % 10 == 0, "validation").when(F.col("doc_id") % 10 == 1, "test").otherwise("train")
    label = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).otherwise(1)
    return rows.select(split.alias("split"), F.col("doc_id").alias("row_index"), label.alias("label"))


def label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label lines with repeats, a long form and unknown splits: ``line_no, line``."""
    base = labels(spark, sf_dir)
    short = base.select((F.col("row_index") * 2).alias("line_no"), F.to_json(F.struct(F.when(F.col("row_index") % 50 == 7, "other").otherwise(F.col("split")).alias("s"), F.col("row_index").alias("i"), F.col("label").alias("l"))).alias("line"))
    again = base.where(F.col("row_index") % 7 == 0).select((F.col("row_index") * 2 + 1).alias("line_no"), F.to_json(F.struct("split", "row_index", F.element_at(F.array(F.lit("bad"), F.lit("uncertain"), F.lit("good")), 3 - F.col("label")).alias("label"))).alias("line"))
    return short.unionByName(again)


def present(rows: DataFrame) -> DataFrame:
    return rows.withColumn("present", F.lit(True))


def long(*names: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n) for n in names]


def shown(classified: DataFrame) -> DataFrame:
    return classified.select("split", "row_index", "pl", "en", F.array_join("all_reasons", "|").alias("all_reasons"), F.coalesce("reason", F.lit("")).alias("reason"))


def counts(classified: DataFrame) -> DataFrame:
    return C.reason_counts(classified).select(F.coalesce("split", F.lit("all")).alias("split"), "reason", "n")


NO_FORM = CleaningConfig(unicode_form=None)
ENCODE, ENCODE_UNK = S.length_encoder(), S.length_encoder("the")


def cleaned(**changes) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: shown(C.classify(pairs(spark, d), CleaningConfig(**changes)))


def clean_rollup(spark, d):
    return C.split_totals(C.classify(pairs(spark, d), NO_FORM)).select(F.coalesce("split", F.lit("all")).alias("split"), "rows_in", "rows_out", "removed_total", "retention_ratio")


def clean_reason_maps(spark, d):
    found = C.reason_map(C.classify(pairs(spark, d), NO_FORM))
    entries = F.transform(F.map_entries("primary_reason_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return found.select("split", F.array_join(entries, ",").alias("reasons"))


def scan_pairs(spark, d):
    rows = pairs(spark, d)
    return rows.select("split", "row_index", corpus.stringified(F.col("pl")).alias("pl"), corpus.stringified(F.col("en")).alias("en"))


def normalize_text(spark, d):
    rows = C.normalised(pairs(spark, d), CleaningConfig())
    return rows.select("row_index", "missing", "pl", "en")


def word_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", X.word_count(F.col("text")).cast("long").alias("n_words"), X.word_count_single_spaced(X.normalise(F.col("text"))).cast("long").alias("n_normalised"))


def _sanitised(docs: DataFrame, text: Column) -> DataFrame:
    """The sanitiser on texts with dashes, cues and ellipses worked in."""
    rough = F.concat(F.lit("— [cue] "), F.replace(text, F.lit(", "), F.lit("... ")), F.lit(" 你好 x..."))
    return docs.select("doc_id", X.sanitise(X.drop_bracketed(rough)).alias("clean"))


def sanitize_text(spark, d):
    """As its SQL has it, the first 400 characters alone; ``sanitize_whole_text`` reads all."""
    return _sanitised(table(spark, d, "documents"), F.substr("text", F.lit(1), F.lit(400)))


def sanitize_whole_text(spark, d):
    return _sanitised(table(spark, d, "documents"), F.col("text"))


def preaudit_rows(spark, d):
    return C.preaudit(present(pairs(spark, d))).select("split", "row_index", "pl", "en", F.coalesce("reason", F.lit("")).alias("reason"))


def preaudit_dropped(spark, d):
    dropped = C.preaudit(present(pairs(spark, d))).where("reason is not null")
    return dropped.groupingSets([[F.col("split"), F.col("reason")], [F.col("reason")]], F.col("split"), F.col("reason")).agg(F.count("*").alias("n")).select(F.coalesce("split", F.lit("all")).alias("split"), "reason", "n")


def labelled(accepted):
    def run(spark, d):
        found = C.classify_labelled(present(pairs(spark, d)), labels(spark, d), CleaningConfig(), PreauditConfig(), accepted)
        return shown(found)

    return run


def label_stats(spark, d):
    return A.label_counts(labels(spark, d)).select(F.coalesce("split", F.lit("all")).alias("split"), "good", "bad", "uncertain")


def label_last_wins(spark, d):
    return corpus.last_labels(corpus.parse_labels(label_lines(spark, d))).select("split", "row_index", *long("label"))


def label_load_stats(spark, d):
    return corpus.label_load_stats(corpus.parse_labels(label_lines(spark, d))).select(F.coalesce("split", F.lit("all")).alias("split"), "loaded", "duplicates", "unknown_split")


def label_replay(spark, d):
    return A.replayed(corpus.parse_labels(label_lines(spark, d)).where("split is not null and split <> 'other'")).select("split", "row_index", *long("label"))


def leak_anti_join(spark, d):
    rows = pairs(spark, d).where("en is not null")
    return C.without_leaks(rows.where("split = 'train'"), rows.where("split <> 'train'")).select("row_index")


def heldout_union(spark, d):
    return C.heldout_pairs(pairs(spark, d).where("en is not null")).select(F.md5(X.pair_key(F.col("pl"), F.col("en"))).alias("key"))


AUDIT = AuditConfig(batch_max_chars=4000, max_rows_per_batch=7)


def audited(spark, d) -> DataFrame:
    kept = C.preaudit(present(pairs(spark, d)), PreauditConfig(max_words=10**6, max_length_ratio=1e6)).where("reason is null")
    return A.batches(kept.select("split", "row_index", "pl", "en"), AUDIT.batch_max_chars, AUDIT.max_rows_per_batch)


def audit_batches(spark, d):
    return audited(spark, d).select("split", "row_index", *long("batch_index", "local_id"))


def audit_prompts(spark, d):
    found = A.prompts(audited(spark, d))
    return found.select("split", *long("batch_index", "size"), F.array_join(F.col("row_ids").cast("array<string>"), ",").alias("row_ids"), F.md5(F.substr("prompt", F.lit(len(A.HEADER) + 2))).alias("lines_md5"))


def answers(spark, d) -> DataFrame:
    """Answers to batches of three ids, by document: valid, incomplete, overlapping, foreign, damaged, or with a list missing."""
    raw = F.element_at(
        F.array(*[F.lit(x) for x in ('{"good":[0,1],"bad":[2],"uncertain":[]}', '{"good":[2,0,0],"bad":[],"uncertain":[]}', '{"good":[0],"bad":[0],"uncertain":[1]}', '{"good":[0,9],"bad":[],"uncertain":[]}', "sorry", '{"good":[0],"bad":[1]}', '{"good":[],"bad":[],"uncertain":[1]}')]),
        (F.col("doc_id") % 7 + 1).cast("int"),
    )
    return table(spark, d, "documents").select("doc_id", raw.alias("raw"), F.array(*[F.lit(i) for i in range(3)]).alias("ids"))


def _lists(df: DataFrame, *names: str) -> list[Column]:
    return [F.coalesce(F.array_join(F.col(n).cast("array<string>"), ","), F.lit("-")).alias(n) for n in names]


def audit_validate(spark, d):
    found = A.validate(answers(spark, d))
    return found.select("doc_id", F.coalesce("error", F.lit("")).alias("error"), *_lists(found, "good", "bad", "uncertain"))


def attempts(spark, d) -> DataFrame:
    checked = A.validate(answers(spark, d))
    return checked.select(F.lit("train").alias("split"), (F.col("doc_id") / 3).cast("long").alias("batch_index"), (F.col("doc_id") % 3 + 1).alias("attempt"), "ids", "error", "good", "bad", "uncertain")


def audit_settle(spark, d):
    found = A.settle(attempts(spark, d), 0.4)
    return found.select("split", "batch_index", *long("attempts"), *_lists(found, "good", "bad", "uncertain"))


def outcome_labels(spark, d) -> DataFrame:
    settled = A.settle(attempts(spark, d), 0.4)
    rows = F.transform("ids", lambda i: F.col("batch_index") * 3 + i)
    return A.expand_labels(settled.withColumn("row_ids", rows))


def audit_labels(spark, d):
    return outcome_labels(spark, d).select("split", "row_index", *long("label"))


def audit_running_totals(spark, d):
    rows = labels(spark, d).withColumn("batch_index", (F.col("row_index") / 25).cast("long"))
    return A.running_totals(rows).select("split", "batch_index", "good", "bad", "uncertain")


def audit_rewind(spark, d):
    lines = labels(spark, d).withColumn("line_no", F.col("row_index"))
    log = labels(spark, d).where("row_index % 5 = 0").select((F.col("row_index") + 1).alias("line_no"), "split", (F.col("row_index") / 5).cast("int").alias("batch_index"), F.lit(4).alias("size"))
    left, kept = A.rewind(lines, log, "train")
    return left.select("split", "row_index").unionByName(kept.select(F.concat(F.lit("log-"), "split").alias("split"), F.col("line_no").alias("row_index")))


def audit_resume(spark, d):
    return A.resume_from(audited(spark, d).select("split", *long("batch_index")).distinct(), AUDIT.order, "test", 2)


def audit_rerun(spark, d):
    rows = table(spark, d, "labels").select("doc_id", (F.col("doc_id") % 9).alias("uncertain"), (F.col("doc_id") % 11).alias("total"))
    return rows.select("doc_id", A.needs_rerun(F.col("uncertain"), F.col("total"), 0.4).alias("rerun"), A.uncertain_ratio(F.col("uncertain"), F.col("total")).alias("ratio"))


def audit_bad_sentences(spark, d):
    joined = pairs(spark, d).join(labels(spark, d), ["split", "row_index"])
    return sinks.bad_sentences(joined).select("split", "count", F.json_array_length("records").cast("long").alias("records"), F.get_json_object("records", "$[0].row_index").cast("long").alias("first_row"))


def word_freq(spark, d):
    return S.word_frequencies(train(spark, d)).select("word", "cnt", "first_row", *long("first_side", "first_place"))


def train(spark, d) -> DataFrame:
    return scan_pairs(spark, d).where("split = 'train'")


def split_token_stats(spark, d):
    found = S.split_stats(scan_pairs(spark, d), ENCODE_UNK)
    return found.select("split", "rows", "words", "pieces", "unk", F.round("mean_pieces", 6).alias("mean_pieces"), "p95_pieces", F.round("pieces_per_word", 6).alias("pieces_per_word"), F.round("unk_rate", 6).alias("unk_rate"))


def long_word_buckets(spark, d):
    return S.long_word_stats(S.word_frequencies(train(spark, d)), char_encoder).select("bucket", "types", F.round("mean_pieces", 6).alias("mean_pieces"), "p95_pieces")


def char_encoder(c: Column) -> Column:
    """One id for each three characters: words of other lengths get other numbers of pieces."""
    return F.sequence(F.lit(0), F.floor((F.length(c) - 1) / 3).cast("int"))


def top_long_words(spark, d):
    return S.top_long_words(S.word_frequencies(train(spark, d)), char_encoder).select(*long("rank"), "word", "cnt", *long("pieces"))


def bpe_pairs(spark, d):
    """The 25 most frequent pairs, as the SQL has them; ``bpe_pairs_all`` has all."""
    return bpe_pairs_all(spark, d).orderBy(F.desc("n"), "left", "right").limit(25)


def bpe_pairs_all(spark, d):
    return S.pair_counts(S.symbols(S.word_frequencies(train(spark, d))))


def corpus_lines(spark, d):
    return sinks.corpus_lines(train(spark, d)).select("row_index", *long("side"), "line")


def row_counts(spark, d):
    return pairs(spark, d).groupBy("split").agg(F.count("*").alias("n"), (2 * F.count("*")).alias("lines"))


def limited_scan(spark, d):
    return corpus.limited(scan_pairs(spark, d), 100).select("split", "row_index")


SIZES = EncodingConfig(max_seq_len=128)


def _ids(*names: str) -> list[Column]:
    return [F.array_join(F.col(n).cast("array<string>"), ",").alias(n) for n in names]


def encode_examples(spark, d):
    return E.examples(train(spark, d), ENCODE_UNK, SIZES).select("row_index", *_ids("src_ids", "tgt_in_ids", "tgt_out_ids"))


def overlength_stats(spark, d):
    return E.load_stats(train(spark, d), ENCODE, SIZES)


def batched(spark, d) -> DataFrame:
    return E.chunked(E.examples(train(spark, d), ENCODE, SIZES), 48)


def collate_padded(spark, d):
    found = E.pad_batches(batched(spark, d), 8)
    return found.select("row_index", "batch_id", *_ids("src_ids", "tgt_in_ids", "tgt_out_ids"))


def source_padding(spark, d):
    return E.pad_batches(batched(spark, d), None, ("src_ids",)).select("row_index", *_ids("src_ids"))


def pad_masks(spark, d):
    found = E.pad_batches(batched(spark, d), 8)
    bits = lambda c: F.array_join(E.pad_mask(F.col(c)).cast("array<int>").cast("array<string>"), "")
    return found.select("row_index", bits("src_ids").alias("src_pad"), bits("tgt_in_ids").alias("tgt_pad"))


def collate_batches(spark, d):
    found = E.collate(batched(spark, d), 8)
    width = lambda c: F.size(F.get(c, F.lit(0))).cast("long")
    return found.select("batch_id", F.size("src").cast("long").alias("n"), width("src").alias("src_width"), width("tgt_in").alias("tgt_width"), F.size("causal").cast("long").alias("causal"))


def _bits(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda r: F.array_join(r.cast("array<int>").cast("array<string>"), "")), "|")


def causal_mask(spark, d):
    return spark.range(1, 13).select(F.col("id").alias("size"), _bits(E.causal_mask(F.col("id").cast("int"))).alias("mask"))


def attention_masks(spark, d):
    pads = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: i > F.col("id"))
    src, tgt = E.attention_masks(F.col("pads"), F.col("pads"))
    return spark.range(1, 7).select("id", pads.alias("pads")).select("id", F.array_join(src.cast("array<int>").cast("array<string>"), "").alias("src"), _bits(tgt).alias("tgt"))


def translations(spark, d) -> DataFrame:
    """Hypothesis and reference: a document's first and second line, as the SQL has them; ``whole_translations`` takes all lines."""
    lines = F.split("text", "\n")
    return table(spark, d, "documents").select(F.col("doc_id").alias("index"), F.coalesce(F.get(lines, F.lit(0)), F.lit("")).alias("hypothesis"), F.coalesce(F.get(lines, F.lit(1)), F.lit("")).alias("reference"))


def whole_translations(spark, d) -> DataFrame:
    """Hypothesis and reference: a document's lines in turn, so that all of them are scored."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    side = lambda k: F.array_join(F.filter(lines, lambda _, i: i % 2 == k), "\n")
    return table(spark, d, "documents").select(F.col("doc_id").alias("index"), side(0).alias("hypothesis"), side(1).alias("reference"))


def bleu_stats(rows: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: B.bleu_stats(rows(spark, d)).select(*long("n", "match", "hyp", "ref"))


def chrf_stats(rows: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: B.chrf_stats(rows(spark, d)).select(*long("n", "match", "hyp", "ref"))


def bleu_score(rows: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: B.bleu(rows(spark, d)).select(F.round("bleu", 6).alias("bleu"))


def chrf_score(rows: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: B.chrf(rows(spark, d)).select(F.round("chrf", 6).alias("chrf"))


def lr_schedule(spark, d):
    return spark.range(0, 20001, 250).select(F.col("id").alias("step"), F.round(M.inverse_sqrt_lr(F.col("id"), 4000), 9).alias("multiplier"))


def length_penalty(spark, d):
    rows = table(spark, d, "events").select("event_id", "value", (F.col("event_id") % 40).alias("n"))
    return rows.select("event_id", F.round(M.length_penalised(F.col("value"), F.col("n"), 0.7), 6).alias("score"))


def sequence_lengths(spark, d):
    ids = F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: ((F.col("doc_id") * i + i) % 9).cast("int"))
    return table(spark, d, "documents").select("doc_id", M.sequence_length(ids).alias("length"))


def positional_encoding(spark, d):
    return spark.range(16).select(F.col("id").alias("position"), F.posexplode(M.positional_encoding(F.col("id"), 8)).alias("place", "value")).select("position", *long("place"), F.round("value", 6).alias("value"))


def _logits(spark, d) -> DataFrame:
    """Ten components of each vector, as the SQL has them; ``_whole_logits`` takes all."""
    e = table(spark, d, "embeddings").where("embedding is not null")
    return _tokens(e, F.slice("embedding", 1, 10), F.lit(10))


def _whole_logits(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings").where("size(embedding) > 0")
    return _tokens(e, F.col("embedding"), F.size("embedding"))


def _tokens(e: DataFrame, values: Column, n: Column) -> DataFrame:
    return e.select("vec_id", F.transform(values, lambda x: x.cast("double") * 8).alias("logits"), (F.col("vec_id") % n).cast("int").alias("target"), (F.col("vec_id") % 4).alias("batch"))


def label_smoothed_ce(logits: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: M.smoothed_loss(logits(spark, d), 0.1, ["batch"]).select("batch", F.round("loss", 6).alias("loss"))


def validation_loss(logits: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: M.validation_loss(M.smoothed_loss(logits(spark, d), 0.1, ["batch"])).select(F.round("loss", 6).alias("loss"))


def greedy_argmax(logits: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: logits(spark, d).select("vec_id", M.argmax(F.col("logits")).alias("best"))


def early_stopping(spark, d):
    log = table(spark, d, "events").select("user_id", F.col("event_id").alias("step"), F.col("value").alias("loss"))
    found = M.early_stopping(log, 3, ["user_id"])
    return found.select("user_id", "step", "improved", *long("waited"), "stop")


def best_hypothesis(spark, d):
    rows = table(spark, d, "events").select((F.col("event_id") / 5).cast("long").alias("index"), (F.col("event_id") % 5).alias("beam"), (-F.abs("value")).alias("score"), F.concat(F.array_repeat(F.lit(7), (F.col("event_id") % 6).cast("int")), F.array(F.lit(3))).alias("tokens"))
    return M.best_hypotheses(rows, 1.0).select("index", "beam")


#: A table of log-probabilities over six ids, by the last id.
TABLE = np.log(np.array([[1, 1, 1, 3, 2, 2], [1, 1, 1, 1, 4, 2], [1, 1, 1, 1, 2, 4], [1, 1, 1, 5, 1, 1], [1, 1, 1, 2, 1, 4], [1, 1, 1, 3, 3, 1]], float) / 10)


def table_decode(beam: int):
    def run(spark, d):
        rows = table(spark, d, "documents").select(F.col("doc_id").alias("index"), F.array(F.lit(4), (F.col("doc_id") % 3 + 4).cast("int")).alias("src_ids"))
        found = D.decode(rows, D.TableScorer(TABLE), DecodingConfig(beam_size=beam, max_new_tokens=8), 16)
        return found.select("index", F.array_join(F.col("tokens").cast("array<string>"), ",").alias("tokens"))

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "scan_pairs": scan_pairs,
    "limited_scan": limited_scan,
    "row_counts": row_counts,
    "normalize_text": normalize_text,
    "word_counts": word_counts,
    "sanitize_text": sanitize_text,
    "sanitize_whole_text": sanitize_whole_text,
    "clean_reason_counts": lambda spark, d: counts(C.classify(pairs(spark, d), CleaningConfig())),
    "clean_global": cleaned(),
    "clean_split_scope": cleaned(dedup_scope="split"),
    "clean_train_first": cleaned(heldout_first=False),
    "clean_keep_leaks": cleaned(remove_leaked_train_pairs=False, min_words=5),
    "clean_rollup": clean_rollup,
    "clean_reason_maps": clean_reason_maps,
    "preaudit_rows": preaudit_rows,
    "preaudit_dropped": preaudit_dropped,
    "label_filter_good": labelled(C.ACCEPT_GOOD),
    "label_filter_keep_uncertain": labelled(C.ACCEPT_GOOD_AND_UNCERTAIN),
    "label_stats": label_stats,
    "label_last_wins": label_last_wins,
    "label_load_stats": label_load_stats,
    "label_replay": label_replay,
    "leak_anti_join": leak_anti_join,
    "heldout_union": heldout_union,
    "audit_batches": audit_batches,
    "audit_prompts": audit_prompts,
    "audit_validate": audit_validate,
    "audit_settle": audit_settle,
    "audit_labels": audit_labels,
    "audit_running_totals": audit_running_totals,
    "audit_rewind": audit_rewind,
    "audit_resume": audit_resume,
    "audit_rerun": audit_rerun,
    "audit_bad_sentences": audit_bad_sentences,
    "word_freq": word_freq,
    "split_token_stats": split_token_stats,
    "long_word_buckets": long_word_buckets,
    "top_long_words": top_long_words,
    "bpe_pairs": bpe_pairs,
    "bpe_pairs_all": bpe_pairs_all,
    "corpus_lines": corpus_lines,
    "encode_examples": encode_examples,
    "overlength_stats": overlength_stats,
    "collate_padded": collate_padded,
    "collate_batches": collate_batches,
    "source_padding": source_padding,
    "pad_masks": pad_masks,
    "causal_mask": causal_mask,
    "attention_masks": attention_masks,
    "bleu_stats": bleu_stats(translations),
    "bleu_stats_whole": bleu_stats(whole_translations),
    "bleu_score": bleu_score(translations),
    "bleu_score_whole": bleu_score(whole_translations),
    "chrf_stats": chrf_stats(translations),
    "chrf_stats_whole": chrf_stats(whole_translations),
    "chrf_score": chrf_score(translations),
    "chrf_score_whole": chrf_score(whole_translations),
    "lr_schedule": lr_schedule,
    "length_penalty": length_penalty,
    "sequence_lengths": sequence_lengths,
    "positional_encoding": positional_encoding,
    "label_smoothed_ce": label_smoothed_ce(_logits),
    "label_smoothed_ce_whole": label_smoothed_ce(_whole_logits),
    "validation_loss": validation_loss(_logits),
    "validation_loss_whole": validation_loss(_whole_logits),
    "greedy_argmax": greedy_argmax(_logits),
    "greedy_argmax_whole": greedy_argmax(_whole_logits),
    "early_stopping": early_stopping,
    "best_hypothesis": best_hypothesis,
    "greedy_table_decode": table_decode(1),
    "beam_table_decode": table_decode(3),
}

ORACLE_SQL: dict[str, str] = oracle.SQL

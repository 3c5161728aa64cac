"""Command line: ``python -m lingweave.cli STAGE --config FILE``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from . import config as K
from .operators.audit import http_generate
from .operators.cleaning import ACCEPT_GOOD, ACCEPT_GOOD_AND_UNCERTAIN
from .operators.tokenizer_stats import sentencepiece_detokeniser, sentencepiece_encoder
from .plans import reports, stages
from .sources import corpus, sinks


def patterns(config: dict) -> dict[str, str]:
    return {s: K.get_nested(config, f"dataset.splits.{s}_pattern", f"{s}-*.parquet") for s in K.SPLITS}


def run_clean(spark: SparkSession, config: dict, args: argparse.Namespace) -> None:
    manifest = stages.clean(spark, config["paths"]["raw_data_dir"], patterns(config), config["paths"]["processed_data_dir"], K.cleaning_config(config), args.labels, ACCEPT_GOOD_AND_UNCERTAIN if args.keep_uncertain else ACCEPT_GOOD, K.preaudit_config(config))
    sinks.write_json(manifest, K.get_nested(config, "stage2_cleaning.outputs.manifest_json", "reports/cleaning_manifest.json"))
    sinks.write_lines(K.get_nested(config, "stage2_cleaning.outputs.report_md", "reports/cleaning_report.md"), reports.cleaning_report(manifest))


def run_audit(spark: SparkSession, config: dict, args: argparse.Namespace) -> None:
    settings = K.audit_config(config)
    raw = corpus.scan_splits(spark, config["paths"]["raw_data_dir"], patterns(config), settings.order)
    manifest = stages.audit(spark, raw, http_generate(settings), f"{config['paths']['reports_dir']}/audit", settings, K.preaudit_config(config), args.resume)
    sinks.write_json(manifest, K.get_nested(config, "stage1_audit.outputs.manifest_json", "reports/data_audit_manifest.json"))
    sinks.write_lines(K.get_nested(config, "stage1_audit.outputs.report_md", "reports/data_audit.md"), reports.audit_report(manifest))


def run_tokenizer(spark: SparkSession, config: dict, args: argparse.Namespace) -> None:
    from pyspark.sql import functions as F

    folder = config["paths"]["processed_data_dir"]
    parts = {s: corpus.scan_pairs(spark, f"{folder}/{s}").withColumn("split", F.lit(s)) for s in K.SPLITS}
    pairs = parts["train"].unionByName(parts["validation"]).unionByName(parts["test"])
    sinks.write_corpus(parts["train"], K.get_nested(config, "stage3_tokenizer.outputs.training_corpus", "tokenizers/corpus"))
    report = stages.tokenizer_statistics(pairs, parts["train"], sentencepiece_encoder(args.tokenizer), K.UNK, K.get_nested(config, "stage3_tokenizer.vocab_size", 0))
    sinks.write_lines(K.get_nested(config, "stage3_tokenizer.outputs.report_md", "reports/tokenizer_stats.md"), report)


def run_translate(config: dict, args: argparse.Namespace) -> None:
    """One text, or all of standard input as one; ``--interactive`` takes line by line."""
    import sentencepiece

    from .operators.transformer import load_model
    from .plans import translation

    model = load_model(translation.checkpoint_path(config, args.checkpoint))
    tokenizer = sentencepiece.SentencePieceProcessor(model_file=args.tokenizer or translation.tokenizer_path(config))
    decoding = K.DecodingConfig(beam_size=args.beam_size, length_penalty=args.length_penalty, max_new_tokens=args.max_new_tokens)
    one = lambda text: translation.translate(text, tokenizer, model, decoding, model.config.max_seq_len, args.decode == "greedy")
    if args.interactive:
        translation.translate_lines(sys.stdin, one)
    else:
        print(one(args.text if args.text is not None else sys.stdin.read().strip()))


def run_evaluate(spark: SparkSession, config: dict, args: argparse.Namespace) -> None:
    """Translates the cleaned test split and writes translations, samples and scores."""
    from dataclasses import replace

    from .operators.transformer import load_model
    from .plans import translation

    eval_of = lambda name, default: K.get_nested(config, f"stage7_eval.{name}", default)
    path, tokenizer = translation.checkpoint_path(config, args.checkpoint), args.tokenizer or translation.tokenizer_path(config)
    model, split = load_model(path), f"{config['paths']['processed_data_dir']}/test"
    decoding = K.DecodingConfig(**{k: eval_of(k, d) for k, d in vars(K.DecodingConfig()).items()})
    decoding = replace(decoding, max_new_tokens=min(decoding.max_new_tokens, model.config.max_seq_len - 1), beam_size=1 if args.decode == "greedy" else decoding.beam_size)
    sizes = replace(K.EncodingConfig(), max_seq_len=model.config.max_seq_len)
    found = stages.evaluate(corpus.numbered_pairs(spark, split), sentencepiece_encoder(tokenizer), model, sentencepiece_detokeniser(tokenizer), decoding, sizes, args.limit)
    target = eval_of("outputs.translations_tsv", "reports/translations/test_translations.tsv")
    sinks.write_translations(found, target)
    # Decoding is dear, so what was written is what is scored.
    kept = sinks.read_translations(spark, target, found.schema)
    bleu, chrf = stages.scores(kept)
    samples = kept.orderBy("index").limit(eval_of("num_sample_translations", 100)).collect()
    sinks.write_lines(eval_of("outputs.samples_md", "reports/translations/sample_translations.md"), reports.samples_report([r.asDict() for r in samples]))
    settings = vars(decoding) | {"decode": args.decode, "checkpoint": path, "test_split": split}
    sinks.write_json(reports.metrics(bleu, chrf, settings, kept.count()), eval_of("outputs.metrics_json", "reports/eval_metrics.json"), sort=True)


STAGES = {"audit": ("stage1_audit", run_audit), "clean": ("stage2_cleaning", run_clean), "tokenizer": ("stage3_tokenizer", run_tokenizer), "evaluate": ("stage7_eval", run_evaluate)}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lingweave", description=__doc__)
    p.add_argument("stage", choices=sorted([*STAGES, "translate"]))
    p.add_argument("--config", default="configs/project_config.yaml")
    p.add_argument("--labels", help="audit labels to clean by")
    p.add_argument("--keep-uncertain", action="store_true")
    p.add_argument("--resume", action="store_true")
    p.add_argument("--tokenizer", help="a SentencePiece model")
    p.add_argument("--limit", type=int, help="evaluate: the first rows alone")
    p.add_argument("--checkpoint", help="translate, evaluate: a model other than the configured one")
    p.add_argument("--text", help="translate: the text; without it, standard input")
    p.add_argument("--interactive", action="store_true")
    p.add_argument("--decode", choices=("beam", "greedy"), default="beam")
    p.add_argument("--beam-size", type=int, default=K.DecodingConfig.beam_size)
    p.add_argument("--length-penalty", type=float, default=K.DecodingConfig.length_penalty)
    p.add_argument("--max-new-tokens", type=int, default=K.DecodingConfig.max_new_tokens)
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    config = K.load_config(args.config)
    if args.stage == "translate":
        return run_translate(config, args)
    name, run = STAGES[args.stage]
    K.stages(config).require(name)
    run(SparkSession.builder.appName(f"lingweave-{args.stage}").getOrCreate(), config, args)


if __name__ == "__main__":
    main()

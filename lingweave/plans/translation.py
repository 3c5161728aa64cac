"""Translating single texts: where model and tokenizer lie, one text, and lines as they come."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable
from pathlib import Path
from typing import Any, TextIO

from ..config import BOS, EOS, PAD, DecodingConfig, get_nested
from ..operators.decoding import Scorer, beam_one, greedy_one, pad_sources


def checkpoint_path(config: dict[str, Any], given: str | None = None) -> str:
    """The checkpoint asked for, else the exported one where it exists, else the best of training."""
    exported = get_nested(config, "stage7_eval.inference_checkpoint", "checkpoints/model_inference.pt")
    return given or (exported if Path(exported).exists() else get_nested(config, "stage6_train.output_best_checkpoint", "checkpoints/model_best.pt"))


def tokenizer_path(config: dict[str, Any], saved: str | None = None) -> str:
    """The tokenizer that a checkpoint names, else the configured one."""
    return saved or str(Path(get_nested(config, "stage3_tokenizer.model_prefix", "tokenizers/spm_pl_en")).with_suffix(".model"))


def latest_audit_folder(reports_dir: str, labels: str = "llm_audit_labels.jsonl") -> str:
    """Where an audit resumes: the reports folder if labels lie in it, else the last audit folder by name that holds labels, else the reports folder."""
    root = Path(reports_dir)
    held = sorted((p for p in root.glob("llm_audit_*") if (p / labels).exists()), key=lambda p: p.name)
    return str(held[-1] if held and not (root / labels).exists() else root)


def translate(text: str, tokenizer: Any, scorer: Scorer, config: DecodingConfig = DecodingConfig(), max_seq_len: int = 128, greedy: bool = False) -> str:
    """One text through a SentencePiece processor (or its like) and a scorer; a source longer than the model allows is an error."""
    source = [*tokenizer.encode(text), EOS]
    if len(source) > max_seq_len:
        raise ValueError(f"the source has {len(source)} ids, the model allows {max_seq_len}")
    step, most = scorer(pad_sources([source])), min(config.max_new_tokens, max_seq_len - 1)
    found = greedy_one(step, most) if greedy else beam_one(step, most, config)
    return str(tokenizer.decode([i for i in found if i not in (PAD, BOS, EOS)]))


def translate_lines(lines: Iterable[str], one: Callable[[str], str], out: TextIO | None = None, err: TextIO | None = None) -> None:
    """Translates each line that is not empty as it comes; one that fails is reported and the next goes on."""
    for line in lines:
        if text := line.strip():
            try:
                print(one(text), file=out or sys.stdout, flush=True)
            except ValueError as wrong:
                print(wrong, file=err or sys.stderr, flush=True)

"""Manifests and Markdown reports, rendered by the driver from small aggregates."""

from __future__ import annotations

from dataclasses import asdict
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame

from ..config import SPLITS, AuditConfig, CleaningConfig
from ..operators.cleaning import reason_counts, split_totals


def now() -> str:
    return datetime.now(timezone.utc).isoformat()


def cleaning_manifest(classified: DataFrame, config: CleaningConfig, paths: dict[str, str], audit: dict[str, Any] | None = None) -> dict[str, Any]:
    """Totals, reasons and settings of a cleaning run, splits in report order."""
    totals = {r["split"]: r.asDict() for r in split_totals(classified).collect()}
    reasons: dict = {}
    for r in reason_counts(classified).collect():
        reasons.setdefault(r["split"], {})[r["reason"]] = r["n"]
    over_all = totals.get(None, {"rows_in": 0, "rows_out": 0, "removed_total": 0, "retention_ratio": 0.0})
    return {
        "generated_at_utc": now(),
        **paths,
        "audit_meta": audit or {},
        "config": asdict(config),
        "totals": {"rows_in": over_all["rows_in"], "rows_out": over_all["rows_out"], "rows_removed": over_all["removed_total"], "retention_ratio": over_all["retention_ratio"], "primary_reason_counts": dict(sorted(reasons.get(None, {}).items()))},
        "splits": [{**{k: totals[s][k] for k in ("split", "rows_in", "rows_out", "removed_total")}, "primary_reason_counts": dict(sorted(reasons.get(s, {}).items()))} for s in SPLITS if s in totals],
    }


def cleaning_report(manifest: dict[str, Any]) -> list[str]:
    c, t = manifest["config"], manifest["totals"]
    out = ["# Data cleaning report", "", f"Generated at (UTC): `{manifest['generated_at_utc']}`", "", "## Config", ""]
    out += [f"- {k}: {v}" for k, v in c.items()]
    out += ["", "## Totals", "", f"- Rows in: {t['rows_in']}", f"- Rows out: {t['rows_out']}", f"- Rows removed: {t['rows_removed']}", f"- Retention ratio: {t['retention_ratio']}", f"- Primary reason counts: {t['primary_reason_counts']}"]
    for s in manifest["splits"]:
        out += ["", f"## Split: {s['split']}", "", f"- Rows in: {s['rows_in']}", f"- Rows out: {s['rows_out']}", f"- Rows removed: {s['removed_total']}", f"- Primary reason counts: {s['primary_reason_counts']}"]
    return out


def audit_manifest(config: AuditConfig, dropped: dict[str, int], counts: dict[str | None, dict[str, int]], artifacts: dict[str, str]) -> dict[str, Any]:
    total = counts.get(None, {"good": 0, "bad": 0, "uncertain": 0})
    return {"generated_at_utc": now(), "llm": asdict(config), "totals": {"preaudit_dropped": dict(sorted(dropped.items())), **total}, "splits": {s: counts[s] for s in config.order if s in counts}, "artifacts": artifacts}


def audit_report(manifest: dict[str, Any]) -> list[str]:
    t = manifest["totals"]
    out = ["# Data audit", "", f"Generated at (UTC): `{manifest['generated_at_utc']}`", "", f"- Model: {manifest['llm']['model']}", f"- Dropped before the audit: {t['preaudit_dropped']}", f"- Good: {t['good']}", f"- Bad: {t['bad']}", f"- Uncertain: {t['uncertain']}", "", "| split | good | bad | uncertain |", "|---|---|---|---|"]
    return out + [f"| {s} | {c['good']} | {c['bad']} | {c['uncertain']} |" for s, c in manifest["splits"].items()]


def tokenizer_report(stats: list[dict], long_words: list[dict], top: list[dict], vocab_size: int) -> list[str]:
    out = ["# Tokenizer statistics", "", f"Vocabulary: {vocab_size}", "", "| split | rows | words | pieces | pieces per word | mean | p95 | unknown rate |", "|---|---|---|---|---|---|---|---|"]
    out += [f"| {s['split']} | {s['rows']} | {s['words']} | {s['pieces']} | {s['pieces_per_word']:.3f} | {s['mean_pieces']:.2f} | {s['p95_pieces']:.0f} | {s['unk_rate']:.6f} |" for s in stats]
    out += ["", "## Long words by frequency", "", "| bucket | types | mean pieces | p95 |", "|---|---|---|---|"]
    out += [f"| {b['bucket']} | {b['types']} | {b['mean_pieces']:.2f} | {b['p95_pieces']:.0f} |" for b in long_words]
    out += ["", "## Most frequent long words", "", "| word | count | pieces |", "|---|---|---|"]
    return out + [f"| {w['word']} | {w['cnt']} | {w['pieces']} |" for w in top]


def samples_report(rows: list[dict]) -> list[str]:
    out = ["# Sample translations"]
    for r in rows:
        out += ["", f"## {r['index']}", "", f"- Source: {r['source_pl']}", f"- Reference: {r['reference_en']}", f"- Hypothesis: {r['hypothesis_en']}"]
    return out


def metrics(bleu: float, chrf: float, config: dict[str, Any], rows: int) -> dict[str, Any]:
    return {"sacrebleu": bleu, "chrf": chrf, "rows": rows, "decoding": config}

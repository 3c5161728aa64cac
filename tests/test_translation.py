import io
import json

import numpy as np
import pytest

from lingweave import cli, config as K
from lingweave.operators import transformer as T
from lingweave.operators.decoding import TableScorer
from lingweave.plans import translation as L
from lingweave.sources import sinks

T_ROWS = "index long, source_pl string, reference_en string, hypothesis_en string"


class Letters:
    """Letters from ``a`` are ids from 4."""

    def encode(self, text):
        return [ord(c) - 93 for c in text]

    def decode(self, ids):
        return "".join(chr(i + 93) for i in ids)


def chain():
    """After the start comes ``a``, then ``b``, then the end."""
    table = np.full((8, 8), -9.0)
    for at, to in ((K.BOS, 4), (4, 5), (5, K.EOS)):
        table[at, to] = -0.1
    return TableScorer(table)


@pytest.mark.parametrize("greedy", [True, False])
def test_translate(greedy):
    assert L.translate("abc", Letters(), chain(), greedy=greedy) == "ab"
    with pytest.raises(ValueError):
        L.translate("abcabcab", Letters(), chain(), max_seq_len=8, greedy=greedy)


def test_lines_go_on_after_an_error():
    out, err = io.StringIO(), io.StringIO()
    L.translate_lines(["abc\n", " \n", "a" * 20, "b"], lambda t: L.translate(t, Letters(), chain(), max_seq_len=8), out, err)
    assert out.getvalue() == "ab\nab\n" and "21 ids" in err.getvalue()


def test_where_things_lie(tmp_path):
    exported = tmp_path / "inference.npz"
    config = {"stage7_eval": {"inference_checkpoint": str(exported)}, "stage6_train": {"output_best_checkpoint": "best.npz"}, "stage3_tokenizer": {"model_prefix": "tok/spm"}}
    assert L.checkpoint_path(config) == "best.npz" and L.checkpoint_path(config, "own.npz") == "own.npz"
    exported.write_bytes(b"")
    assert L.checkpoint_path(config) == str(exported)
    assert L.tokenizer_path(config) == "tok/spm.model" and L.tokenizer_path(config, "saved.model") == "saved.model"


def test_latest_audit_folder(tmp_path):
    assert L.latest_audit_folder(str(tmp_path)) == str(tmp_path)
    for name, labels in (("llm_audit_1", True), ("llm_audit_2", True), ("llm_audit_3", False)):
        (tmp_path / name).mkdir()
        if labels:
            (tmp_path / name / "llm_audit_labels.jsonl").write_text("")
    assert L.latest_audit_folder(str(tmp_path)) == str(tmp_path / "llm_audit_2")
    (tmp_path / "llm_audit_labels.jsonl").write_text("")
    assert L.latest_audit_folder(str(tmp_path)) == str(tmp_path)


def test_runtime_settings():
    r = K.runtime_settings({"stage6_train": {"num_epochs": 12}}, overfit_samples=4)
    assert (r.mode, r.micro_batch_size, r.grad_accum_steps, r.num_epochs, r.max_steps, r.validate_every_steps, r.dropout, r.shuffle_train, r.warmup_steps, r.early_stopping_patience) == ("overfit", 4, 1, 200, 200, 25, 0.0, False, 1, None)
    r = K.runtime_settings({"stage5_model": {"preset": "big", "presets": {"big": {"dropout": 0.2}}}, "stage6_train": {"early_stopping_patience": 7, "weight_decay": 0, "mode": "x"}, "stage4_dataloader": {"num_workers": "2", "max_seq_len": 9}})
    assert (r.mode, r.early_stopping_patience, r.dropout, r.weight_decay, r.num_workers, r.num_epochs, r.max_steps) == ("full", 7, 0.2, 0.0, 2, 12, None)
    assert K.runtime_settings({"stage6_train": {"early_stopping_patience": None}}).early_stopping_patience is None
    for bad in ({"overfit_samples": 0}, {"overfit_samples": 1, "overfit_max_steps": 0}):
        with pytest.raises(ValueError):
            K.runtime_settings({}, **bad)


def test_command(tmp_path, monkeypatch, capsys):
    sentencepiece = pytest.importorskip("sentencepiece")
    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", lambda model_file: Letters())
    T.save_model(T.Transformer(T.ModelConfig(20, 20, d_model=8, nhead=2, encoder_layers=1, decoder_layers=1, feedforward=8, max_seq_len=8)), str(tmp_path / "m.npz"))
    (tmp_path / "c.yaml").write_text("paths: {}\n")
    monkeypatch.setattr("sys.stdin", io.StringIO("ab\nabc\n"))
    cli.main(["translate", "--config", str(tmp_path / "c.yaml"), "--checkpoint", str(tmp_path / "m.npz"), "--interactive", "--decode", "greedy"])
    assert capsys.readouterr().out.count("\n") == 2


def test_evaluation_command(spark, tmp_path):
    model = "/opt/tokenizers/piece_bpe_32k.model"
    sentencepiece = pytest.importorskip("sentencepiece")
    size = sentencepiece.SentencePieceProcessor(model_file=model).get_piece_size()
    T.save_model(T.Transformer(T.ModelConfig(size, size, d_model=8, nhead=2, encoder_layers=1, decoder_layers=1, feedforward=8, max_seq_len=16)), str(tmp_path / "m.npz"))
    spark.createDataFrame([("ala", "alice"), ("pies", "dog"), ("kot", "cat")], "pl string, en string").repartition(3).write.parquet(str(tmp_path / "clean/test"))
    (tmp_path / "c.yaml").write_text(f"""
paths: {{processed_data_dir: {tmp_path}/clean}}
stage7_eval: {{enabled: true, beam_size: 2, max_new_tokens: 99, num_sample_translations: 2, outputs: {{metrics_json: {tmp_path}/m.json, translations_tsv: {tmp_path}/t, samples_md: {tmp_path}/s.md}}}}
""")
    cli.main(["evaluate", "--config", str(tmp_path / "c.yaml"), "--checkpoint", str(tmp_path / "m.npz"), "--tokenizer", model])
    found = json.loads((tmp_path / "m.json").read_text())
    assert found["rows"] == 3 and found["decoding"]["max_new_tokens"] == 15 and 0 <= found["chrf"] <= 100
    assert (tmp_path / "s.md").read_text().count("## ") == 2
    assert sorted(r[0] for r in sinks.read_translations(spark, str(tmp_path / "t"), T_ROWS).collect()) == [0, 1, 2]


def test_translations_can_be_read_back(spark, tmp_path):
    rows = [(0, ' a "b" ', "x\ty", "two\nlines\\"), (1, "", '"', "\\"), (2, "ż", "'", ' "" ')]
    sinks.write_translations(spark.createDataFrame(rows, T_ROWS), str(tmp_path / "t"))
    assert sorted(map(tuple, sinks.read_translations(spark, str(tmp_path / "t"), T_ROWS).collect())) == rows

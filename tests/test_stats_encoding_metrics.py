import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lingweave.config import DecodingConfig, EncodingConfig
from lingweave.functions import formulas as M
from lingweave.operators import decoding as D
from lingweave.operators import encoding as E
from lingweave.operators import metrics as B
from lingweave.operators import tokenizer_stats as S
from lingweave.operators import transformer as T
from lingweave.plans import reports, stages
from lingweave.sources import corpus, sinks


def plain_p95(values):
    v = sorted(values)
    return v[min(len(v) - 1, int(len(v) * 0.95))] if v else 0


@pytest.mark.parametrize("n", [1, 19, 20, 21, 100])
def test_p95(spark, n):
    rng = random.Random(n)
    values = [rng.randint(0, 9) for _ in range(n)]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v int")
    assert S.percentile95(df, ["g"], "v").first().p95 == plain_p95(values)


def two_codes(c):
    """`bb` is unknown, any other word has id 7."""
    return F.transform(F.split(c, " "), lambda w: F.when(w == "bb", 1).otherwise(7).cast("int"))


def test_split_stats_golden(spark):
    df = spark.createDataFrame([("train", 0, "aa bb", "cc")], "split string, row_index long, pl string, en string")
    r = S.split_stats(df, two_codes).first()
    assert (r.rows, r.words, r.pieces, r.unk, r.pieces_per_word) == (1, 3, 3, 1, 1.0) and r.unk_rate == pytest.approx(1 / 3)


def test_long_words(spark):
    df = spark.createDataFrame([("commonlongword", 100, 0, 0, 0), ("rarelongwordx", 1, 1, 0, 0), ("short", 9, 2, 0, 0)], "word string, cnt long, first_row long, first_side int, first_place int")
    encode = lambda c: F.when(c == "commonlongword", F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2), F.lit(3)))
    got = {r.bucket: (r.types, r.mean_pieces, r.p95_pieces) for r in S.long_word_stats(df, encode).collect()}
    assert got == {"freq_1": (1, 3.0, 3), "freq_2_5": (0, 0.0, 0), "freq_6_50": (0, 0.0, 0), "freq_gt_50": (1, 1.0, 1)}
    assert [r.word for r in S.top_long_words(df, encode).orderBy("rank").collect()] == ["commonlongword", "rarelongwordx"]


def test_ties_go_by_first_encounter(spark):
    df = spark.createDataFrame([(0, "zzzzzzzzzzzz", "bbbbbbbbbbbb"), (1, "aaaaaaaaaaaa", "zzzzzzzzzzzz bbbbbbbbbbbb")], "row_index long, pl string, en string")
    words = [r.word for r in S.top_long_words(S.word_frequencies(df), S.length_encoder()).orderBy("rank").collect()]
    assert words == ["zzzzzzzzzzzz", "bbbbbbbbbbbb", "aaaaaaaaaaaa"]


def test_bpe_training(spark):
    df = spark.createDataFrame([("low", 5), ("lower", 2), ("newest", 6), ("widest", 3)], "word string, cnt long")
    merges = S.train_bpe(df, 4)
    assert merges[:2] == [("e", "s"), ("es", "t")] and len(merges) == 4
    assert [list(r.symbols) for r in S.merge(spark.createDataFrame([(["a", "a", "a"], 1)], "symbols array<string>, cnt long"), "a", "a").collect()] == [["aa", "a"]]


def test_corpus_lines_and_scan(spark, tmp_path):
    raw = spark.createDataFrame([(("kot", None),), (None,)], "translation struct<pl:string,en:string>")
    raw.coalesce(1).write.parquet(str(tmp_path / "raw"))
    assert [(r.pl, r.en) for r in corpus.scan_pairs(spark, str(tmp_path / "raw")).orderBy("row_index").collect()] == [("kot", "None"), ("None", "None")]
    flat = spark.createDataFrame([("jeden\nx", "one"), ("dwa", "two")], "pl string, en string").coalesce(1)
    flat.write.parquet(str(tmp_path / "flat"))
    pairs = corpus.scan_pairs(spark, str(tmp_path / "flat"))
    assert [r.line for r in sinks.corpus_lines(pairs).orderBy("row_index", "side").collect()] == ["jeden x", "one", "dwa", "two"]
    assert sinks.write_corpus(pairs, str(tmp_path / "corpus")) == 4
    assert corpus.count_rows(spark, str(tmp_path / "flat")) == 2
    assert corpus.limited(pairs, 1).count() == 1
    with pytest.raises(ValueError):
        spark.range(1).write.parquet(str(tmp_path / "odd"))
        corpus.scan_pairs(spark, str(tmp_path / "odd"))
    with pytest.raises(FileNotFoundError):
        corpus.resolve_split(spark, str(tmp_path), "train-*.parquet")


def by_letters(c):
    return F.transform(F.regexp_extract_all(F.replace(c, F.lit(" "), F.lit("")), F.lit("."), F.lit(0)), lambda x: (F.ascii(x) % 20 + 4).cast("int"))


def test_encode_and_collate(spark):
    df = spark.createDataFrame([(0, "ab", "cd"), (1, "verylong", "x")], "row_index long, pl string, en string")
    config = EncodingConfig(max_seq_len=4)
    assert tuple(E.load_stats(df, by_letters, config).first()) == (2, 1, 1)
    r = E.examples(df, by_letters, config).first()
    assert r.src_ids[-1] == 3 and r.tgt_in_ids[0] == 2 and r.tgt_out_ids[-1] == 3
    assert E.examples(df, by_letters, config, limit=1).count() == 1
    rows = spark.createDataFrame([(0, "ab", "c"), (1, "a", "cde")], "row_index long, pl string, en string")
    c = E.collate(E.chunked(E.encode_pairs(rows, by_letters), 2), 4).first()
    assert [len(x) for x in c.src] == [4, 4] and [len(x) for x in c.tgt_in] == [4, 4]
    assert c.src_pad[1][-1] is True and c.causal[0][1] is True and c.causal[1][0] is False
    assert spark.range(1).select(E.causal_mask(F.lit(3)).alias("m")).first().m == [[False, True, True], [False, False, True], [False, False, False]]
    with pytest.raises(ValueError):
        E.chunked(rows, 0)


def test_chunks_count_the_rows_that_are_left(spark):
    rows = spark.createDataFrame([(i, "x") for i in (3, 70_000, 9, 10, 200_001, 65_536, 200_000)], "row_index long, pl string").repartition(3)
    got = {r.row_index: r.batch_id for r in E.chunked(rows, 3).collect()}
    assert got == {3: 0, 9: 0, 10: 0, 65_536: 1, 70_000: 1, 200_000: 1, 200_001: 2}
    assert E.chunked(rows, 3).columns == ["row_index", "pl", "batch_id"]


def test_bleu_of_corpora_without_all_orders(spark):
    """An order without n-grams has the precision 0, and so the score is 0."""
    for text in ("hello", "the cat", "the cat sat"):
        assert scores(spark, [(text, text)])[0] == 0
    assert scores(spark, [("the cat sat down", "the cat sat down")])[0] == pytest.approx(100)


def scores(spark, pairs):
    df = spark.createDataFrame([(i, h, r) for i, (h, r) in enumerate(pairs)], "index long, hypothesis string, reference string")
    return B.bleu(df).first()[0], B.chrf(df).first()[0]


def test_metrics(spark):
    same = [("the cat sat on the mat today", "the cat sat on the mat today")]
    assert scores(spark, same) == (pytest.approx(100), pytest.approx(100))
    assert scores(spark, [("a b c d", "x y z w")]) == (0.0, 0.0)
    # 4 of 5 unigrams, 3 of 4 bigrams, 2 of 3 trigrams, 1 of 2 four-grams.
    bleu, _ = scores(spark, [("a b c d e", "a b c d f")])
    assert bleu == pytest.approx(100 * math.exp(sum(map(math.log, (4 / 5, 3 / 4, 2 / 3, 1 / 2))) / 4))
    # No four-gram: its precision is halved once; the hypothesis is short.
    bleu, _ = scores(spark, [("a b c x", "a b c y z")])
    expected = [3 / 4, 2 / 3, 1 / 2, 1 / (2 * 1)]
    assert bleu == pytest.approx(100 * math.exp(1 - 5 / 4) * math.exp(sum(map(math.log, expected)) / 4))
    _, chrf = scores(spark, [("ab", "abc")])
    p, r = (1 + 1) / 2, (2 / 3 + 1 / 2) / 2
    assert chrf == pytest.approx(100 * 5 * p * r / (4 * p + r))
    tokens = spark.range(1).select(B.tokens_13a(F.lit('Hello, "world" 3.5-x don\'t &amp; a.')).alias("t")).first().t
    assert tokens == ["Hello", ",", '"', "world", '"', "3.5", "-", "x", "don't", "&", "a", "."]


TABLE = np.log(np.array([[1, 1, 1, 3, 2, 2], [1, 1, 1, 1, 4, 2], [1, 1, 1, 1, 2, 4], [1, 1, 1, 5, 1, 1], [1, 1, 1, 2, 1, 4], [1, 1, 1, 3, 3, 1]], float) / 10)


def test_decoders():
    step = D.TableScorer(TABLE)(np.zeros((2, 1)))
    greedy = D.greedy_one(step, 8)
    assert greedy[0] == 2 and greedy == D.greedy_batch(step, 2, 8)[1]
    for beam in (1, 2, 3):
        config = DecodingConfig(beam_size=beam, length_penalty=0.0)
        best = D.beam_batch(step, 2, 6, config)
        assert best[0] == best[1]
        assert D.beam_one(step, 6, DecodingConfig(beam_size=1)) == D.greedy_one(step, 6)
    # With a wide beam and no penalty the batched search finds the likeliest sequence.
    def likelihood(t):
        return sum(TABLE[a, b] for a, b in zip(t, t[1:]))

    import itertools

    ended = [[2, *mid, 3] for n in range(4) for mid in itertools.product((0, 1, 2, 4, 5), repeat=n)]
    assert likelihood(D.beam_batch(step, 1, 4, DecodingConfig(beam_size=50, length_penalty=0.0))[0]) == pytest.approx(max(map(likelihood, ended)))


def test_transformer(tmp_path):
    config = T.ModelConfig(12, 12, d_model=8, nhead=2, encoder_layers=1, decoder_layers=2, feedforward=16, max_seq_len=10)
    model = T.Transformer(config, seed=3)
    src, tgt = np.array([[5, 6, 3, 0]]), np.array([[2, 7, 8]])
    full = model.forward(src, tgt)
    assert full.shape == (1, 3, 12)
    assert np.allclose(full[:, :2], model.forward(src, tgt[:, :2]))  # nothing ahead is seen
    assert np.allclose(full, model.forward(np.array([[5, 6, 3, 0, 0]]), tgt))  # nor padding
    assert model.count_parameters() == sum(w.size for w in _leaves(model.weights))
    T.save_model(model, str(tmp_path / "m.npz"))
    assert np.allclose(T.load_model(str(tmp_path / "m.npz")).forward(src, tgt), full)
    assert D.beam_batch(model(src), 1, 5, DecodingConfig(beam_size=2))[0][0] == 2
    with pytest.raises(ValueError):
        T.ModelConfig(5, 5, d_model=9, nhead=2)
    out = T.inference_checkpoint({"model_state_dict": 1, "model_config": {}, "optimizer_state_dict": 2, "scheduler_state_dict": 3}, "now")
    assert out["checkpoint_type"] == "inference" and out["stripped_keys"] == ["optimizer_state_dict", "scheduler_state_dict"] and "optimizer_state_dict" not in out
    with pytest.raises(KeyError):
        T.inference_checkpoint({"model_config": {}}, "now")


def _leaves(w):
    for v in w.values() if isinstance(w, dict) else w:
        if isinstance(v, np.ndarray):
            yield v
        else:
            yield from _leaves(v)


def test_formulas(spark):
    log = spark.createDataFrame([(1, 1.0), (2, 1.1), (3, 1.2)], "step int, loss double")
    assert [(r.best, r.stop) for r in M.early_stopping(log, 2).orderBy("step").collect()] == [(1.0, False), (1.0, False), (1.0, True)]
    assert M.validation_loss(log.limit(0)).first().loss == math.inf
    ids = spark.createDataFrame([([2, 5, 3, 3],), ([2, 5],)], "i array<int>")
    assert [r.n for r in ids.select(M.sequence_length(F.col("i")).alias("n")).collect()] == [3, 2]
    pe = spark.range(3).select(M.positional_encoding(F.col("id"), 6).alias("p")).collect()
    assert np.allclose([r.p for r in pe], T.positions(3, 6))


def test_evaluation_end_to_end(spark, tmp_path):
    pairs = spark.createDataFrame([(0, "ala ma kota", "alice has a cat"), (1, "pies spi", "the dog sleeps")], "row_index long, pl string, en string")
    detokenise = lambda ids: F.array_join(ids.cast("array<string>"), " ")
    out = stages.evaluate(pairs, by_letters, D.TableScorer(np.pad(TABLE, ((0, 30), (0, 0)))), detokenise, DecodingConfig(beam_size=2, max_new_tokens=5))
    rows = out.orderBy("index").collect()
    assert [r.source_pl for r in rows] == ["ala ma kota", "pies spi"] and rows[0].hypothesis_en
    sinks.write_translations(out, str(tmp_path / "tsv"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "tsv")).count() == 2
    assert len(stages.scores(out)) == 2
    assert "## 0" in reports.samples_report([rows[0].asDict()])
    assert stages.evaluate(pairs, by_letters, D.TableScorer(TABLE), detokenise, limit=1).count() == 1


def test_clean_stage_end_to_end(spark, tmp_path):
    def write(name, rows):
        spark.createDataFrame([((p, e),) for p, e in rows], "translation struct<pl:string,en:string>").coalesce(1).write.parquet(str(tmp_path / "raw" / f"{name}-00000-of-00001.parquet"))

    write("train", [("wspolna para", "shared pair"), ("tylko train", "train only"), ("", "x")])
    write("validation", [("wspolna para", "shared pair")])
    write("test", [("tylko test", "test only")])
    manifest = stages.clean(spark, str(tmp_path / "raw"), {s: f"{s}-*.parquet" for s in ("train", "validation", "test")}, str(tmp_path / "out"))
    assert manifest["totals"]["rows_in"] == 5 and manifest["totals"]["rows_out"] == 3
    assert manifest["splits"][0]["primary_reason_counts"] == {"empty_pair": 1, "train_pair_present_in_validation_or_test": 1}
    assert spark.read.parquet(str(tmp_path / "out/train")).count() == 1 and spark.read.json(str(tmp_path / "out/removed")).count() == 2
    assert any("Rows in: 5" in x for x in reports.cleaning_report(manifest))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("abc\U0001f600é", max_size=9), st.text("abc\U0001f600é", max_size=9)), max_size=5), st.booleans())
def test_overlaps_are_those_of_counters(sentences, renumber):
    if renumber:  # so many distinct items that six of them do not fit into one number
        filler = "".join(map(chr, range(0x4E00, 0x4E00 + 3000)))
        sentences = [*sentences, (filler, filler[1:])]
    hyp, ref = (np.array([len(s[k]) for s in sentences], np.int64) for k in (0, 1))
    codes = np.array([ord(c) for k in (0, 1) for s in sentences for c in s[k]], np.int64)
    want = np.zeros((6, 3), np.int64)
    for a, b in sentences:
        for n in range(1, 7):
            h, r = (Counter(t[i : i + n] for i in range(len(t) - n + 1)) for t in (a, b))
            want[n - 1] += (sum((h & r).values()), sum(h.values()), sum(r.values()))
    assert B.overlaps(codes, hyp, ref, 6).tolist() == want.tolist()


def test_sentences_may_be_null_empty_or_repeat_an_index(spark):
    rows = spark.createDataFrame([(1, None, "a b"), (1, "a b", "a b"), (2, "", ""), (None, "b", None)], "index long, hypothesis string, reference string")
    assert sorted(map(tuple, B.chrf_stats(rows).collect())) == [(1, 2, 3, 4), (2, 1, 1, 2)]
    assert B.bleu_stats(rows.limit(0)).collect() == []

"""Queries over whole inputs, which have no SQL: against plain Python on small tables with long rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from test_text_and_cleaning import plain_sanitise

from lingweave.queries import QUERIES


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    """Texts of many lines, most of them longer than 400 characters, with what the operators look for at both ends."""
    rng = random.Random(5)
    marks = ["[cue one]", "—", "...", "a...", "你好", "- x", "e.g., this", "3.5-x", "&amp;", "Zażółć", "end..."]
    texts = [None, "", "one line...", "a\nb", "\n\nx", *("\n".join(" ".join(rng.choice([*marks, "the", "cat", "sat", "on", "mat"]) for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 9))) for _ in range(60))]
    assert sum(len(t or "") > 400 for t in texts) > 20
    d = tmp_path_factory.mktemp("whole")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(d / "documents.parquet"))
    return str(d), texts


def test_sanitize_whole_text(spark, documents):
    d, texts = documents
    got = {r.doc_id: r.clean for r in QUERIES["sanitize_whole_text"](spark, d).collect()}
    rough = [None if t is None else re.sub(r"\[[^\]]*\]", " ", "— [cue] " + t.replace(", ", "... ") + " 你好 x...") for t in texts]
    assert got == {i: None if t is None else plain_sanitise(t) for i, t in enumerate(rough)}
    prefix = {r.doc_id: r.clean for r in QUERIES["sanitize_text"](spark, d).collect()}
    assert all((prefix[i] == got[i]) == (len(t or "") <= 400) for i, t in enumerate(texts))


def plain_stats(pairs, order, joiner):
    """``n: (match, hyp, ref)`` of pairs of item lists."""
    grams = lambda items, n: Counter(joiner.join(items[i : i + n]) for i in range(len(items) - n + 1))
    out = {n: [0, 0, 0] for n in range(1, order + 1)}
    for hypothesis, reference in pairs:
        for n in out:
            h, r = grams(hypothesis, n), grams(reference, n)
            out[n] = [a + b for a, b in zip(out[n], ((h & r).total(), h.total(), r.total()))]
    return {n: tuple(x) for n, x in out.items()}


def plain_13a(t):
    for a, b in (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        t = t.replace(a, b)
    t = f" {t} "
    for pattern, to in ((r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "), (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")):
        t = re.sub(pattern, to, t)
    return t.split()


def test_metrics_read_all_lines(spark, documents):
    d, texts = documents
    lines = [(t or "").split("\n") for t in texts]
    sides = [("\n".join(x[::2]), "\n".join(x[1::2])) for x in lines]
    got = lambda name: {r.n: (r.match, r.hyp, r.ref) for r in QUERIES[name](spark, d).collect()}
    words = plain_stats([(plain_13a(h), plain_13a(r)) for h, r in sides], 4, " ")
    chars = plain_stats([tuple([*"".join(x.split())] for x in pair) for pair in sides], 6, "")
    assert got("bleu_stats_whole") == words and got("chrf_stats_whole") == chars
    # Every character is on one side or the other.
    assert sum(chars[1][1:]) == sum(len("".join((t or "").split())) for t in texts) > sum(got("chrf_stats")[1][1:])
    (h1, r1), precisions = words[1][1:], [m / h for m, h, _ in words.values()]
    bleu = 100 * min(1.0, math.exp(1 - r1 / h1)) * math.exp(sum(map(math.log, precisions)) / 4)
    p, r = (sum(x[0] / x[side] for x in chars.values()) / 6 for side in (1, 2))
    assert QUERIES["bleu_score_whole"](spark, d).first().bleu == pytest.approx(bleu, abs=1e-6)
    assert QUERIES["chrf_score_whole"](spark, d).first().chrf == pytest.approx(100 * 5 * p * r / (4 * p + r), abs=1e-6)


def test_bpe_pairs_all(spark, documents):
    d, texts = documents
    expected = Counter()
    for i, t in enumerate(texts):
        if i % 10 > 1:
            for side in ("None" if t is None else t).split("\n", 1) if "\n" in (t or "") else (("None" if t is None else t), "None"):
                for word in re.findall(r"\w+", side):
                    symbols = ["▁" + word.lower()[0], *word.lower()[1:]]
                    expected.update(zip(symbols, symbols[1:]))
    got = {(r.left, r.right): r.n for r in QUERIES["bpe_pairs_all"](spark, d).collect()}
    assert got == expected and len(got) > 25


def test_whole_vectors_are_logits(spark, tmp_path):
    rng = np.random.default_rng(2)
    vectors = {i: rng.normal(size=64).astype("float32") for i in range(80)}
    rows = [(i, [float(x) for x in v]) for i, v in vectors.items()] + [(80, None), (81, [])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    best = {r.vec_id: r.best for r in QUERIES["greedy_argmax_whole"](spark, str(tmp_path)).collect()}
    assert best == {i: v.argmax() for i, v in vectors.items()} and max(best.values()) > 9
    losses = {}
    for i, v in vectors.items():
        x = v.astype(float) * 8
        log_p = x - x.max() - np.log(np.exp(x - x.max()).sum())
        if i % 64:
            losses.setdefault(i % 4, []).append(-0.9 * log_p[i % 64] - 0.1 * log_p.mean())
    got = {r.batch: r.loss for r in QUERIES["label_smoothed_ce_whole"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx({b: np.mean(x) for b, x in losses.items()}, abs=1e-6)
    assert QUERIES["validation_loss_whole"](spark, str(tmp_path)).first().loss == pytest.approx(np.mean([np.mean(x) for x in losses.values()]), abs=1e-6)

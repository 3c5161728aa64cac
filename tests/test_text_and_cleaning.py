"""Text expressions and the row classifier: golden cases, random strings against plain Python, and a row-by-row simulation."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lingweave.config import CleaningConfig, PreauditConfig, get_nested, load_config
from lingweave.functions import text as X
from lingweave.operators import cleaning as C

ALPHABET = [*"ab \t\n\r\x00\x07\x0b\x1c\x1f\x7f\x85  　.-–—−?[]1ąŻ你😊ﬁÀ", "...", "....", " - ", "word"]


def strings(n, seed=0):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def apply(spark, texts, expression):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.select("i", expression(F.col("t")).alias("v")).orderBy("i").collect()]


def plain_normalise(t):
    t = re.sub(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "", t)
    return re.sub(r"\s+", " ", t).strip()


def plain_sanitise(t):
    known = "A-Za-z0-9ĄąĆćĘęŁłŃńÓóŚśŹźŻż"
    t = re.sub("[–—−]", "-", t)
    t = re.sub(rf"(?<![{known}])\.{{3}}", " ", t)
    t = re.sub(r"\.{3}(?!\s*$)", " ", t) if "\n" not in t[-1:] else re.sub(r"\.{3}(?!\s*\Z)", " ", t)
    t = re.sub(rf"[^ {known}?.,:;'!\"\-]", " ", t)
    t = re.sub(r"^\s*-+\s*", "", t)
    m = re.match(rf"[^{known}]*", t)
    t = m[0].replace("-", " ") + t[m.end() :]
    return re.sub(r"\s+", " ", t).strip()


def test_normalise(spark):
    texts = ["  Ala\t\nma   kota  ", "abc\x00\x07def", "a\x0bb", *strings(400)]
    assert apply(spark, texts, X.normalise) == [plain_normalise(t) for t in texts]
    assert apply(spark, texts, X.strip_space) == [t.strip() for t in texts]
    assert apply(spark, texts, X.word_count) == [len(t.split()) for t in texts]
    tidy = [plain_normalise(t) for t in texts]
    assert apply(spark, tidy, X.word_count_single_spaced) == [len(t.split()) for t in tidy]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("你好 Ala / ma \\ kota 😊", "Ala ma kota"),
        ("Zażółć gęślą jaźń! Don't \"quote\"; test: ok? 2024.", "Zażółć gęślą jaźń! Don't \"quote\"; test: ok? 2024."),
        ("   - Hello", "Hello"),
        ("— Hello", "Hello"),
        ("-- Hello", "Hello"),
        ("Bielsko-Biała", "Bielsko-Biała"),
        ("COVID-19", "COVID-19"),
        ("Hello - world", "Hello - world"),
        ("x...", "x..."),
        ("... y", "y"),
        ("a... b", "a b"),
    ],
)
def test_sanitise_golden(spark, text, expected):
    assert apply(spark, [text], X.sanitise) == [expected]


def test_sanitise_random(spark):
    texts = strings(600, 3)
    assert apply(spark, texts, X.sanitise) == [plain_sanitise(t) for t in texts]
    assert apply(spark, texts, X.drop_bracketed) == [re.sub(r"\[[^\]]*\]", " ", t) for t in texts]


def test_normal_form(spark):
    stable = re.compile(X.NFKC_STABLE.replace("^", "").replace("$", ""))
    assert all(unicodedata.normalize("NFKC", chr(c)) == chr(c) for c in range(0x180) if stable.fullmatch(chr(c)))
    texts = [None, "ﬁ", "Ａ１", "é", "é", "plain", *strings(200, 5)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.t for r in X.normalise_form(df, ["t"], "NFKC").orderBy("i").collect()]
    assert got == [t and unicodedata.normalize("NFKC", t) for t in texts]


def test_words(spark):
    texts = ["Ala MA kota, x_1 – Żółć!", "", "你好 a"]
    assert apply(spark, texts, X.words) == [[w.lower() for w in re.findall(r"\w+", t)] for t in texts]


def simulate(rows, config):
    """The classifier row by row, with sets."""
    seen_of, held = {}, set()
    norm = {(s, i): None if p is None or e is None else (plain_normalise(p), plain_normalise(e)) for s, i, p, e in rows}
    for (s, _), pair in norm.items():
        if s != "train" and pair and all(pair):
            held.add(pair)
    out = {}
    for split in config.order:
        seen = seen_of.setdefault("all" if config.dedup_scope == "global" else split, set())
        for s, i, _, _ in sorted(r for r in rows if r[0] == split):
            pair = norm[s, i]
            if pair is None:
                out[s, i] = ["null_pair"]
            elif not all(pair):
                out[s, i] = ["empty_pair"]
            else:
                a, b = (len(t.split()) for t in pair)
                found = []
                if config.remove_identical_pairs and pair[0] == pair[1]:
                    found.append("identical_source_target")
                if min(a, b) < config.min_words:
                    found.append("min_words")
                if max(a, b) > config.max_words:
                    found.append("max_words")
                if max(a, b) / max(1, min(a, b)) > config.max_length_ratio:
                    found.append("length_ratio")
                if config.remove_leaked_train_pairs and s == "train" and pair in held:
                    found.append("train_pair_present_in_validation_or_test")
                if pair in seen:
                    found.append("duplicate")
                if not found:
                    seen.add(pair)
                out[s, i] = found
    return out


@pytest.mark.parametrize("scope", ["global", "split"])
@pytest.mark.parametrize("first", [True, False])
@pytest.mark.parametrize("leaks", [True, False])
def test_classifier_equals_simulation(spark, scope, first, leaks):
    rng = random.Random(7)
    texts = ["a", "a b", "a  b ", "b a", "c", "a b c d e f g h i j", "", None, " ", "x y z"]
    rows = [(rng.choice(("train", "validation", "test")), i, rng.choice(texts), rng.choice(texts)) for i in range(300)]
    config = CleaningConfig(dedup_scope=scope, heldout_first=first, remove_leaked_train_pairs=leaks, min_words=1 if leaks else 2)
    df = spark.createDataFrame(rows, "split string, row_index long, pl string, en string")
    got = {(r.split, r.row_index): list(r.all_reasons) for r in C.classify(df, config).collect()}
    assert got == simulate(rows, config)


def test_leakage_golden(spark):
    rows = [("train", 0, "wspolna para", "shared pair"), ("train", 1, "tylko train", "train only"), ("validation", 0, "wspolna para", "shared pair"), ("test", 0, "tylko test", "test only")]
    df = spark.createDataFrame(rows, "split string, row_index long, pl string, en string")
    found = C.classify(df)
    assert {(r.split, r.reason, r.n) for r in C.reason_counts(found).collect()} == {("train", "train_pair_present_in_validation_or_test", 1), (None, "train_pair_present_in_validation_or_test", 1)}
    assert {r.split: r.rows_out for r in C.split_totals(found).collect()} == {"train": 1, "validation": 1, "test": 1, None: 3}


def labelled(spark, rows, labels, accepted, **changes):
    df = spark.createDataFrame([(s, i, True, p, e) for s, i, p, e in rows], "split string, row_index long, present boolean, pl string, en string")
    lab = spark.createDataFrame(labels, "split string, row_index long, label int")
    return C.classify_labelled(df, lab, CleaningConfig(**changes), PreauditConfig(), accepted).collect()


def test_labels_golden(spark):
    rows = [("train", 0, "Zażółć 你好", "Good / text"), ("train", 1, "niepewny", "uncertain"), ("train", 2, "brak labela", "missing label")]
    got = labelled(spark, rows, [("train", 0, 2), ("train", 1, 1)], (2,), dedup_scope="split", remove_identical_pairs=False)
    assert {(r.row_index, r.pl, r.en, r.reason) for r in got} == {(0, "Zażółć", "Good text", None), (1, "niepewny", "uncertain", "llm_label_not_kept"), (2, "brak labela", "missing label", "missing_llm_label")}
    got = labelled(spark, rows[:2], [("train", 0, 2), ("train", 1, 1)], (1, 2))
    assert [r.reason for r in got] == [None, None]


def test_preaudit_nulls(spark):
    rows = [("train", 0, True, "你好 😊", "valid text"), ("train", 1, True, "dobry tekst", "valid text"), ("train", 2, False, None, None), ("train", 3, True, None, "x"), ("train", 4, True, None, None), ("train", 5, True, "dobry tekst", "valid text")]
    df = spark.createDataFrame(rows, "split string, row_index long, present boolean, pl string, en string")
    got = {r.row_index: (r.pl, r.reason) for r in C.preaudit(df).collect()}
    assert got == {0: ("", "empty_pair"), 1: ("dobry tekst", None), 2: ("None", "null_pair"), 3: ("None", None), 4: ("None", "identical_source_target"), 5: ("dobry tekst", "duplicate_pair")}


def test_config(tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("a:\n  b: 3\n")
    assert get_nested(load_config(path), "a.b") == 3 and get_nested({"a": 1}, "a.b", "d") == "d"
    (tmp_path / "l.yaml").write_text("- 1\n")
    with pytest.raises(ValueError):
        load_config(tmp_path / "l.yaml")
    with pytest.raises(FileNotFoundError):
        load_config(tmp_path / "none.yaml")
    with pytest.raises(ValueError):
        CleaningConfig(dedup_scope="both")

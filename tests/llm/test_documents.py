"""Decontamination, Jaccard join, language ID, toxicity: against brute force and on edge cases."""

import random
import re
import time
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from lingweave.llm import decontaminate, jaccard_join, langid, toxicity
from lingweave.llm.common import remainder

SCHEMA = "doc_id long, text string, lang string, digest string, score double"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, texts, schema=SCHEMA, langs=None):
    return spark.createDataFrame([(i, t, langs[n] if langs else "en", "clash", 0.5) for n, (i, t) in enumerate(texts)], schema)


# --- decontamination ---


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))


def brute_contamination(docs, items, window=13):
    out = []
    for d, t in docs:
        w, hit, named = words(t), set(), set()
        for i, x in items:
            v = words(x)
            n = min(window, len(v))
            if i is None or not n:
                continue
            wins = {tuple(v[s : s + n]) for s in range(len(v) - n + 1)}
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in wins:
                    hit.update(range(s, s + n))
                    named.add(str(i))
        out.append((d, len(w), len(hit), sorted(named), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def test_contamination_equals_brute_force(spark):
    rng = random.Random(2)
    vocabulary = ["the", "of", "a", "É", "é", "x1", "naïve", *(f"w{i}" for i in range(60))]
    passage = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(passage(rng.choice((3, 12, 13, 14, 30))))) for i in range(12)] + [(50, None), (51, "..."), (None, "the of a"), (3, " ".join(passage(20))), (60, "THE the the the the the the the the the the the the the the")]
    docs = []
    for d in range(60):
        w = passage(rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            v = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, max(0, len(v) - 1))
            w[rng.randint(0, len(w)) : 0] = [x.upper() for x in v[a : a + rng.choice((5, 13, 30))]]
        docs.append((d, rng.choice((" ", "\n", ", ")).join(w)))
    docs += [(70, None), (71, ""), (72, "!!"), (5, "the same id, another text " + items[0][1]), (5, "the same id, another text " + items[0][1]), (None, items[1][1]), (73, "the " * 40)]
    tests = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, doc_id string")
    found = decontaminate.contamination(frame(spark, docs), tests)
    got = sorted(((r.doc_id, r.n_words, r.n_hit, list(r.items), r.contaminated) for r in found.collect()), key=repr)
    assert got == brute_contamination(docs, items)
    clean = decontaminate.clean_documents(frame(spark, docs), tests)
    assert clean.columns == frame(spark, docs).columns
    assert sorted((r.doc_id for r in clean.collect()), key=repr) == sorted((g[0] for g in got if not g[4]), key=repr)
    assert decontaminate.contamination(frame(spark, docs), tests.limit(0)).where("contaminated or n_hit > 0").count() == 0
    assert decontaminate.contamination(frame(spark, docs).limit(0), tests).count() == 0


def test_blocks_and_proximity(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)
    items = spark.createDataFrame([("i", " ".join(f"t{n}" for n in range(20)))], "item_id string, content string")
    docs = spark.createDataFrame([(1, " ".join(f"t{n}" for n in range(20))), (2, "t0 t1 x t2 t3 t4 t5 t6 t7 t8 t9 t10 t11 t12"), (3, "nothing of it")], "doc_id long, content string")
    exact = {(r.doc_id, r.kind) for r in decontaminate.matches(docs, items).collect()}
    assert exact == {(1, "exact")}
    assert (2, "proximity") in {(r.doc_id, r.kind) for r in decontaminate.matches(docs, items, slop=2).collect()}


def test_long_items_and_documents_equal_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    item = [rng.choice(vocabulary) for _ in range(20_000)]
    text = [rng.choice(vocabulary) for _ in range(20_000)]
    text[500:540], text[9000:9013], text[15_000:15_012] = item[19_960:], item[70:83], item[300:312]
    docs = [(1, " ".join(text)), (2, " ".join(item[5_000:5_400])), (3, " ".join(text[:400])), (4, "the " * 20_000)]
    items = [("long", " ".join(item)), ("same", "the " * 20_000)]
    tests = spark.createDataFrame(items, "item_id string, text string")
    began = time.time()
    got = sorted((r.doc_id, r.n_words, r.n_hit, list(r.items), r.contaminated) for r in decontaminate.contamination(frame(spark, docs), tests).collect())
    assert time.time() - began < 60
    long = {tuple(item[i : i + 13]) for i in range(len(item) - 12)}
    for d, n, n_hit, named, _ in got:
        w, hit = docs[d - 1][1].split(), set()
        for i in range(len(w) - 12):
            if tuple(w[i : i + 13]) in long or set(w[i : i + 13]) == {"the"}:
                hit.update(range(i, i + 13))
        assert (n, n_hit, named) == (len(w), len(hit), ["same"] if d == 4 else ["long"] if hit else [])


# --- Jaccard join ---


def shingle_set(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())


def brute_components(docs):
    sets = [shingle_set(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(docs)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 85 * len(sets[i] | sets[j]):
            parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i), d)) for i, (d, _) in enumerate(docs)), key=repr)


def near_copies(seed, n=160):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 400)}"
    docs = []
    for d in range(n):
        if docs and rng.random() < 0.6:
            w = (rng.choice(docs)[1] or "").split()
            for _ in range(rng.randint(0, 3)):
                if w:
                    w[rng.randrange(len(w))] = word()
        else:
            w = [word() for _ in range(rng.choice((0, 1, 3, 4, 6, 40, 80)))]
        docs.append((d, (" " if rng.random() < 0.7 else "\n").join(x.upper() if rng.random() < 0.05 else x for x in w)))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    docs = near_copies(seed) + [(500, None), (501, "  "), (502, "one"), (503, "ONE"), (7, "same id other text of words"), (None, "null id with words here"), (None, "null id with words here"), (504, "É a b c d"), (505, "é a b c d")]
    found = jaccard_join.similarity_components(frame(spark, docs))
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found.collect()), key=repr) == brute_components(docs)


def test_large_groups_and_salts(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HOT", 4 * jaccard_join.UNIT)
    monkeypatch.setattr(jaccard_join, "BROADCAST_BYTES", 0)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(60)]
    docs = []
    for d in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(60)] = f"r{rng.randint(0, 5)}"
        docs.append((d, " ".join(w)))
    docs += [(200 + d, " ".join(base)) for d in range(40)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.similarity_components(frame(spark, docs)).collect()), key=repr)
    assert got == brute_components(docs)


def test_one_of_each(spark):
    docs = near_copies(4, 60) + [(90, "x y z u v"), (90, "x y z u v"), (None, "q r s t u v"), (91, None), (3, "an id used twice here")]
    df = frame(spark, docs)
    out = jaccard_join.one_of_each(df)
    assert out.columns == df.columns
    expected = brute_components(docs)
    kept = [r.doc_id for r in out.collect()]
    words_ids = {c for (d, n, c) in expected if n and c is not None}
    assert kept.count(90) == 1 and kept.count(None) == 1 and words_ids <= set(kept)
    assert len(kept) == len(jaccard_join.similarity_components(df).where("component is not null").select("component").distinct().collect()) + sum(n == 0 for _, n, _ in expected)
    assert jaccard_join.one_of_each(df.limit(0)).count() == 0


def test_parity_bounds_the_difference():
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(200):
        pool = rng.integers(0, 2**63, 900).astype(np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 800), replace=False)) for _ in range(2))
        difference = len(np.setxor1d(a, b))
        x, y = jaccard_join.parity(a), jaccard_join.parity(b)
        assert jaccard_join.least_difference(x, y) <= difference
        folded = sum(bin((u ^ v) & (2**64 - 1)).count("1") for u, v in zip(jaccard_join.parity_words(x), jaccard_join.parity_words(y), strict=True))
        assert folded <= difference
        assert jaccard_join.least_difference(x, x) == 0


# --- language ID ---


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in out) >= 0.98 * len(out)
    assert all(0 <= r.score <= 1 for r in out)


def test_language_edges(spark):
    rows = [(1, None), (2, ""), (3, "123 !!! 45"), (4, "the of and " * 20), (4, "the of and " * 20), (None, "der die das und " * 20), (6, "x" * 200_000)]
    langs = ["en", "en", "en", "en", None, "de", "fr"]
    out = langid.identify(frame(spark, rows, langs=langs)).collect()
    assert len(out) == len(rows)
    assert {r.lang_pred for r in out if r.doc_id in (1, 2, 3)} == {"und"}
    nothing = langid.identify(frame(spark, rows).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
    assert langid.identify(frame(spark, rows).limit(0)).count() == 0
    kept = langid.predict(frame(spark, rows), None, keep=tuple(SCHEMA_NAMES), named=("_lang", "_score"))
    assert kept.columns == [*SCHEMA_NAMES, "_lang", "_score"]


SCHEMA_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def test_votes_equal_a_plain_loop():
    import numpy as np

    rng = np.random.default_rng(4)
    texts = {g: [" ".join("".join(rng.choice(list(letters), 4)) for _ in range(12)) for _ in range(12)] for g, letters in (("da", "abcde"), ("en", "cdefg"), ("de", "efghi"), ("es", "ijklm"), ("pt", "klmno"), ("fi", "pqrst"))}
    rows = [(g, langid.features(t)[0]) for g, own in texts.items() for t in own]
    sparse = lambda x: (np.flatnonzero(x), x[np.flatnonzero(x)])
    machines = {}
    for step, a, b in langid.machine_names(list(texts)):
        side = [(x, 1 if (g if step else langid.family_of(g)) == a else -1) for g, x in rows if (g if step else langid.family_of(g)) in (a, b)]
        machines[step, a, b] = langid.machine([sparse(x) for x, _ in side], np.array([y for _, y in side]))
        # The same by whole vectors and without averages kept aside.
        w, means, t = np.zeros(langid.DIMENSIONS), [], 0
        order, y = np.random.default_rng(7), np.array([y for _, y in side])
        for _ in range(langid.PASSES):
            for i in order.permutation(len(y)):
                t += 1
                rate = 1 / (langid.REGULAR * (t + 2500))
                push = y[i] * (w @ side[i][0]) < 1
                w = w * (1 - rate * langid.REGULAR) + (rate * len(y) / (2 * (y == y[i]).sum()) * y[i] * side[i][0] if push else 0)
                means.append(w[:50].copy())
        assert np.allclose(np.mean(means, axis=0), machines[step, a, b][:50], rtol=1e-3, atol=1e-5)
    model = langid.Model(list(texts), machines)
    got, _ = model.predict(np.array([x for _, x in rows]))

    def plain(x, step, names):
        votes = {n: [0, 0.0] for n in names}
        for a, b in combinations(sorted(names), 2):
            margin = float(machines[step, a, b] @ x)
            votes[a if margin > 0 else b][0] += 1
            votes[a][1] += margin
            votes[b][1] -= margin
        return max(sorted(votes), key=lambda n: votes[n])

    families = {f: [g for g in texts if langid.family_of(g) == f] for f in map(langid.family_of, texts)}
    for (g, x), found in zip(rows, got, strict=True):
        family = plain(x, "", families)
        assert found == plain(x, family, families[family])
    assert sum(g == found for (g, _), found in zip(rows, got, strict=True)) >= 0.9 * len(rows)


def test_many_languages_and_repeated_ids(spark):
    rng = random.Random(3)
    rows, langs = [], []
    for n in range(30):
        own = [chr(0x100 + rng.randrange(400)) for _ in range(6)]
        for i in range(4):
            rows.append((n * 10 + i, " ".join("".join(rng.choice(own) for _ in range(5)) for _ in range(20))))
            langs.append(f"q{n}")
    rows += [(5, "one id, many rows " + str(i % 3)) for i in range(500)]
    langs += ["en"] * 500
    df = frame(spark, rows, langs=langs)
    taken = langid.sample(df, F.lit(True), "doc_id", "text", "lang").collect()
    assert len(taken) == 30 * 4 + 1
    model = langid.fit(df, F.lit(True))
    assert sum(map(len, model.families.values())) == 31


# --- toxicity ---


def test_toxicity_learns_words_and_pairs(spark):
    rng = random.Random(1)
    clean = [f"c{i}" for i in range(300)]
    rows, labels = [], []
    for d in range(1500):
        toxic = d % 5 == 0
        w = [rng.choice(clean) for _ in range(rng.randint(5, 80))]
        if toxic:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(("nasty", "vile", "vilely", "vilest", "rotten")))
        rows.append((d, " ".join(w)))
        labels.append((d, int(toxic), 1))
    rows += [(9000, None), (9001, ""), (None, "nasty vile")]
    df, lab = frame(spark, rows), spark.createDataFrame([*labels, (5, None, 1), (None, 1, 1), (10, 1, 1)], "doc_id long, toxic int, score int")
    out = {r.doc_id: r for r in toxicity.judge(df, lab).collect()}
    held = [r for i, r in out.items() if r.held_out and i is not None and i < 9000]
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) >= 0.97 * len(held)
    assert out[9000].score == out[9001].score < 0.3 and out[None].predicted == 1
    assert all(0 <= r.score <= 1 for r in out.values())
    again = {r.doc_id: r.score for r in toxicity.judge(df.repartition(7), lab.repartition(3)).collect()}
    assert again == {i: r.score for i, r in out.items()}


def test_training_equals_a_plain_loop():
    """FTRL-proximal as published (McMahan et al. 2013), one coordinate at a time."""
    import math

    import numpy as np

    rng = random.Random(6)
    examples = [(sorted(rng.sample(range(60), rng.randint(0, 12))), rng.random() < 0.3) for _ in range(300)]
    examples = [(at + [70] * (7 in at), label or 7 in at) for at, label in examples]
    ends = np.cumsum([len(at) for at, _ in examples])
    got = toxicity.train_ftrl(np.array([i for at, _ in examples for i in at], "<i4"), ends, np.array([int(y) for _, y in examples]))
    count = {i: sum(i in at for at, _ in examples) for i in range(71)}
    z, n = dict.fromkeys(range(-1, 71), 0.0), dict.fromkeys(range(-1, 71), 0.0)

    def weight(i):
        l1, l2 = (0.0, 0.0) if i < 0 else (toxicity.L1, toxicity.L2)
        return 0.0 if i >= 0 and abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + l2)

    for _ in range(toxicity.PASSES):
        for at, label in examples:
            on = [-1, *(i for i in at if count[i] >= toxicity.MIN_TEXTS)]
            w = {i: weight(i) for i in on}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for i in on:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA * w[i]
                n[i] += g * g
    expected = {i: weight(i) for i in range(71) if weight(i)}
    assert dict(zip(got[0].tolist(), got[1].tolist(), strict=True)) == pytest.approx(expected)
    assert got[2] == pytest.approx(weight(-1)) and 70 in expected


def test_repeated_labelled_ids_and_long_texts(spark):
    rows = [(i, "clean words only here " * 3) for i in range(40)] + [(100 + i, "nasty words in here " * 3) for i in range(40)] + [(100, f"nasty {i}") for i in range(300)] + [(500, "nasty words " * 50_000)]
    labels = spark.createDataFrame([(i, int(i >= 100)) for i, _ in rows], "doc_id long, toxic int")
    out = toxicity.judge(frame(spark, rows), labels).collect()
    assert len(out) == len(rows) and all(r.predicted == (r.doc_id >= 100) for r in out if r.doc_id == 500 or r.doc_id < 100)


def test_toxicity_without_labels(spark):
    df = frame(spark, [(1, "a"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {(r.score, r.predicted) for r in toxicity.judge(df, none).collect()} == {(0.0, 0)}
    one = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.judge(df, one).collect()} == {0.0}
    assert toxicity.judge(df.limit(0), one).count() == 0
    model = toxicity.Model([], [], None)
    assert toxicity.score(df, model, keep=tuple(SCHEMA_NAMES), named="_t").columns == [*SCHEMA_NAMES, "_t"]
    assert remainder("doc_id", 4) is not None

import importlib
import itertools

import numpy as np
import pytest

from lingweave.llm import ann, html_extract as H
from pyspark.sql import functions as F


def brute_cut(odds, links):
    best = None
    for sides in itertools.product((False, True), repeat=len(odds)):
        cost = sum(o for o, s in zip(odds, sides) if o > 0 and not s) + sum(-o for o, s in zip(odds, sides) if o < 0 and s)
        cost += sum(c for i, j, c in links if sides[i] != sides[j])
        best = cost if best is None else min(best, cost)
    return best


def test_minimum_cut_is_minimal():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n = int(rng.integers(1, 9))
        odds = rng.normal(0, 2, n).tolist()
        links = [(i, j, float(rng.random() * 2)) for i in range(n) for j in range(i) if rng.random() < 0.5]
        sides = H.minimum_cut(odds, links)
        cost = sum(o for o, s in zip(odds, sides) if o > 0 and not s) + sum(-o for o, s in zip(odds, sides) if o < 0 and s) + sum(c for i, j, c in links if sides[i] != sides[j])
        assert cost == pytest.approx(brute_cut(odds, links))


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p><p>no</p>"</script></head><body class="has-sidebar">
<header><a href="/">Site</a></header><nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav>
<div class="cookie-notice">We use cookies to improve the site.</div>
<main><article><header><h1>The &amp; headline</h1></header><p>First   paragraph&nbsp;with <b>bold</b> text
and a <a href="x">link</a>.<p>Second <br>line &#233; here.</p><div class="ad">Buy this now.</div><blockquote>Quoted words of someone.</blockquote>
<pre>code  here</pre></article><section id="comments"><p>A reader said this, and it is long enough to be a text of its own.</p></section></main>
<aside class="sidebar"><p>Read more of our stories.</p></aside><form><p>Subscribe</p><input></form>
<footer><p>&copy; 2024 Site. All rights reserved.</p></footer><!-- <p>hidden</p> -->"""


def test_extracts_the_article():
    assert H.main_text(PAGE) == "The & headline\n\nFirst paragraph with bold text and a link.\n\nSecond line é here.\n\nQuoted words of someone.\n\ncode here"


def test_without_semantic_elements():
    page = "<div id='menu'><a href=1>One</a> <a href=2>Two</a></div><div class='post-content'>" + "".join(f"<p>This is sentence number {i} of a long enough paragraph.</p>" for i in range(6)) + "</div><div class='footer'>Imprint</div>"
    assert H.main_text(page).count("\n\n") == 5 and "One" not in H.main_text(page)


@pytest.mark.parametrize("page", [None, "", " ", "<", "<p", "<!--", "<script>x", "</div></p>", "<a href='x>y", "<p>" * 2000, "&", "<p title=\"a>b\">"])
def test_odd_pages(page):
    assert isinstance(H.main_text(page), str)


def test_html_table(spark):
    rows = spark.createDataFrame([(1, "u", PAGE, "t"), (1, None, PAGE, "t"), (2, "u", None, "t"), (None, "u", "", "t")], "page_id long, url string, html string, text string")
    out = H.extract(rows).collect()
    assert len(out) == 4 and sorted(len(r.text) for r in out)[:2] == [0, 0]
    assert H.extract(rows.limit(0)).count() == 0


def brute_neighbours(ids, v, queries, k):
    out = {}
    for q in queries:
        score = ann.cosines(v, v[ids.index(q)])
        order = sorted((i for i in range(len(ids)) if ids[i] != q), key=lambda i: (-score[i], ids[i]))[:k]
        out[q] = [(ids[i], score[i]) for i in order]
    return out


def test_recall_and_scores(spark):
    from lingweave.llm import queries

    d = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").orderBy("vec_id").collect()
    ids, v = [r.vec_id for r in rows], np.array([r.embedding for r in rows], float)
    truth = brute_neighbours(ids, v, [i for i in ids if i % 50 == 0], 5)
    got = {}
    for r in queries.op2_nearest_neighbours(spark, d).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == truth.keys()
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in truth[q]}) / 5 for q in truth])
    assert recall >= 0.95
    assert all(s == pytest.approx(ann.cosines(v[[ids.index(i)]], v[ids.index(q)])[0], abs=1e-12) for q in got for i, s in got[q])


def test_small_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.1]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0]), (None, [1.0, 1.0]), (2, [1.0, 0.0]), (100, [0.0, 0.0])]
    df = spark.createDataFrame([(i, x, 1.0) for i, x in rows], "vec_id long, embedding array<float>, score double")
    out = [(r.query_id, r["rank"], r.vec_id) for r in ann.search(df, F.col("id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert out == [(0, 1, 1), (0, 2, 2), (0, 3, 50), (0, 4, 3), (50, 1, 0), (50, 2, 1), (50, 3, 2), (50, 4, 3)]
    assert ann.search(df.limit(0), F.lit(True)).count() == 0


def test_very_large_and_small_components(spark):
    v = [(0, [1e300, 1e300]), (1, [1e-300, 1e-300]), (2, [1e300, 0.0]), (3, [-1e-170, 1e-170]), (4, [5e-324, 0.0])]
    out = ann.search(spark.createDataFrame(v, "vec_id long, embedding array<double>"), F.col("id") == 0, k=9).orderBy("rank").collect()
    assert [r.vec_id for r in out] == [1, 2, 4, 3] and [r.score for r in out] == pytest.approx([1, 0.5**0.5, 0.5**0.5, 0])


def test_a_vector_that_many_rows_share_is_one_pivot(spark):
    rng = np.random.default_rng(3)
    v = [[1.0] * 16 if i % 3 else rng.normal(size=16).tolist() for i in range(3000)]
    df = spark.createDataFrame([*enumerate(v)], "vec_id long, embedding array<double>")
    truth = brute_neighbours(range(3000), np.array(v), range(0, 3000, 60), 5)
    got = {}
    for r in ann.search(df, F.col("id") % 60 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(got[q] & {i for i, _ in truth[q]}) / 5 for q in truth]) >= 0.9
    hot = [r.vec_id for r in ann.search(df, F.col("id") == 1).orderBy("rank").collect()]
    assert hot == [2, 4, 5, 7, 8]


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    d = "/root/testdata/sf0.01"
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "toxicity", "jaccard_join", "decontamination", "bpe"]
    docs = spark.read.parquet(f"{d}/documents.parquet")
    extra = spark.createDataFrame([(10**6, "12 34 !!", "en", "s", 1), (10**6 + 1, None, "en", "s", 1), (10**6 + 2, "", None, None, None)], docs.schema)
    at = docs.union(extra)
    known = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    for name, stage in pipeline.STAGES:
        before = {r.doc_id for r in at.select("doc_id").collect()}
        out = stage(spark, at, d)
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        kept = {r.doc_id for r in after.select("doc_id").collect()}
        assert kept <= before and after.count() == len(kept)
        if name == "language_id":
            assert before - kept == {10**6, 10**6 + 1, 10**6 + 2}
        elif name == "toxicity":
            clean, toxic = ({i for i in before if known.get(i) == v} for v in (0, 1))
            assert len(clean - kept) <= 0.02 * len(clean) and len(toxic - kept) >= 0.7 * len(toxic)
        elif name == "jaccard_join":
            from lingweave.llm.jaccard_join import similarity_components

            components = {r.doc_id: r.component_id for r in similarity_components(at).collect()}
            assert kept == set(components.values())
        elif name == "decontamination":
            from lingweave.llm.decontaminate import contamination

            assert before - kept == {r.doc_id for r in contamination(at, spark.read.parquet(f"{d}/benchmark.parquet")).where("contaminated").collect()}
        if name != "bpe":
            assert after.columns == docs.columns
            at = after

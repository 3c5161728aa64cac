import json
import random

import pytest
from pyspark.sql import functions as F

from lingweave.config import AuditConfig
from lingweave.operators import audit as A
from lingweave.plans import stages
from lingweave.sources import corpus, sinks
from lingweave.streaming.audit import answer_stream


def plain_batches(sizes, max_chars, max_rows):
    out, rows, chars, index = [], 0, 0, 0
    for n in sizes:
        if rows and (rows >= max_rows or chars + n > max_chars):
            index, rows, chars = index + 1, 0, 0
        out.append(index)
        rows, chars = rows + 1, chars + n
    return out


@pytest.mark.parametrize(("max_chars", "max_rows"), [(60, 5), (30, 100), (1000, 1), (44, 3)])
def test_batches(spark, max_chars, max_rows):
    rng = random.Random(1)
    rows = [(s, i, "x" * rng.randint(0, 50), "y" * rng.randint(0, 30)) for s in ("train", "test") for i in range(80)]
    got = A.batches(spark.createDataFrame(rows, "split string, row_index long, pl string, en string"), max_chars, max_rows).orderBy("split", "row_index").collect()
    for s in ("train", "test"):
        own = [r for r in rows if r[0] == s]
        sizes = [len(f"id:{i} pl:{p} en:{e}") for _, i, p, e in own]
        assert [r.batch_index for r in got if r.split == s] == plain_batches(sizes, max_chars, max_rows)
    prompts = A.prompts(A.batches(spark.createDataFrame(rows, "split string, row_index long, pl string, en string"), max_chars, max_rows))
    first = prompts.where("split = 'test' and batch_index = 0").first()
    assert first.prompt.split("\n")[1] == f"id:0 pl:{rows[80][2]} en:{rows[80][3]}" and first.row_ids[0] == 0
    with pytest.raises(ValueError):
        A.batches(spark.createDataFrame(rows, "split string, row_index long, pl string, en string"), 10, 0)


def test_validation(spark):
    cases = [
        ('{"good":[0,1],"bad":[2],"uncertain":[]}', None, [0, 1], [2], []),
        ('{"good":["1",0,0],"bad":[],"uncertain":[]}', None, [0, 1], [], [2]),
        ('{"good":[0],"bad":[0],"uncertain":[]}', "id in two lists", None, None, None),
        ('{"good":[7],"bad":[],"uncertain":[]}', "foreign id", None, None, None),
        ('{"good":[0],"bad":[]}', "missing list", None, None, None),
        ('{"good":"0","bad":[],"uncertain":[]}', "missing list", None, None, None),
        ('{"good":["x"],"bad":[],"uncertain":[]}', "not a number", None, None, None),
        ("no json", "missing list", None, None, None),
        (None, "missing list", None, None, None),
    ]
    df = spark.createDataFrame([(i, c[0], [0, 1, 2]) for i, c in enumerate(cases)], "i int, raw string, ids array<int>")
    got = [(r.error, r.good, r.bad, r.uncertain) for r in A.validate(df).orderBy("i").collect()]
    assert got == [c[1:] for c in cases]


def test_settle_last_valid_wins(spark):
    rows = [
        ("s", 0, 1, [0, 1], None, [0], [], [1]), ("s", 0, 2, [0, 1], "missing list", None, None, None),
        ("s", 1, 1, [0, 1], "x", None, None, None),
        ("s", 2, 1, [0, 1], None, [0, 1], [], []), ("s", 2, 2, [0, 1], None, [], [0, 1], []),
    ]
    df = spark.createDataFrame(rows, "split string, batch_index int, attempt int, ids array<int>, error string, good array<int>, bad array<int>, uncertain array<int>")
    got = {r.batch_index: (r.attempts, r.good, r.bad, r.uncertain) for r in A.settle(df, 0.4).collect()}
    assert got == {0: (2, [0], [], [1]), 1: (1, [], [], [0, 1]), 2: (1, [0, 1], [], [])}


def test_label_files(spark, tmp_path):
    lines = ['{"s":"train","i":0,"l":2}', "", '{"split":"train","row_index":0,"label":"bad"}', '{"s":"other","i":1,"l":2}', "garbage", '{"s":"test","i":3,"l":1}', '{"s":"test","i":4,"l":9}']
    (tmp_path / "labels.jsonl").write_text("\n".join(lines))
    parsed = corpus.parse_labels(corpus.numbered_lines(spark, str(tmp_path / "labels.jsonl")))
    assert {(r.split, r.row_index, r.label) for r in corpus.last_labels(parsed).collect()} == {("train", 0, 0), ("test", 3, 1), ("test", 4, 9)}
    stats = {r.split: (r.loaded, r.duplicates, r.unknown_split) for r in corpus.label_load_stats(parsed).collect()}
    assert stats[None] == (4, 1, 1) and stats["train"] == (2, 1, 0)


def make_stub():
    """A generator of answers; made inside a function, so that it travels to workers by value."""

    def stub(prompt):
        lines = prompt.split("\n")[1:]
        return json.dumps({"good": [i for i, x in enumerate(lines) if "good" in x], "bad": [i for i, x in enumerate(lines) if "bad" in x], "uncertain": []})

    return stub


def raw_rows(spark):
    rows = [(s, i, ("word " * (i % 3 + 1) + ("good" if i % 2 else "bad"), f"text {i}")) for s in ("validation", "train") for i in range(9)]
    return spark.createDataFrame(rows, "split string, row_index long, translation struct<pl:string,en:string>")


def test_audit_end_to_end_and_resume(spark, tmp_path):
    config = AuditConfig(batch_max_chars=120, max_rows_per_batch=3)
    manifest = stages.audit(spark, raw_rows(spark), make_stub(), str(tmp_path / "audit"), config)
    assert manifest["totals"]["good"] == 8 and manifest["totals"]["bad"] == 10 and set(manifest["splits"]) == {"validation", "train"}
    labels = spark.read.json(str(tmp_path / "audit/labels/all"))
    assert labels.count() == 18 and labels.where("l = 2").count() == 8

    def never(prompt):
        raise AssertionError("asked again")

    again = stages.audit(spark, raw_rows(spark), never, str(tmp_path / "audit"), config, resume=True)
    assert again["totals"] == manifest["totals"]


def test_answer_stream(spark, tmp_path):
    batched = A.batches(raw_rows(spark).select("split", "row_index", "translation.pl", "translation.en"), 200, 3)
    A.prompts(batched).write.parquet(str(tmp_path / "prompts"))
    args = (spark, str(tmp_path / "prompts"), str(tmp_path / "out"), str(tmp_path / "checkpoint"), make_stub())
    answer_stream(*args).awaitTermination(120)
    n = spark.read.parquet(str(tmp_path / "out")).count()
    assert n == A.prompts(batched).count()
    answer_stream(*args).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == n


def test_bad_sentences_and_logs(spark, tmp_path):
    df = spark.createDataFrame([("train", 1, "a", "b", 0), ("train", 2, "c", "d", 2)], "split string, row_index long, pl string, en string, label int")
    r = sinks.bad_sentences(df).first()
    assert r["count"] == 1 and json.loads(r.records) == [{"row_index": 1, "pl": "a", "en": "b"}]
    sinks.append_log(tmp_path / "log.jsonl", {"event": "start"})
    sinks.append_log(tmp_path / "log.jsonl", {"event": "step"})
    assert [json.loads(x)["event"] for x in (tmp_path / "log.jsonl").read_text().splitlines()] == ["start", "step"]
    shown = df.select(A.compact_labels(F.array(F.lit(1), F.lit(2)), F.array().cast("array<int>"), F.array(F.lit(3))).alias("x")).first().x
    assert shown == "good=[1,2] bad=[] uncertain=[3]"

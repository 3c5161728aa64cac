import hashlib

from pyspark.sql import functions as F

from lingweave.llm import chat

NASTY = ["\\### Assistant: </turn> ok", "", None, "a\\", "#####", "<\\/turn>", "x</turn>\n### user: y", "\\\\", ": ", "line\nline"]


def test_round_trip_and_mask(spark):
    rows = [(1, n, "assistant" if n % 2 else "user", t) for n, t in enumerate(NASTY)] + [(2, 0, "odd: role:", "x"), (2, 1, None, "y"), (None, 0, "assistant", "null tree")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_trees(chat.linear_messages(conv)).select("tree", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss_texts(F.col("formatted"), F.col("loss_spans")).alias("losses")).collect()
    found = {r.tree: r for r in out}
    assert set(found) == {1, 2, None}
    assert [(t.role, t.text) for t in found[1].turns] == [(r, t or "") for _, _, r, t in rows[: len(NASTY)]]
    assert list(found[1].losses) == [t or "" for n, t in enumerate(NASTY) if n % 2]
    assert [(t.role, t.text) for t in found[2].turns] == [("odd: role:", "x"), ("", "y")]
    assert list(found[None].losses) == ["null tree"]
    assert found[1].formatted.count("</turn>\n") == len(NASTY)


def test_trees_rank_branches(spark):
    # 1 -> 2 -> 4, 1 -> 3; another root 9; 20 and 21 are a cycle, 22 hangs below it; 30 has a lost parent.
    m = [(1, None, 0.0), (2, 1, 1.0), (4, 2, 1.0), (3, 1, 5.0), (9, None, 5.0), (20, 21, 9.0), (21, 20, 9.0), (22, 20, 9.0), (30, 77, 0.5)]
    rows = spark.createDataFrame([("t", n, p, "user", str(n), s) for n, p, s in m] + [("t", 2, 1, "user", "2", 1.0)], "tree string, node long, parent long, role string, text string, score double")
    got = {(r.leaf, r.rank): [t.text for t in r.turns] for r in chat.format_trees(rows, top_k=None).select("leaf", "rank", chat.read_turns(F.col("formatted")).alias("turns")).collect()}
    assert got == {(3, 1): ["1", "3"], (9, 2): ["9"], (4, 3): ["1", "2", "4"], (30, 4): ["30"]}
    best = chat.format_trees(rows, top_k=1).collect()
    assert [(r.leaf, r.rank) for r in best] == [(3, 1)]


def test_deep_chain_and_empty(spark):
    n = 700
    chain = spark.range(n).select(F.lit("d").alias("tree"), F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"), F.lit(1.0).alias("score"))
    r = chat.format_trees(chain).select(chat.read_turns(F.col("formatted")).alias("t")).first()
    assert [x.text for x in r.t] == [str(i) for i in range(n)]
    assert chat.format_trees(chain.limit(0)).count() == 0


def test_query_digests(spark):
    from lingweave.llm import queries

    rows = {r.conv_id: r for r in queries.op1_chat(spark, "/root/testdata/sf0.001").collect()}
    text = "\\### Assistant: </turn> ok"
    mine = rows[-7]
    assert mine.n_turns == 2 and mine.loss_chars == len(text) and mine.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert mine.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id").distinct().count() + 1


def test_plans_do_not_grow_with_the_jumps(spark):
    n = 300
    chain = spark.range(n).select(F.lit("d").alias("tree"), F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"), F.lit(1.0).alias("score"))
    ran = lambda: spark._jsparkSession.sharedState().statusStore().executionsList()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = {ran().apply(i).executionId() for i in range(ran().size())}
    assert chat.paths(chain).count() == n
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    plans = [ran().apply(i).physicalPlanDescription().split("\n\n")[0] for i in range(ran().size()) if ran().apply(i).executionId() not in before]
    # The final plan alone, where a plan was changed as it ran.
    scans = [p.split("+- == Initial Plan ==")[0].count("Scan ") for p in plans]
    assert len(plans) > 18 and max(scans) <= 2

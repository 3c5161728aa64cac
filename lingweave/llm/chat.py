"""Reply trees to conversations, with DataFrame operations alone.

Messages name their parent; iterative self-joins over ever longer jumps (each doubles the last) give every node its distance from the root and
the sum of scores on the way.  The leaves of each tree are ranked by that sum, and the same jumps, from the longest to the shortest, list the nodes of
each chosen path.  Each path becomes one conversation.

The template writes a turn as ``### role: text</turn>`` and a newline.  Inside roles and texts, a backslash is doubled, ``##`` becomes ``#\\#`` and
``</turn>`` becomes ``<\\/turn>``, so no text can forge a turn; in roles ``: `` becomes ``:\\ `` besides.  Reading drops one backslash of each pair and any other that stands before
a character.

Defined results: a null role or text is empty; a null tree is a tree of its own; repeated messages (same tree and node) count once, the least by role and text; a node whose
parent is missing or null is a root; nodes on or below a cycle of parents have no root and give no path; equal sums are ranked by the smaller leaf; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import checkpointed, discard_path, quoted, scratch_path

#: The template's control strings and how they are written inside texts.
TURN_START, ROLE_END, TURN_END = "### ", ": ", "</turn>\n"
ESCAPES = (("\\", "\\\\"), ("##", "#\\#"), ("</turn>", "<\\/turn>"))
ROLE_ESCAPE = (": ", ":\\ ")


def escape(text: Column) -> Column:
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), ESCAPES, text)


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(ROLE_ESCAPE[0]), F.lit(ROLE_ESCAPE[1]))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


class Steps:
    """The rows that an iteration adds, one folder of Parquet a step below one path of the shared folder.

    However many steps there were, reading them is one scan of a plan (a union of them all grows with each step, and with it what the driver holds), and a condition
    on ``step`` and the ``parts`` columns picks folders.
    """

    def __init__(self, spark: SparkSession, name: str, first: DataFrame, *parts: str):
        self.spark, self.path, self.parts, self.schema, self.size = spark, scratch_path(spark, name), parts, first.schema, 0
        self.columns = [c for c in first.columns if c not in parts]
        self.add(first)

    def add(self, rows: DataFrame) -> None:
        rows.write.partitionBy(*self.parts).parquet(f"{self.path}/step={self.size}")
        self.size += 1

    def read(self, which: Column | None = None) -> DataFrame:
        rows = self.spark.read.schema(StructType([*self.schema, StructField("step", IntegerType())])).parquet(self.path)
        return (rows if which is None else rows.where(which)).select(*self.columns)

    def discard(self) -> None:
        discard_path(self.spark, self.path)


def paths(messages: DataFrame, top_k: int | None = 1) -> DataFrame:
    """The ``top_k`` best root-to-leaf paths (None: all) of each tree in ``tree, node, parent, score``: ``tree, leaf, rank, node, up`` (steps from the leaf up)."""
    spark = messages.sparkSession
    nodes = messages.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    known = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    jump = nodes.join(known, (F.col("tree") == F.col("t")) & (F.col("parent") == F.col("n")), "left")
    # The node one step up (null above the root) and the sum of scores of the nodes passed.
    jump = jump.select("tree", "node", F.col("n").alias("up"), "score")
    jumps = Steps(spark, "jumps", jump.withColumn("done", F.col("up").isNull()), "done")
    largest = jumps.read().groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    # Only nodes whose jump has not yet passed the root go on; on a cycle that never happens, and the length ends it.
    last, length = 0, 1
    while length < largest:
        at = jumps.read(F.col("done") | (F.col("step") == last)).select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("up2"), F.col("score").alias("score2"))
        going = jumps.read((F.col("step") == last) & ~F.col("done"))
        joined = going.join(at, (F.col("tree") == F.col("t")) & (F.col("up") == F.col("n")))
        longer = joined.select("tree", "node", F.col("up2").alias("up"), (F.col("score") + F.col("score2")).alias("score"))
        jumps.add(longer.withColumn("done", F.col("up").isNull()))
        last, length = last + 1, 2 * length
    parents = jumps.read((F.col("step") == 0) & ~F.col("done")).select("tree", F.col("up").alias("node")).distinct()
    leaves = jumps.read(F.col("done")).join(parents, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "score")
    ranked = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")))
    if top_k is not None:
        ranked = ranked.where(F.col("rank") <= top_k)
    found = Steps(spark, "paths", ranked.select("tree", "leaf", "rank", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("up")))
    for k in reversed(range(last + 1)):
        hop = jumps.read((F.col("step") == k) & ~F.col("done")).select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("above"))
        higher = found.read().join(hop, (F.col("tree") == F.col("t")) & (F.col("node") == F.col("n")))
        found.add(higher.select("tree", "leaf", "rank", F.col("above").alias("node"), (F.col("up") + 2**k).alias("up")))
    jumps.discard()
    return found.read()


def format_trees(messages: DataFrame, tree_col: str = "tree", node_col: str = "node", parent_col: str = "parent", role_col: str = "role", text_col: str = "text", score_col: str | None = "score", top_k: int | None = 1, loss_role: str = "assistant") -> DataFrame:
    """One row per chosen path: ``tree, leaf, rank, formatted, loss_spans`` (array of ``start, length``, code points of ``formatted`` under the loss mask)."""
    c = lambda n: F.col(quoted(n))
    # A key that is never null: joins and groups then need no care for null trees.
    key = F.struct(c(tree_col).alias("id"))
    whole = messages.select(key.alias("tree"), c(node_col).alias("node"), c(parent_col).alias("parent"), F.coalesce(c(role_col), F.lit("")).alias("role"), F.coalesce(c(text_col), F.lit("")).alias("text"), (c(score_col) if score_col else F.lit(0.0)).alias("score")).where("node is not null")
    rows = checkpointed(whole.groupBy("tree", "node").agg(F.min(F.struct("role", "text", "parent", "score")).alias("m")).select("tree", "node", "m.*"))
    on_path = paths(rows.select("tree", "node", "parent", "score"), top_k)
    turns = on_path.join(rows.select("tree", "node", "role", "text"), ["tree", "node"])
    head = F.concat(F.lit(TURN_START), escape_role(F.col("role")), F.lit(ROLE_END))
    body = escape(F.col("text"))
    turns = turns.select("tree", "leaf", "rank", "up", head.alias("head"), body.alias("body"), (F.col("role") == loss_role).alias("lossy"))
    order = Window.partitionBy("tree", "leaf", "rank").orderBy(F.desc("up"))
    size = F.length("head") + F.length("body") + len(TURN_END)
    placed = turns.withColumn("start", F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.length("head"))
    one = placed.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("place"), F.concat("head", "body", F.lit(TURN_END)).alias("turn"), F.col("start").cast("long").alias("start"), F.length("body").cast("long").alias("length"), "lossy"))).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["lossy"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))
    return one.select(F.col("tree.id").alias("tree"), "leaf", "rank", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns read back from a formatted conversation: array of ``role, text``."""
    pieces = F.split(formatted, TURN_END, -1)
    cut = lambda p: F.instr(p, ROLE_END)
    return F.transform(
        F.slice(pieces, F.lit(1), F.size(pieces) - 1),
        lambda p: F.struct(unescape(F.substr(p, F.lit(len(TURN_START) + 1), cut(p) - len(TURN_START) - 1)).alias("role"), unescape(F.substr(p, cut(p) + len(ROLE_END))).alias("text")),
    )


def read_loss_texts(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, in order."""
    return F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))


def linear_messages(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows by turn as reply trees of one branch: each message answers the one before it (equal turns go by role and text)."""
    c = lambda n: F.col(quoted(n))
    order = Window.partitionBy(c(conv_col)).orderBy(c(turn_col), c(role_col), c(text_col))
    numbered = conversations.select(c(conv_col).alias("tree"), c(role_col).alias("role"), c(text_col).alias("text"), F.row_number().over(order).cast("long").alias("node"))
    return numbered.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(0.0))

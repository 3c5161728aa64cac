"""The audit: budgeted batches, prompts, answers and their checks, labels, and resuming."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import AuditConfig
from ..functions import text as X

ANSWER = "good array<string>, bad array<string>, uncertain array<string>"
HEADER = (
    "You check sentence pairs of a parallel corpus. Each line holds an id, the source after pl: and the target after en:. "
    'Answer with one JSON object {"good": [...], "bad": [...], "uncertain": [...]} that puts every id in exactly one list: '
    "good if the target translates the source, bad if it does not or is damaged, uncertain otherwise."
)


def line_size() -> Column:
    """Characters of a prompt line that carries the row's own id."""
    return F.length(X.prompt_line(F.col("row_index"), F.col("pl"), F.col("en")))


def batches(records: DataFrame, max_chars: int, max_rows: int) -> DataFrame:
    """Adds ``batch_index`` and ``local_id`` (both by split) to ``split, row_index, pl, en``.

    A batch ends before the row that would exceed either limit; a row over the budget stands alone.  Where a batch ends depends on all rows before it, so the lengths of
    each split are one stream through a task, which holds a counter and no rows; the texts are joined back and never meet in one task.
    """
    if max_rows < 1:
        raise ValueError("a batch needs room for a row")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, index, rows, chars = None, 0, 0, 0
        for part in parts:
            found, local = [], []
            for s, n in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True):
                if s != split:
                    split, index, rows, chars = s, 0, 0, 0
                elif rows and (rows >= max_rows or chars + n > max_chars):
                    index, rows, chars = index + 1, 0, 0
                found.append(index)
                local.append(rows)
                rows, chars = rows + 1, chars + n
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(found, pa.int32()), pa.array(local, pa.int32())], ["split", "row_index", "batch_index", "local_id"])

    rows = records.select("split", F.col("row_index").cast("long").alias("row_index"), "pl", "en")
    lines = rows.select("split", "row_index", line_size().cast("int").alias("n"))
    dealt = lines.repartition("split").sortWithinPartitions("split", "row_index").mapInArrow(run, "split string, row_index long, batch_index int, local_id int")
    return rows.join(dealt, ["split", "row_index"])


def prompts(batched: DataFrame) -> DataFrame:
    """``split, batch_index, size, row_ids, prompt`` of each batch; lines carry local ids."""
    line = F.struct("local_id", "row_index", X.prompt_line(F.col("local_id"), F.col("pl"), F.col("en")).alias("line"))
    grouped = batched.groupBy("split", "batch_index").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    return grouped.select("split", "batch_index", F.size("lines").alias("size"), F.transform("lines", lambda x: x["row_index"]).alias("row_ids"), F.concat(F.lit(HEADER + "\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("prompt"))


def validate(answers: DataFrame, raw: str = "raw", ids: str = "ids") -> DataFrame:
    """Checks answers against their batches: adds ``error`` (null if valid) and ``good, bad, uncertain`` (sorted, distinct; ids without verdict are uncertain).

    All three lists must be there and hold whole numbers, no id may stand in two, and every id must be one of the batch.
    """
    parsed = answers.withColumn("_j", F.from_json(raw, ANSWER))
    lists = ("good", "bad", "uncertain")
    for n in lists:
        parsed = parsed.withColumn(f"_{n}", F.transform(F.col(f"_j.{n}"), lambda x: F.expr("1") * F.when(x.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(x)).cast("int")))
    whole = F.array_union(F.array_union("_good", "_bad"), "_uncertain")
    bad_number = F.lit(False)
    for n in lists:
        bad_number = bad_number | F.exists(f"_{n}", lambda x: x.isNull())
    given = F.lit(False)
    for n in lists:
        given = given | F.col(f"_j.{n}").isNull()
    overlap = (F.size(F.array_intersect("_good", "_bad")) > 0) | (F.size(F.array_intersect("_good", "_uncertain")) > 0) | (F.size(F.array_intersect("_bad", "_uncertain")) > 0)
    error = F.when(F.col("_j").isNull() | given, "missing list").when(bad_number, "not a number").when(overlap, "id in two lists").when(F.size(F.array_except(whole, F.col(ids))) > 0, "foreign id")
    out = parsed.withColumn("error", error)
    tidy = lambda c: F.array_sort(F.array_distinct(c))
    valid = lambda c: F.when(F.col("error").isNull(), c)
    rest = F.array_except(F.col(ids), whole)
    out = out.withColumns({"good": valid(tidy("_good")), "bad": valid(tidy("_bad")), "uncertain": valid(tidy(F.array_union("_uncertain", rest)))})
    return out.drop("_j", "_good", "_bad", "_uncertain")


def needs_rerun(uncertain: Column, total: Column, threshold: float) -> Column:
    return F.when(total <= 0, True).otherwise(uncertain / total > threshold)


def uncertain_ratio(uncertain: Column, total: Column) -> Column:
    return F.round(uncertain / F.greatest(F.lit(1), total), 4)


def settle(attempts: DataFrame, threshold: float) -> DataFrame:
    """The outcome of each batch from its attempts ``split, batch_index, attempt, ids, error, good, bad, uncertain``.

    Attempts after the first valid one that needs no rerun did not happen; of the others the last valid one counts; without any, all ids are uncertain.
    """
    enough = F.col("error").isNull() & ~needs_rerun(F.size("uncertain"), F.size("ids"), threshold)
    batch = Window.partitionBy("split", "batch_index").orderBy("attempt")
    stopped = F.coalesce(F.max(enough.cast("int")).over(batch.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) > 0
    made = attempts.withColumn("stopped", stopped).where("not stopped")
    last = F.max_by(F.when(F.col("error").isNull(), F.struct("good", "bad", "uncertain")), F.when(F.col("error").isNull(), F.col("attempt")))
    grouped = made.groupBy("split", "batch_index").agg(F.first("ids").alias("ids"), F.count("*").alias("attempts"), last.alias("r"))
    none = F.array().cast("array<int>")
    return grouped.select("split", "batch_index", "ids", "attempts", F.coalesce("r.good", none).alias("good"), F.coalesce("r.bad", none).alias("bad"), F.when(F.col("r").isNull(), F.col("ids")).otherwise(F.col("r.uncertain")).alias("uncertain"))


def expand_labels(outcomes: DataFrame, row_ids: str = "row_ids") -> DataFrame:
    """``split, batch_index, row_index, label`` from local verdicts: 2 good, 0 bad, 1 uncertain or without verdict."""
    rows = outcomes.select("split", "batch_index", "good", "bad", F.posexplode(row_ids).alias("local", "row_index"))
    return rows.select("split", "batch_index", "row_index", F.when(F.array_contains("good", F.col("local")), 2).when(F.array_contains("bad", F.col("local")), 0).otherwise(1).alias("label"))


def label_counts(labels: DataFrame) -> DataFrame:
    """``split`` (null: all), ``good, bad, uncertain``."""
    return labels.rollup("split").agg(F.count_if(F.col("label") == 2).alias("good"), F.count_if(F.col("label") == 0).alias("bad"), F.count_if(F.col("label") == 1).alias("uncertain"))


def running_totals(labels: DataFrame) -> DataFrame:
    """Verdicts of each split up to each batch: ``split, batch_index, good, bad, uncertain``."""
    per_batch = labels.groupBy("split", "batch_index").agg(*[F.count_if(F.col("label") == v).alias(n) for n, v in (("good", 2), ("bad", 0), ("uncertain", 1))])
    so_far = Window.partitionBy("split").orderBy("batch_index")
    return per_batch.select("split", "batch_index", *[F.sum(n).over(so_far).alias(n) for n in ("good", "bad", "uncertain")])


def compact_labels(good: Column, bad: Column, uncertain: Column) -> Column:
    show = lambda n, c: F.concat(F.lit(f"{n}=["), F.array_join(c.cast("array<string>"), ","), F.lit("]"))
    return F.concat_ws(" ", show("good", good), show("bad", bad), show("uncertain", uncertain))


def rewind(labels: DataFrame, batch_log: DataFrame, split: str) -> tuple[DataFrame, DataFrame]:
    """Labels and batch log of an interrupted run without the split's last batch: its log line and its last ``size`` label lines go (``line_no`` tells order)."""
    own = F.col("split") == split
    last = batch_log.where(own).agg(F.max("line_no").alias("_line"), F.max_by("size", "line_no").alias("_size"))
    log = batch_log.join(F.broadcast(last), how="left").where(~own | (F.col("line_no") != F.col("_line"))).select(*batch_log.columns)
    backwards = Window.partitionBy("split").orderBy(F.desc("line_no"))
    mine = labels.where(own).withColumn("_back", F.row_number().over(backwards)).join(F.broadcast(last), how="left").where(F.col("_back") > F.coalesce("_size", F.lit(0)))
    return labels.where(~own).unionByName(mine.select(*labels.columns)), log


def pending(batch_rows: DataFrame, done: DataFrame) -> DataFrame:
    """Batches that no log line covers."""
    return batch_rows.join(done.select("split", "batch_index").distinct(), ["split", "batch_index"], "left_anti")


def resume_from(batch_rows: DataFrame, order: tuple[str, ...], split: str, batch_index: int) -> DataFrame:
    """Batches from a position on: later splits in order, and the split itself from ``batch_index``."""
    later = order[order.index(split) + 1 :]
    return batch_rows.where(F.col("split").isin(*later) | (F.col("split") == split) & (F.col("batch_index") >= batch_index))


def replayed(labels: DataFrame) -> DataFrame:
    """Labels of an earlier run, the first of each row: ``split, row_index, label``; texts are not in the log."""
    return labels.groupBy("split", "row_index").agg(F.min_by("label", "line_no").alias("label"))


def http_generate(config: AuditConfig, timeout: float = 180.0) -> Callable[[str], str]:
    """A ``generate`` that posts prompts to a text-generation endpoint and returns its answer."""

    def generate(prompt: str) -> str:
        body = json.dumps({"model": config.model, "prompt": prompt, "format": "json", "stream": False, "options": {"temperature": config.temperature}}).encode()
        request = urllib.request.Request(config.endpoint, data=body, headers={"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return json.loads(answer.read().decode("utf-8")).get("response", "")

    return generate


def ask(prompted: DataFrame, generate: Callable[[str], str], config: AuditConfig) -> DataFrame:
    """Sends each prompt, again while the answer is invalid or too uncertain: ``split, batch_index, attempt, ids, row_ids, raw``.

    Whether to ask again is decided here in Python, as the next call depends on it; what counts is decided by ``validate`` and ``settle``.
    """
    tries, threshold = max(1, config.max_batch_retries + 1), config.uncertain_ratio_rerun_threshold

    def good_enough(raw: str | None, size: int) -> bool:
        try:
            found = json.loads(raw or "")
            lists = [{int(x) for x in found[n]} for n in ("good", "bad", "uncertain")]
        except (ValueError, TypeError, KeyError):
            return False
        seen = set().union(*lists)
        if sum(map(len, lists)) != len(seen) or not seen <= set(range(size)) or not size:
            return False
        return (len(lists[2]) + size - len(seen)) / size <= threshold

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for split, index, rows, prompt in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                for attempt in range(1, tries + 1):
                    try:
                        raw = generate(prompt)
                    except Exception as failure:  # noqa: BLE001  any failed call is a failed attempt
                        raw = f"error: {failure}"
                    yield pa.RecordBatch.from_pydict({"split": [split], "batch_index": pa.array([index], pa.int32()), "attempt": pa.array([attempt], pa.int32()), "ids": pa.array([list(range(len(rows)))], pa.list_(pa.int32())), "row_ids": pa.array([rows], pa.list_(pa.int64())), "raw": [raw]})
                    if good_enough(raw, len(rows)):
                        break

    return prompted.select("split", "batch_index", "row_ids", "prompt").mapInArrow(run, "split string, batch_index int, attempt int, ids array<int>, row_ids array<long>, raw string")

"""The row classifier of the cleaning stage: content reasons, leakage, first-wins deduplication, labels.

Every pair is summarised once under a digest of its normalised texts: the first row of each split that holds it.  That summary, which partial aggregation shrinks before it is
shuffled, answers both whether a training row leaks and whether an earlier row already claimed the pair.  It is joined back to the rows; a pair that a third of all
rows share then makes one large partition of a join, which adaptive execution splits, and no window ever holds it.  Null and empty rows carry no digest and meet nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SPLITS, CleaningConfig, PreauditConfig
from ..functions import text as X

#: The reasons in order of priority, which is also the order in which they are listed.
REASONS = ("null_pair", "empty_pair", "identical_source_target", "min_words", "max_words", "length_ratio", "train_pair_present_in_validation_or_test", "duplicate")
ACCEPT_GOOD, ACCEPT_GOOD_AND_UNCERTAIN = (2,), (2, 1)


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is evaluated once a row: projections that read it are merged with each other, but not with a generator's output."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def _sized(rows: DataFrame, count=X.word_count_single_spaced) -> DataFrame:
    """Adds the word counts ``_a`` and ``_b`` of both texts, so that the rules below need not repeat how texts are made."""
    return rows.withColumns({"_a": count(F.col("pl")), "_b": count(F.col("en"))})


def _content_reasons(config: CleaningConfig | PreauditConfig) -> list[tuple[str, Column]]:
    """Predicates on a sized pair of non-empty texts."""
    a, b = F.col("_a"), F.col("_b")
    ratio = F.greatest(a, b).cast("double") / F.greatest(F.lit(1), F.least(a, b))
    found = [("identical_source_target", F.col("pl") == F.col("en"))] if config.remove_identical_pairs else []
    return [*found, ("min_words", F.least(a, b) < config.min_words), ("max_words", F.greatest(a, b) > config.max_words), ("length_ratio", ratio > config.max_length_ratio)]


def normalised(rows: DataFrame, config: CleaningConfig) -> DataFrame:
    """Rows of ``split, row_index, pl, en`` with texts normalised and ``missing`` (a text was null); null texts read as empty."""
    out = rows.withColumn("missing", F.col("pl").isNull() | F.col("en").isNull()).withColumns({c: F.coalesce(c, F.lit("")) for c in ("pl", "en")})
    if config.unicode_form:
        out = X.normalise_form(out, ["pl", "en"], config.unicode_form)
    step = lambda c: X.normalise(c, config.remove_control_chars, config.collapse_whitespace, config.strip_whitespace)
    both = _once(out, "_both", F.transform(F.array("pl", "en"), lambda c: F.when(F.col("missing"), "").otherwise(step(c))))
    return both.withColumns({"pl": F.get("_both", F.lit(0)), "en": F.get("_both", F.lit(1))}).drop("_both")


def classify(rows: DataFrame, config: CleaningConfig = CleaningConfig(), normalise: bool = True, carried: tuple[str, ...] = ()) -> DataFrame:
    """``split, row_index, pl, en, all_reasons, reason`` for each row of ``split, row_index, pl, en``: ``reason`` is null for rows that stay.  Columns named in ``carried`` come along.

    A row leaks if it trains and any non-empty held-out row has its pair, be that one rejected or not.  A row is a duplicate if a row before it, in the order of the
    configuration, has its pair, passed the content rules and did not leak.
    """
    base = normalised(rows, config) if normalise else rows
    count = X.word_count_single_spaced if config.collapse_whitespace and config.strip_whitespace else X.word_count
    base, checks = _sized(base, count), _content_reasons(config)
    rank = F.element_at(F.create_map(*[F.lit(x) for i, s in enumerate(config.order) for x in (s, i)]), F.col("split"))
    empty = (F.col("pl") == "") | (F.col("en") == "")
    kept_text = ~(F.col("missing") | empty)
    failing = F.array_compact(F.array(*[F.when(predicate, F.lit(name)) for name, predicate in checks]))
    base = _once(base.select("split", rank.alias("split_rank"), "row_index", "pl", "en", "missing", "_a", "_b", *carried), "failing", failing).drop("_a", "_b")
    staged = base.select(*carried, "split", "split_rank", "row_index", "pl", "en", "missing", "failing", empty.alias("empty"), F.when(kept_text, F.size("failing") == 0).alias("ok"), F.when(kept_text, F.md5(X.pair_key(F.col("pl"), F.col("en")))).alias("key"))
    firsts = [F.min(F.when(F.col("split_rank") == r, F.col("row_index"))).alias(f"first_{r}") for r in range(len(config.order))]
    pairs = staged.groupBy("key").agg(*firsts)
    joined = staged.join(pairs.withColumnRenamed("key", "pair"), _spread(F.col("key")) == F.col("pair"), "left")

    train = config.order.index("train")
    held = [F.col(f"first_{r}").isNotNull() for r in range(len(config.order)) if r != train]
    in_held = held[0] | held[1]
    leak = (F.col("split") == "train") & in_held if config.remove_leaked_train_pairs else F.lit(False)
    # The first row that may claim the pair: leaked training rows may not.
    first = [F.when(~in_held, F.col(f"first_{r}")) if r == train and config.remove_leaked_train_pairs else F.col(f"first_{r}") for r in range(len(config.order))]
    if config.dedup_scope == "global":
        earlier = F.lit(False)
        for r, f in enumerate(first):
            earlier = earlier | (f.isNotNull() & ((F.col("split_rank") > r) | (F.col("split_rank") == r) & (F.col("row_index") > f)))
    else:
        own = first[-1]
        for r in range(len(first) - 1):
            own = F.when(F.col("split_rank") == r, first[r]).otherwise(own)
        earlier = own.isNotNull() & (F.col("row_index") > own)
    duplicate = F.coalesce(F.col("ok") & earlier, F.lit(False))
    late = F.array_compact(F.array(F.when(leak, F.lit(REASONS[6])), F.when(duplicate, F.lit(REASONS[7]))))
    reasons = F.when(F.col("missing"), F.array(F.lit("null_pair"))).when(F.col("empty"), F.array(F.lit("empty_pair"))).otherwise(F.concat("failing", late))
    return joined.select("split", "split_rank", "row_index", "pl", "en", *carried, reasons.alias("all_reasons")).withColumn("reason", F.get("all_reasons", F.lit(0)))


def _spread(key: Column) -> Column:
    """A digest to join by: rows without one get a value of their own that nothing matches, so they do not meet in one task.

    (Nor are they filtered before the summary: the optimiser would write the whole making of the texts into that filter.  They make one group there.)
    """
    return F.coalesce(key, F.concat_ws("-", F.col("split"), F.col("row_index").cast("string")))


def raw_texts(rows: DataFrame) -> DataFrame:
    """``split, row_index, pl, en`` of raw rows with a ``translation`` struct; a null struct has null texts."""
    return rows.select("split", "row_index", F.col("translation.pl").alias("pl"), F.col("translation.en").alias("en"))


def preaudit(rows: DataFrame, config: PreauditConfig = PreauditConfig()) -> DataFrame:
    """``split, row_index, pl, en, reason`` of rows with ``present`` (the struct is not null): sanitised texts and the first failing rule, null for rows that stay.

    A null text of a present struct reads ``None``.  Of equal pairs in a split the first that passes the rules stays.
    """
    prepared = rows.select("split", "row_index", "present", *[F.coalesce(c, F.lit("None")).alias(c) for c in ("pl", "en")])
    bracket = X.drop_bracketed if config.remove_square_bracket_content else (lambda c: c)
    # Both texts pass one chain of patterns as an array: written out for each, the chain outgrows a generated method.
    both = _once(prepared, "_both", F.transform(F.array("pl", "en"), lambda c: X.sanitise(bracket(c))))
    clean = _sized(both.withColumns({"pl": F.get("_both", F.lit(0)), "en": F.get("_both", F.lit(1))}))
    rule = F.when(~F.col("present"), "null_pair").when((F.col("pl") == "") | (F.col("en") == ""), "empty_pair")
    for name, predicate in _content_reasons(config):
        rule = rule.when(predicate, name)
    ruled = _once(clean, "rule", rule)
    if not config.deduplicate_pairs:
        return ruled.select("split", "row_index", "pl", "en", F.col("rule").alias("reason"))
    keyed = ruled.withColumn("key", F.when(F.col("rule").isNull(), F.md5(X.pair_key(F.col("pl"), F.col("en")))))
    first = keyed.groupBy("split", "key").agg(F.min("row_index").alias("first")).select(F.col("split").alias("of"), F.col("key").alias("pair"), "first")
    return keyed.join(first, (F.col("split") == F.col("of")) & (_spread(F.col("key")) == F.col("pair")), "left").select("split", "row_index", "pl", "en", F.when(F.col("row_index") > F.col("first"), "duplicate_pair").otherwise(F.col("rule")).alias("reason"))


def classify_labelled(rows: DataFrame, labels: DataFrame, config: CleaningConfig = CleaningConfig(), audit: PreauditConfig = PreauditConfig(), accepted: tuple[int, ...] = ACCEPT_GOOD) -> DataFrame:
    """The cleaning stage with audit labels: ``split, row_index, pl, en, label, all_reasons, reason``.

    Rows pass the audit's own rules (their reasons get the prefix ``preaudit_``), then need an accepted label; what is left is normalised again and classified.  Only accepted
    held-out rows guard against leakage.
    """
    accepted = accepted or ACCEPT_GOOD
    audited = preaudit(rows, audit)
    labelled = audited.join(labels.select("split", "row_index", "label"), ["split", "row_index"], "left")
    before = F.when(F.col("reason").isNotNull(), F.concat(F.lit("preaudit_"), F.col("reason"))).when(F.col("label").isNull(), "missing_llm_label").when(~F.col("label").isin(*accepted), "llm_label_not_kept")
    labelled = _once(labelled, "before", before)
    # Stopped rows go through the classifier without texts, so they meet nothing there; theirs are put back behind it.
    split_up = {c: F.when(F.col("before").isNull(), F.col(c)) for c in ("pl", "en")} | {f"_{c}": F.when(F.col("before").isNotNull(), F.col(c)) for c in ("pl", "en")}
    found = classify(labelled.select("split", "row_index", "before", "label", *[c.alias(name) for name, c in split_up.items()]), config, carried=("before", "label", "_pl", "_en"))
    texts = [F.coalesce(f"_{c}", c).alias(c) for c in ("pl", "en")]
    found = found.select("split", "row_index", *texts, "label", F.when(F.col("before").isNotNull(), F.array("before")).otherwise(F.col("all_reasons")).alias("all_reasons"))
    return found.withColumn("reason", F.get("all_reasons", F.lit(0)))


def reason_counts(classified: DataFrame) -> DataFrame:
    """Rows removed by primary reason: ``split`` (null: all splits), ``reason, n``."""
    removed = classified.where("reason is not null")
    return removed.groupingSets([[F.col("split"), F.col("reason")], [F.col("reason")]], F.col("split"), F.col("reason")).agg(F.count("*").alias("n"))


def split_totals(classified: DataFrame) -> DataFrame:
    """``split`` (null: all), ``rows_in, rows_out, removed_total, retention_ratio``."""
    counted = classified.rollup("split").agg(F.count("*").alias("rows_in"), F.count_if(F.col("reason").isNull()).alias("rows_out"))
    return counted.select("split", "rows_in", "rows_out", (F.col("rows_in") - F.col("rows_out")).alias("removed_total"), F.round(F.col("rows_out") / F.greatest(F.lit(1), F.col("rows_in")), 6).alias("retention_ratio"))


def reason_map(classified: DataFrame) -> DataFrame:
    """``split, primary_reason_counts`` as a map sorted by key."""
    counts = classified.where("reason is not null").groupBy("split", "reason").agg(F.count("*").alias("n"))
    return counts.groupBy("split").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("reason", "n")))).alias("primary_reason_counts"))


def without_leaks(train: DataFrame, heldout: DataFrame) -> DataFrame:
    """Training pairs that no held-out pair equals; repeats stay."""
    keys = heldout.select("pl", "en").distinct()
    return train.join(keys, ["pl", "en"], "left_anti")


def heldout_pairs(rows: DataFrame) -> DataFrame:
    """Distinct pairs of validation and test."""
    return rows.where(F.col("split").isin(*SPLITS[1:])).select("pl", "en").distinct()

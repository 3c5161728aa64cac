"""Benchmark decontamination by a positional inverted index, with DataFrame operations alone.

A first pass counts, over all documents, the terms that occur in benchmark items.  Every window of an item names its rarest term and the second rarest: its
anchors.  A second pass stores the postings (document and place) of the anchors' terms.  The list of the rarest term is intersected with that of the second, adjusted by their
offset; only documents in which both meet are read again, and there the words around the anchor are compared to the item's, which gives the exact run of equal words.  A run as
long as a window is a hit; any window inside a run has its own anchors there or elsewhere, so the union of runs is exact.

Terms that no document has make their windows impossible, and a frequent term is an anchor only where a window has nothing rarer.

Defined results: a null text has no words; an item or document without words has no windows; items with a null id take no part; items that repeat an
id count once; documents that repeat an id get a row each, judged by their own texts; an empty benchmark leaves every document clean; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER, by_keys, checkpointed, discard, quoted, stored, text_or_empty

#: Parameters: words of a window; bytes of terms that are broadcast at once (more go through in blocks, each a pass of its own).
WINDOW, BLOCK_BYTES = 13, 16 << 20

#: What separates words, as a pattern and as characters (before A-Z are folded).
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SEPARATOR_CHARS = "".join(map(chr, (*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80))))


def words(text: Column) -> Column:
    """The words of a text.  Splitting at separators, once the ends are trimmed, is several times faster than extracting matches."""
    inner = F.btrim(text, F.lit(SEPARATOR_CHARS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SEPARATORS))


def in_blocks(terms: DataFrame, column: str = "term") -> list[DataFrame]:
    """Stored rows of ``term`` in blocks that may be broadcast: their size is measured, and each block is bounded by ``BLOCK_BYTES``."""
    total = terms.agg(F.sum(F.octet_length(column) + 48)).first()[0] or 0
    n = -(-total // BLOCK_BYTES) or 1
    return [terms if n == 1 else terms.where(F.pmod(F.xxhash64(column), F.lit(n)) == i) for i in range(n)]


def folded(word: Column) -> Column:
    """Lower-cases A-Z alone."""
    ascii_only = F.octet_length(word) == F.length(word)
    return F.when(ascii_only, F.lower(word)).otherwise(F.translate(word, ASCII_UPPER, ASCII_LOWER))


def anchors(documents: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The anchors of all windows: ``term, item_id, other, shift`` (the second rarest term and its distance), ``left, right`` (the item's words outward), ``need``.

    ``documents`` has ``content``; ``items`` has ``item_id, content``.  Items travel as rows of one word each, so what is sent grows with their words, however long one of them is.
    """
    tokens = items.where("item_id is not null").select("item_id", F.transform(words(F.col("content")), folded).alias("item")).where(F.size("item") > 0).distinct()
    numbered = tokens.select(F.monotonically_increasing_id().alias("row"), "item_id", "item")
    one = numbered.select("row", "item_id", F.size("item").alias("size"), F.posexplode("item").alias("place", "term"))
    placed = stored(one.withColumn("need", F.least(F.lit(window), F.col("size"))), "item-words")
    vocabulary = checkpointed(placed.select("term").distinct())
    seen = documents.select(F.explode(words(F.col("content"))).alias("word")).select(folded(F.col("word")).alias("term"))
    found = [seen.join(F.broadcast(block), "term", "left_semi").groupBy("term").count() for block in in_blocks(vocabulary)]
    counts = checkpointed(reduce(DataFrame.union, found))
    ranked = placed.join(counts, "term", "left").withColumn("t", F.struct(F.coalesce("count", F.lit(0)).alias("n"), "term", "place"))
    # Frames of one window's words from its start on, and of the words on either side of a place.
    order = Window.partitionBy("row").orderBy("place")
    framed = ranked.select(
        "row", "item_id", "need", "size", "place",
        F.sort_array(F.collect_list("t").over(order.rowsBetween(0, window - 1))).alias("all"),
        F.reverse(F.collect_list("term").over(order.rowsBetween(1 - window, -1))).alias("left"),
        F.collect_list("term").over(order.rowsBetween(1, window - 1)).alias("right"),
    )
    framed = stored(framed, "windows")
    rarest = framed.where("place <= size - need").select("row", F.get("all", F.lit(0)).alias("a"), F.get("all", F.lit(1)).alias("b")).where("a.n > 0")
    pairs = rarest.select("row", F.col("a.term").alias("term"), F.col("a.place").alias("place"), F.coalesce("b.term", "a.term").alias("other"), F.coalesce(F.col("b.place") - F.col("a.place"), F.lit(0)).alias("shift")).distinct()
    sided = pairs.join(framed.select("row", "place", "item_id", "need", "left", "right"), ["row", "place"])
    known = stored(sided.select("term", "item_id", "other", "shift", "left", "right", "need").distinct(), "anchors")
    discard(placed, framed)
    return known


def _equal_run(a: Column, b: Column) -> Column:
    """How many leading elements of two arrays are equal."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.array_position(F.concat(same, F.array(F.lit(False))), False) - 1


def postings(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """The index: ``term, doc_id, digest, at`` (from 0) of every occurrence of ``terms`` in ``documents`` (``doc_id, content``), as a stored table."""
    tokens = documents.select("doc_id", F.md5("content").alias("digest"), F.posexplode(words(F.col("content"))).alias("at", "word")).withColumn("term", folded(F.col("word")))
    found = [tokens.join(F.broadcast(block), "term").select("term", "doc_id", "digest", "at") for block in in_blocks(terms)]
    return stored(reduce(DataFrame.union, found), "postings")


def matches(documents: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """Phrase matches, and with ``slop`` proximity matches: ``doc_id, digest, item_id, kind, first, last`` (places of the document's words, from 1).

    ``exact``: a run of equal words at least as long as a window.  ``proximity``: the two rarest terms of a window, at most ``slop`` words from their distance in it.
    """
    docs = documents.select("doc_id", "content")
    known = anchors(docs, items, window)
    terms = checkpointed(known.select("term").union(known.select("other")).distinct())
    index = postings(docs, terms)

    # The list of the rarest term meets that of the second, moved by their offset; each offset once, whatever number of windows has it.
    offsets = known.select("term", "other", "shift").distinct()
    rarest = index.join(offsets, "term").select("term", "other", "shift", "doc_id", "digest", "at", (F.col("at") + F.col("shift")).alias("expected"))
    second = index.select(F.col("term").alias("t"), F.col("doc_id").alias("d"), F.col("digest").alias("g"), F.col("at").alias("a"))
    where = (F.col("other") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("g"))
    where = where & ((F.col("expected") == F.col("a")) if not slop else (F.abs(F.col("expected") - F.col("a")) <= slop))
    both = stored(rarest.join(second, where, "left_semi").select("term", "other", "shift", "doc_id", "digest", "at"), "candidates")
    discard(index)

    # The words around the places where they met; each text is split once however many candidates it holds.
    keys = checkpointed(both.select("doc_id", F.unhex("digest").alias("digest")).distinct())
    texts = by_keys(docs, keys, "left_semi", text_col="content").select(F.col("doc_id").alias("d"), F.md5("content").alias("g"), F.transform(words(F.col("content")), folded).alias("doc")).distinct()
    texts = stored(texts, "candidate-words")
    span = F.least(F.lit(window - 1), F.col("at"))
    before = F.when(span > 0, F.reverse(F.slice("doc", F.col("at") - span + 1, F.greatest(span, F.lit(1))))).otherwise(F.array().cast("array<string>"))
    after = F.slice("doc", F.col("at") + 2, window - 1)
    around = both.join(texts, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("g"))).select("term", "other", "shift", "doc_id", "digest", "at", before.alias("before"), after.alias("after"))
    met = around.join(known, ["term", "other", "shift"])
    run = met.select("doc_id", "digest", "item_id", "need", (F.col("at") + 1).alias("place"), _equal_run(F.col("before"), F.col("left")).alias("l"), _equal_run(F.col("after"), F.col("right")).alias("r"))
    exact = F.col("l") + F.col("r") + 1 >= F.col("need")
    shown = run.select("doc_id", "digest", "item_id", F.when(exact, "exact").otherwise("proximity").alias("kind"), F.when(exact, F.col("place") - F.col("l")).otherwise(F.col("place")).alias("first"), F.when(exact, F.col("place") + F.col("r")).otherwise(F.col("place")).alias("last"))
    return shown if slop else shown.where("kind = 'exact'")


def contamination(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, share: int = 20) -> DataFrame:
    """``doc_id, n_words, n_hit, items`` (ids as strings, sorted), ``contaminated`` (at least one word in ``share`` is hit) and ``digest`` (of the text) for each row."""
    docs = documents.select(F.col(quoted(id_col)).alias("doc_id"), text_or_empty(text_col).alias("content"))
    tests = items.select(F.col(quoted(item_col)).cast("string").alias("item_id"), text_or_empty(item_text_col).alias("content"))
    found = matches(docs, tests, window).select("doc_id", "digest", "item_id", "first", "last").distinct()
    # The union of a document's runs: each adds what lies beyond the furthest end before it.
    order = Window.partitionBy("doc_id", "digest").orderBy("first", "last", "item_id")
    reach = F.coalesce(F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    gains = found.withColumn("gain", F.greatest(F.lit(0), F.col("last") - F.greatest(reach, F.col("first") - 1)))
    hits = gains.groupBy("doc_id", "digest").agg(F.sum("gain").cast("long").alias("n_hit"), F.sort_array(F.collect_set("item_id")).alias("items"))
    hits = hits.select(F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest"), "n_hit", "items")
    sized = docs.select("doc_id", F.size(words(F.col("content"))).cast("long").alias("n_words"), F.md5("content").alias("digest"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    joined = sized.join(hits, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("digest") == F.col("_digest")), "left")
    return joined.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"), F.unhex("digest").alias("digest"))


def clean_documents(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``documents`` that are not contaminated, with all their columns."""
    keys = contamination(documents, items, id_col, text_col).where("contaminated").select("doc_id", "digest").distinct()
    return by_keys(documents, checkpointed(keys), "left_anti", id_col, text_col)

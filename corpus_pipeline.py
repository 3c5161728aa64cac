"""A pipeline from raw documents to token ids.

Each stage works on all that its predecessor kept; all but the last return the columns of documents.  Language ID drops documents in which it finds no language,
toxicity those it predicts toxic, the Jaccard join all but one document of each component, decontamination the contaminated ones.
The last stage encodes what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingweave.llm import decontaminate, jaccard_join, langid, toxicity
from lingweave.llm.bpe import encode
from lingweave.llm.common import discard, fresh, quoted, remainder, stored, table
from lingweave.llm.queries import BYTE_BPE, tokenizer_path


def _columns(docs: DataFrame) -> list:
    return [F.col(quoted(c)) for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is undetermined: null texts and texts without letters."""
    model = langid.fit(docs, remainder("doc_id", 5) != 0)
    if model is None:  # nothing to learn from: nothing can be rejected but texts without letters
        return docs.where(F.col("text").rlike(r"\p{L}"))
    lang, score = fresh("lang_pred", docs.columns), fresh("lang_score", docs.columns)
    judged = langid.predict(docs, model, keep=tuple(docs.columns), named=(lang, score))
    return judged.where(F.col(lang) != "und").select(*_columns(docs))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are predicted toxic."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 4) != 2)
    score = fresh("toxicity", docs.columns)
    return toxicity.score(docs, model, keep=tuple(docs.columns), named=score).where(F.col(score) < toxicity.THRESHOLD).select(*_columns(docs))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near copies."""
    return jaccard_join.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark passages."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` of each document."""
    return encode(docs, tokenizer_path(BYTE_BPE)).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", language_id),
    ("toxicity", not_toxic),
    ("jaccard_join", distinct_documents),
    ("decontamination", decontaminated),
    ("bpe", encoded),
]

#: Language ID and toxicity are learned models, which SQL cannot express; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet and read again by the next."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)

"""From raw documents to packed training sequences: toxicity, exact and near copies, contamination, packing.

Each stage reads what the one before kept, written as Parquet; all but the last return the columns of documents. Rows are
judged one by one, not by doc_id: rows without a doc_id, or that share one, go through every stage like all others. Empty
tables give empty ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from boutworks.llm._spark import materialize
from boutworks.llm.decontaminate import drop_contaminated
from boutworks.llm.exact_dedup import drop_copies
from boutworks.llm.ngram_jaccard import drop_near_copies
from boutworks.llm.packing import pack
from boutworks.llm.queries import table, word_tokenizer
from boutworks.llm.toxicity import drop_toxic


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs less the rows predicted toxic; null and empty texts have no toxic window and stay."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, null and empty ones being equal: the smallest doc_id, null last."""
    return drop_copies(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the smallest doc_id, null last; texts without words all stay."""
    return drop_near_copies(docs, shingle_words=5, threshold="0.8")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs less the contaminated rows; texts without words stay."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of each text with its end id; a null or empty text is one piece of that id."""
    return pack(docs, word_tokenizer(), end_id=1, size=2048)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_stage),
    ("exact dedup", exact_dedup_stage),
    ("n-gram jaccard join", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Compression distances, a tokenizer and exact components are not to be had in SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs

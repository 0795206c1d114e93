"""The corpus pipeline: stages that turn documents into packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the
columns of documents: toxic documents go, repeated lines are cut out of the texts, one document of each
near-duplicate group stays, documents with benchmark passages go, and the rest is packed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tamis.llm.common import read_table, staged
from tamis.llm.decontam import drop_contaminated
from tamis.llm.linededup import without_repeated_lines
from tamis.llm.minhash import one_per_group
from tamis.llm.packing import pack
from tamis.llm.queries import tokenizer_path
from tamis.llm.toxicity import CUT, drop_toxic

#: Near-duplicates are documents whose shingle sets have at least this similarity, in percent.
NEAR_PERCENT = 80


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier, fitted on labels, rejects go; null texts score the bias alone, and
    without labels to learn from nothing goes.

    Null and empty texts, ties, repeated rows, very long texts, extra columns and empty tables: see drop_toxic.
    """
    return drop_toxic(docs, read_table(spark, sf_dir, "labels"), cut=CUT)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in many documents stay in the last of these alone; no document goes, a null text stays null.

    Null and empty texts, ties, repeated rows, very long texts, extra columns and empty tables: see without_repeated_lines.
    """
    return without_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest doc_id; null and wordless texts stay.

    Null and empty texts, ties, repeated rows, very long texts, extra columns and empty tables: see one_per_group.
    """
    return one_per_group(docs, NEAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of benchmark go; null texts, and all documents where benchmark is empty, stay.

    Null and empty texts, ties, repeated rows, very long texts, extra columns and empty tables: see drop_contaminated.
    """
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of packed sequences; a null text is its end id alone.

    Null and empty texts, ties, repeated rows, very long texts, extra columns and empty tables: see pack.
    """
    return pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The first stage is a trained classifier, which SQL can't express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir, each stage's rows written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, name)
    return docs

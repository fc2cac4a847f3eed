"""The corpus pipeline: documents in, a clean weighted mix out.

Each stage is written as Parquet in shared storage and read again as the next one's
documents; a stage's table goes once the next one stands. All stages but the last return
the columns of documents, whatever they are; a row is judged by its own text, so rows that
share an id are judged apart, but for near duplicates, where an id is one node. Every
stage takes null and empty texts, null ids, texts of any length, repeated rows and empty
tables; clashing column names are the documents' own and stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomtext.llm import decontaminate, mixing, neardup, pii, toxicity
from loomtext.llm.common import materialise, remove, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below its threshold.

    Texts without words score the intercept; without labels nothing is dropped."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group of near copies.

    Rows with a null id and texts without words stay; of rows equal in every column one does."""
    return neardup.keep_first(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item.

    Texts without words have none; an empty benchmark drops nothing."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and n_chars to match.

    Null texts stay null."""
    return pii.mask_pii(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes of a document, with epoch and taken words.

    Texts without words take no part, since they fill no budget; the null source is a source."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("personal data", mask_personal_data),
    ("mix to target weights", mixed_sources),
]

#: Learned scores, signatures and checksums: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            remove(before)
        before = docs
    return docs

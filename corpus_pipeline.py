"""From raw documents to packed sequences: five stages over everything the stage before has kept.

Each stage takes any table with the columns doc_id and text; others are carried through to the last stage but one, whatever
their names. An empty table gives an empty one, texts are worked on whole, and repeated rows and rows without an id are rows
like any others until near_duplicates leaves one of each group. Results between stages are Parquet tables in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rillflow.llm import neardups, pack, pii, rules, substrings
from rillflow.llm.common import table, written

#: No SQL: trees, a neural tagger and a tokenizer decide.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the trees. Null texts have no words and go; without labels of both classes the
    base rule alone decides."""
    return rules.filter_documents(docs, rules.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group, repeated rows included: that of the smallest id, and one without an id only if no other has one."""
    return neardups.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of strings that occur twice; a document that loses all its bytes stays, empty."""
    return substrings.remove(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; null texts stay null."""
    return pii.redact(docs, pii.sampled_tagger(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their place in sequences of at most 2048; an empty text is its end token."""
    return pack.pack_documents(docs, with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

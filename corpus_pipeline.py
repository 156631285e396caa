"""The corpus pipeline: quality classifier, near-duplicate join, benchmark decontamination, pseudonyms, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run() writes every stage's rows to
the shared folder and reads them back as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontaminate as clean
from millrace.llm import ngram_join, packing, pii, quality_ordinal
from millrace.llm.common import discard, stored

#: Spark setting with the secret key of the pseudonyms.
KEY_SETTING = "spark.millrace.pii.key"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of being sound is one half at least. The model is fitted on rated rows of docs."""
    model = quality_ordinal.fit(docs, quality_ordinal.graded(_table(spark, sf_dir, "labels")), n_grades=3)
    return quality_ordinal.keep_good(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of documents that share 80 % of their 5-word shingles: the one of the smallest id."""
    return ngram_join.keep_one(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those in which benchmark windows make up a twentieth of the words or more."""
    return clean.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with keyed pseudonyms for personal data. The session's KEY_SETTING names the key."""
    return pii.pseudonymise(docs, spark.conf.get(KEY_SETTING, pii.DEMO_KEY))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pseudonyms", pseudonyms),
    ("packing", pack),
]

#: SQL has neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if k:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of
``documents``.  None of them samples, caps or shortens what it keeps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumflow.llm import decontam, lang_id, packing, pii, simhash
from vellumflow.llm.common import staged, table

#: A document whose main language holds less than this share of its letters is rejected.
MIN_LANGUAGE_SHARE = 0.5


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a main language; those without letters or without a main language go."""
    model = lang_id.fit(lang_id.learnable(docs.select("doc_id", "text", "lang"), F.lit(True)))
    return lang_id.keep_identified(docs, model, MIN_LANGUAGE_SHARE)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of every near-duplicate group."""
    return simhash.keep_first(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; lesser hits are cut out of their texts."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data masked in place."""
    return pii.mask(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in full sequences."""
    return packing.pack(docs)


STAGES = [
    ("language ID", keep_identified),
    ("SimHash near-dedup", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("PII", without_personal_data),
    ("packing", packed),
]

#: Fingerprints, Viterbi labels and token ids are beyond SQL; the tests use brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"stage-{k}", codec="snappy")
    return docs

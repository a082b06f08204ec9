"""The corpus pipeline: documents to packed training sequences, in stages that each call one operator.

Every stage reads what the one before it wrote, works on all of it, and (but for the last) returns the columns of
``documents``. Lineage ends at each stage's table, so a lost executor costs work of one stage only.

Defined cases are those of the operators: null and empty texts pass the classifier only if they score above the
threshold; equal texts are one near-duplicate class, whose smallest identifier stays; a null text is never a copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlsched.llm import byte_cnn, mixing, neardup, packing, pii
from crawlsched.llm.queries import tokenizer
from crawlsched.llm.shared import Scratch, read

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    scored = byte_cnn.classify(docs, read(spark, sf_dir, "labels"), keep=tuple(COLUMNS))
    return scored.filter("predicted = 1").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class: the one named by the class; of rows repeated under that identifier, the first by text."""
    return neardup.representatives(docs).select(*COLUMNS)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values replaced; the length follows the text."""
    return pii.pseudonymise(docs).select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in COLUMNS])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in the target shares; rows repeat as often as the mix takes them."""
    return mixing.materialise(mixing.mix(docs, keep=tuple(COLUMNS))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in the packed sequences."""
    return packing.pack_documents(docs, tokenizer())


STAGES = [("quality classifier", quality), ("near duplicates", near_duplicates), ("pseudonyms", pseudonyms), ("mixing", mixture), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last is written to the shared folder and read again."""
    keep, docs = Scratch(spark, "pipeline"), read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = keep.keep(docs, name.replace(" ", "-"))
    return docs

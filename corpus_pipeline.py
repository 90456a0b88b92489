"""A training corpus from raw documents: toxic ones go, then copies, then near copies; personal data is masked, and the rest is packed.

Each stage reads what the one before it wrote. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pricelens.llm import exact_dedup, order_minhash, packing, pii, toxicity
from pricelens.llm.common import Scratch, read


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, taught by ``labels``, finds toxic go."""
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays."""
    return exact_dedup.drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies one document stays."""
    return order_minhash.drop_near_copies(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked in the text; every document stays, with its length counted anew."""
    return pii.redact(docs, recount="n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as pieces of sequences."""
    return packing.pack(docs)


STAGES = [("toxicity", toxic), ("exact_dedup", exact), ("near_dedup", near), ("pii", private), ("packing", packed)]

#: The toxicity stage is a trained network and packing reads a tokenizer's ids; SQL has neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: each is written to the session's shared folder and read again, and goes once the next is written.

    An empty table gives an empty result; without labels no document is toxic. A null text counts as empty, so of those one stays.
    """
    scratch, docs, before = Scratch(spark), read(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        docs = scratch.put(stage(spark, docs, sf_dir))
        scratch.drop(*before)
        before = [docs]
    return docs

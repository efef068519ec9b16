"""A training corpus from raw documents: five stages, each written and read again before the next.

Toxic documents go; one document of each group of near copies stays; passages that repeat are cut; sources are mixed
to their target weights; what is left is encoded. Each stage works on all rows of the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpuskit.llm.bpe import encoded_digests
from corpuskit.llm.common import stage, table
from corpuskit.llm.mixing import mixed_documents
from corpuskit.llm.simhash import keep_one
from corpuskit.llm.suffix_dedup import without_repeats
from corpuskit.llm.toxicity import keep_clean


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not predicted to be toxic."""
    return keep_clean(docs, table(spark, sf_dir, "labels"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that near fingerprints link."""
    return keep_one(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of strings that start earlier too."""
    return without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, as often as it takes them."""
    return mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of the mix."""
    return encoded_digests(docs)


STAGES = [
    ("toxicity", toxicity),
    ("simhash near-dedup", simhash_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("source mix", mix),
    ("byte-level BPE", encode),
]

#: No SQL expresses the trained model, XXH64 or BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another on `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

"""A corpus pipeline: toxic documents go, near duplicates go, repeated passages and secrets are cut out, the rest is packed.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last return the
columns of documents, with n_chars as the text then has.  Rows without a doc_id pass through the stages that
need one.  The result is written as Parquet between stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callmark.llm.common import materialise, table
from callmark.llm.ngram_join import one_of_each
from callmark.llm.packing import pack_texts
from callmark.llm.secrets import samples, train, without_secrets
from callmark.llm.suffixes import repeats, without_repeats
from callmark.llm.toxicity import without_toxic


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.7 or more go."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of Jaccard similarity 0.8 on five-word shingles connect, the one with the least doc_id stays."""
    return one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay where they stand in the document with the least doc_id only."""
    return _measured(without_repeats(docs, materialise(repeats(docs), "repeats")))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return _measured(without_secrets(docs, train(samples(docs))))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 ids, digests of their ids, and where they lie in the packed sequences."""
    import public_tokenizers

    return pack_texts(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("repeated passages", cut_repeats),
    ("secrets", redact_secrets),
    ("packing", pack_tokens),
]

#: Models and tokenizers are beyond SQL; tests/llm/test_pipeline.py compares with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialise(docs, name.replace(" ", "-"))
    return docs

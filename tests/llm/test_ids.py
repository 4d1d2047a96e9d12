"""Ids above 2^53 beside a null id, and columns with names that operators use themselves."""

import pytest

from callmark.llm.queries import QUERIES
from callmark.llm.toxicity import without_toxic
from tests.llm.conftest import write

BIG = 2**60
IDS = [BIG + 1, None, BIG + 3, BIG + 5]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("ids"))
    texts = ["you idiot of a moron " * 30, "some words", "a password: hunter2hunter2", None]
    spark.createDataFrame(list(zip(IDS, texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{place}/documents.parquet")
    write(spark, place, "labels", [(BIG + 1, 1), (BIG + 3, 0)], "doc_id long, toxic int")
    return place


@pytest.mark.parametrize("name", ["op3_minimax_shards", "op4_deobfuscated_toxicity", "op5_markov_secrets", "op6_ngram_jaccard", "op7_order_minhash", "op8_nnls_packing", "op10_bpe"])
def test_ids_stay_exact(spark, folder, name):
    got = [r["doc_id"] for r in QUERIES[name](spark, folder).select("doc_id").collect()]
    assert sorted(got, key=str) == sorted(IDS, key=str)


def test_other_columns_stay_exact(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "doc_id + 1 AS other", "1 AS score", "'x' AS held_out")
    left = without_toxic(docs, spark.read.parquet(f"{folder}/labels.parquet"), 2.0)
    assert left.columns == docs.columns and sorted(map(str, left.collect())) == sorted(map(str, docs.collect()))

import hashlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from callmark.llm.bpe import Chunks, bpe_round_trip, op10_bpe
from tests.llm.conftest import SF, documents

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def checked(spark, folder):
    rows = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in op10_bpe(spark, folder).collect())
    want = []
    for i, t in documents(spark, folder):
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        want.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert rows == sorted(want)


def test_odd_rows(spark, odd):
    checked(spark, odd)


def test_prose(spark):
    checked(spark, SF)


def test_empty(spark, empty):
    assert op10_bpe(spark, empty).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60) | st.text("ab <|endoftext|>'sé\n", max_size=60))
def test_against_the_library(text):
    ids, decoded = Chunks.of(PATH)(text.encode())
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, "<u4").tolist() == want
    assert decoded.decode() == LIBRARY.decode(want, skip_special_tokens=False)


def test_ids_and_text_come_back(spark):
    docs = spark.createDataFrame([(1, "Hello, WORLD"), (2, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in bpe_round_trip(docs, PATH).collect()}
    assert rows[1]["decoded"] == "hello</w> ,</w> world</w>" and rows[2]["n_tokens"] == 0

from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from callmark.llm.separators import op9_separator_scan, token_counts
from tests.llm.conftest import SF, documents


@pytest.mark.parametrize("block", [2, 6, 64, 1 << 21])
def test_blocks_are_stitched(spark, tmp_path, block):
    files = {"part-0": [5, 9, 5, 5, 1, 2, 3, 4, 5, 7, 7], "part-1": [5], "part-2": [], "part-3": [1, 2, 3], "part-4": [8] * 50 + [5]}
    want = set()
    for name, ids in files.items():
        (tmp_path / name).write_bytes(np.array(ids, ">u2").tobytes() + b"x" * (name == "part-3"))
        start = n = 0
        for i, t in enumerate(ids):
            if t == 5:
                want.add((name, n, start, i - start, True))
                n, start = n + 1, i + 1
        if start < len(ids):
            want.add((name, n, start, len(ids) - start, False))
    assert {tuple(r) for r in token_counts(spark, str(tmp_path), eod=5, block=block).collect()} == want


@pytest.mark.parametrize("folder", ["odd", "sf"])
def test_documents(spark, odd, folder):
    folder = odd if folder == "odd" else SF
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter(len(library.encode(t or "", add_special_tokens=False).ids) for _, t in documents(spark, folder))
    rows = op9_separator_scan(spark, folder).collect()
    assert Counter(r["n_tokens"] for r in rows) == want and all(r["complete"] for r in rows)


def test_empty(spark, empty):
    assert op9_separator_scan(spark, empty).collect() == []


def test_files_are_rolled_and_large_ids_refused(spark, tmp_path, monkeypatch):
    from callmark.llm import separators

    docs = spark.createDataFrame([(" ".join(f"w{i}" for i in range(n)),) for n in (0, 5, 40, 300, 3, 0, 90)], "text string").coalesce(1)
    path = f"file://{tmp_path}/flat"
    monkeypatch.setattr(separators, "PER_FILE", 2)
    separators.write_flat(docs, public_tokenizers.path("word_bpe_49k.json"), path, block=100)
    rows = token_counts(spark, path, block=64).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter(len(library.encode(r["text"], add_special_tokens=False).ids) for r in docs.collect())
    assert Counter(r["n_tokens"] for r in rows) == want and len({r["file"] for r in rows}) > 1
    monkeypatch.setattr(separators, "EOD", 300)
    with pytest.raises(Exception, match="don't fit"):
        separators.write_flat(docs, public_tokenizers.path("word_bpe_49k.json"), f"file://{tmp_path}/refused")

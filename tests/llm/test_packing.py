import json
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from callmark.llm.packing import Ids, combinations, least_squares, op8_nnls_packing, plan
from tests.llm.conftest import SF, documents


def checked(spark, folder, most_padding):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = documents(spark, folder)
    rows = op8_nnls_packing(spark, folder).collect()
    pieces, sequences = defaultdict(set), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].add((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in docs:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        at = 0
        while at < len(ids):
            (start, length, crc, tokens) = next(p for p in pieces[i] if p[0] == at and p[3] == len(ids) and zlib.crc32(np.array(ids[at : at + p[1]], "<u4").tobytes()) == p[2])
            at += length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= 4096
    filled = [sum(n for _, n in own) for own in sequences.values()]
    padding = sum(0 if f & (f - 1) == 0 else 4096 - f for f in filled)
    assert padding <= most_padding * 4096 * len(filled), padding / (4096 * len(filled))


def test_odd_rows(spark, odd):
    checked(spark, odd, 0.2)


def test_prose(spark):
    checked(spark, SF, 0.02)


def test_empty(spark, empty):
    assert op8_nnls_packing(spark, empty).collect() == []


def test_plan_covers_every_piece():
    rng = np.random.default_rng(3)
    lengths, counts = np.unique(np.minimum(4096, rng.lognormal(6, 1.2, 20_000).astype(int) + 1), return_counts=True)
    histogram = dict(zip(lengths.tolist(), counts.tolist()))
    filled, ranks = defaultdict(int), defaultdict(list)
    for length, a, b, first, each in plan(histogram):
        for r in range(a, b):
            filled[first + (r - a) // each] += length
            ranks[length].append(r)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(v)) for k, v in histogram.items()}
    assert max(filled.values()) <= 4096
    assert sum(filled.values()) > 0.985 * 4096 * len(filled)


def test_least_squares_meets_a_histogram_it_can_meet():
    ways = combinations(64, 8)
    truth = np.zeros(len(ways))
    truth[[1, 5, 7]] = [10, 20, 30]
    counts = np.zeros(8)
    for t, way in zip(truth, ways):
        for part in way:
            counts[part - 1] += t
    x = least_squares(counts, ways)
    made = np.zeros(8)
    for t, way in zip(x, ways):
        for part in way:
            made[part - 1] += t
    assert x.min() >= 0 and np.abs(made - counts).max() < 0.05


def of_library(library, texts):
    return [np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_forms_of_a_word_are_encoded_once():
    path = public_tokenizers.path("word_bpe_49k.json")
    words = [f"{a}{b}{c}ungsé" for a in "bcdfgk" for b in "aeiouü" for c in "lmnrst"]
    texts = [" ".join(f for w in words for f in (w, w.title(), w.upper() + ",", w + '...)"')), None, ""]
    ids = Ids(path)
    assert [found for _, found in ids.of_column(pa.array(texts))] == of_library(Tokenizer.from_file(path), texts)
    assert len(ids.known.now) < len(words) + 10


def test_ids_of_any_text(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    library, rng = Tokenizer.from_file(path), random.Random(8)
    every = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x11000)]]
    latin = [*map(chr, range(0x250))]
    bits = ["'s", "'LL", "<|endoftext|>", "<|ENDOFTEXT|>", "H̱", "é", "≮", "İ", "Σ", "ς", "Ⱥ", "ǅ", "\xd7", "\xb2", " ", "\xa0", "\x1c", "\x85", "…", "a" * 70]
    texts = ["".join(every[k : k + 97]) for k in range(0, len(every), 97)] + [f"{c}a a{c} a{c}. {c} {c.upper()}{c}, x{c}'s {c}́" for c in latin]
    for _ in range(1500):
        texts.append("".join(rng.choice((rng.choice(latin), rng.choice("aeinrstAEN"), rng.choice("aeinrst .,'!  \n"), rng.choice(bits))) for _ in range(rng.randrange(60))))
    monkeypatch.setattr("callmark.llm.packing.STEP", 3000)
    monkeypatch.setattr("callmark.llm.packing.REMEMBERED", 500)
    ids = Ids(path)
    rows = [*ids.of_column(pa.array(texts))]
    assert [r for r, _ in rows] == [*range(len(texts))]
    assert [texts[r] for (r, found), right in zip(rows, of_library(library, texts)) if found != right] == []
    [*ids.of_column(pa.array(["a"]))]
    assert max(map(len, [*ids.known.now, *ids.known.older])) <= ids.known.LONG


def test_files_with_other_rules(tmp_path):
    """Without lower case, with another splitter or with a plain word as special token the library splits every chunk."""
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        whole = f.read()
    texts = ["The Tokens, don't; TOKENS the tokens! über Über."]
    for k in range(3):
        spec = json.loads(whole)
        if k == 0:
            spec["normalizer"]["normalizers"].pop()
        elif k == 1:
            spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"[\p{L}]|[^\s\p{L}]+"
        else:
            spec["added_tokens"].append(spec["added_tokens"][0] | {"id": spec["model"]["vocab"]["token</w>"], "content": "token"})
        path = tmp_path / f"{k}.json"
        path.write_text(json.dumps(spec), encoding="utf-8")
        ids = Ids(str(path))
        assert ids.words is None
        assert [found for _, found in ids.of_column(pa.array(texts))] == of_library(Tokenizer.from_file(str(path)), texts)

import hashlib
import random

import regex
import xxhash
from pyspark.sql import functions as F

from callmark.llm.fingerprints import HASHES_LOG2, PIECES, PLACE, TUPLE, K, likeness, op7_order_minhash, with_signature
from tests.llm.conftest import SF, documents


def checked(spark, folder):
    docs = sorted(documents(spark, folder), key=lambda d: (d[0] is None, -(d[0] or 0), d[1] or ""))
    rows = op7_order_minhash(spark, folder).collect()
    assert len(rows) == len(docs)
    want, prints = set(), {}
    for k, (i, t) in enumerate(docs):
        t, after = t or "", docs[(k + 1) % len(docs)][1] or ""
        q = len(t) // 3
        want.add((i, len(t), hashlib.sha256((t[: len(t) - q] + after[:q]).encode()).hexdigest()))
    assert {(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows} == want
    texts = {}
    for i, t in docs:
        texts.setdefault(i, t or "")
    for r in rows:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if r["doc_id"] is not None:
            assert prints.setdefault(texts[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
    return rows


def test_odd_rows(spark, odd):
    checked(spark, odd)


def test_prose(spark):
    rows = checked(spark, SF)
    long = [r for r in rows if r["n_chars"] > 300]
    assert sum(r["near_edited"] for r in long) / len(long) > 0.2
    assert sum(r["near_next"] for r in long) / len(long) < 0.1
    assert sum(r["near_edited"] > r["near_next"] for r in long) > 0.97 * len(long)


def test_empty(spark, empty):
    assert op7_order_minhash(spark, empty).collect() == []


def test_order_counts(spark):
    """The same words in another order share fewer values than with a Jaccard sketch; a small edit leaves most."""
    words = [f"w{i}" for i in range(400)]
    moved = words[200:] + words[:200]
    edited = words[:100] + ["new"] + words[101:]
    docs = spark.createDataFrame([(" ".join(words), " ".join(moved), " ".join(edited))], "a string, b string, c string")
    for c in "abc":
        docs = with_signature(docs, c, f"s{c}")
    near = docs.select(likeness(docs.sa, docs.sb).alias("moved"), likeness(docs.sa, docs.sc).alias("edited")).first()
    assert near["edited"] > 0.9 and near["moved"] < near["edited"] - 0.2


def brute_signature(text):
    """Every function over all numbered k-mers; hashes as Spark's xxhash64 chains them, truncated as the operator keeps them."""
    pieces = regex.findall(PIECES.replace("p{Is", "p{"), text, regex.ASCII)
    whole = lambda h: h - (1 << 64) if h >= 1 << 63 else h
    seen, kmers = {}, []
    for i in range(max(1, len(pieces) - K + 1) if pieces else 0):
        h = 42
        for piece in pieces[i : i + K]:
            h = xxhash.xxh64_intdigest(piece.encode(), seed=h)
        h = whole(h) >> PLACE
        n = seen[h] = seen.get(h, -1) + 1
        numbered = xxhash.xxh64_intdigest(n.to_bytes(4, "little"), seed=xxhash.xxh64_intdigest(h.to_bytes(8, "little", signed=True), seed=42))
        width = 63 - HASHES_LOG2 - PLACE
        kmers.append((numbered % (1 << HASHES_LOG2) << width | numbered >> (64 - width), i))
    out = []
    for j in range(1 << HASHES_LOG2) if kmers else []:
        least = sorted(kmers, key=lambda x: x[0] ^ j << (63 - HASHES_LOG2 - PLACE))[:TUPLE]
        h = 42
        for kmer, _ in sorted(least, key=lambda x: x[1]):
            h = xxhash.xxh64_intdigest(kmer.to_bytes(8, "little"), seed=h)
        out.append(j << 32 | h & 0xFFFFFFFF)
    return out


def test_signatures_and_likeness_against_brute_force(spark):
    rng = random.Random(6)
    prose = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(60)) for _ in range(n))
    texts = ["", " ", "one", "one two", "a b c a b c a b c", "x" * 100, "".join(rng.choice("abcdefghij") for _ in range(700))] + [prose(n) for n in (3, 4, 30, 120, 900)]
    docs = spark.createDataFrame([(i, t, texts[i - 1]) for i, t in enumerate(texts)], "i int, a string, b string")
    rows = with_signature(with_signature(docs, "a", "sa"), "b", "sb").select("a", "b", "sa", "sb", likeness(F.col("sa"), F.col("sb")).alias("near")).collect()
    for r in rows:
        x, y = brute_signature(r["a"]), brute_signature(r["b"])
        assert (r["sa"], r["sb"]) == (x, y)
        assert abs(r["near"] - (len(set(x) & set(y)) / max(len(x), len(y)) if x or y else 1.0)) < 1e-12


def test_an_insertion_changes_little_without_blanks(spark):
    rng = random.Random(2)
    for letters in ("abcdefghijklmnopqrstuvwxyz", "日本語文字列漢字仮名交書読見聞言話食飲行来帰", "бвгджзклмнпрстаеиоу"):
        text = "".join(rng.choice(letters) for _ in range(2000))
        docs = spark.createDataFrame([(text, text[:20] + letters[3] + text[20:])], "a string, b string")
        near = with_signature(with_signature(docs, "a", "sa"), "b", "sb").select(likeness(F.col("sa"), F.col("sb"))).first()[0]
        assert near > 0.9, letters

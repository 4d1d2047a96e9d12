import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from callmark.llm import ngram_join
from callmark.llm.common import shared_dir
from callmark.llm.ngram_join import Forest, SignatureTree, folded, may_be_near, narrow, narrow_width, ngram_components, one_of_each, op6_ngram_jaccard, signature
from callmark.llm.words import shingle_sets, word_hashes
from tests.llm.conftest import SF, documents


def brute_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))) if words else frozenset()


def brute(docs):
    sets = {i: brute_set(t) for i, t in docs if i is not None}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    have = {}
    for i in ids:
        for s in sets[i]:
            have.setdefault(s, []).append(i)
    shared = Counter()
    for own in have.values():
        for a in range(len(own)):
            for b in range(a):
                shared[own[b], own[a]] += 1
    for (a, b), both in shared.items():
        if 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def checked(spark, folder):
    docs = documents(spark, folder)
    want = brute(docs)
    rows = op6_ngram_jaccard(spark, folder).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] if r["doc_id"] is not None else r["component_id"] is None
    return want


def test_odd_rows(spark, odd):
    checked(spark, odd)


def test_prose(spark):
    assert len({c for _, c in checked(spark, SF).values()}) < 1000


def test_empty(spark, empty):
    assert op6_ngram_jaccard(spark, empty).collect() == []


@pytest.mark.parametrize("frequent,part", [(2, 400), (10**9, 3)])
def test_chains_and_frequent_lines(spark, monkeypatch, frequent, part):
    """Chains of edits near the threshold, a line that all share, many near copies; whichever shingles count as frequent."""
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_join, "PART", part)
    rng = random.Random(5)
    word = lambda: "w" + str(rng.randrange(10**6))
    line = [word() for _ in range(12)]
    rows, i = [], 0
    for _ in range(25):
        own = line + [word() for _ in range(rng.randint(5, 150))]
        for _ in range(rng.randint(1, 8)):
            rows.append((i, " ".join(own)))
            i += 1
            own = own[:]
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(len(own))] = word()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_components(docs, 90, 3).collect()} == want


def test_tree_rules_out_nothing_near():
    rng = np.random.default_rng(1)
    base = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (20, 60, 300, 900, 5000)]
    sets = []
    for b in base:
        for _ in range(40):
            keep = rng.random(len(b)) < rng.choice([0.9, 0.95, 0.97, 1.0])
            sets.append(np.unique(np.concatenate([b[keep], rng.integers(0, 2**63, rng.integers(0, 1 + len(b) // 20), dtype=np.uint64)])))
    sets.sort(key=len)
    sizes = np.array([len(s) for s in sets])
    near = {(i, j) for j in range(len(sets)) for i in range(j) if ngram_join.jaccard_at_least(sets[i], sets[j], 90)}
    for width in (512, 16384):
        tree = SignatureTree(sizes, np.array([signature(s, width) for s in sets]), 90, Forest(np.arange(len(sets))))
        kept = {(int(i), int(j)) for x, y in tree.pairs() for i, j in zip(x, y)}
        assert near and near <= kept and len(kept) < len(sets) ** 2 / 3
    # the bitmaps that travel, folded to the width of the smaller set
    for i, j in near:
        x, y = narrow(sets[i])[None], narrow(sets[j])[None]
        if narrow_width(len(sets[i])) < narrow_width(len(sets[j])):
            y = folded(y)
        assert may_be_near(sizes[[i, j]], np.concatenate([x, y]), np.array([0]), np.array([1]), 90).all()


def shingles(text, words):
    return next(shingle_sets(pa.array([text], pa.string()), words))[1]


def test_shingles_of_short_texts():
    assert len(shingles("A b", 3)) == 1 and (shingles("A b", 3) == shingles("a\x0bB", 3)).all() and len(shingles(" ", 3)) == len(shingles(None, 3)) == 0
    assert shingles("a b c", 3)[0] != shingles("a b", 3)[0] and len(shingles("a b c a b c a b c", 3)) == 3


def test_hashes_of_words_are_those_of_their_bytes():
    """Words across steps, longer than a step, next to other texts, in any alphabet: equal words and only they have equal hashes."""
    rng = random.Random(1)
    long = "x" * 300_000
    texts = [None, "", " ", "a b", f"{long} y {long}", long, "q" * 131_072, "q" * 131_073 + " z"]
    texts += [" ".join(rng.choice(["a", "B", "b", "cd", "dc", "\t", "é", "日本"]) for _ in range(rng.randint(0, 50))) for _ in range(300)]
    texts += [" ".join(str(rng.randrange(10**9)) for _ in range(40_000))]
    for lower in (False, True):
        of, back = {}, {}
        for row, h, at in word_hashes(pa.array(["skipped", *texts])[1:], lower):
            for i in range(len(at) - 1):
                t = texts[row + i] or ""
                words = (re.sub("[A-Z]", lambda m: m.group().lower(), t) if lower else t).encode().split()
                got = h[at[i] : at[i + 1]].tolist()
                assert len(words) == len(got)
                assert all(of.setdefault(w, g) == g and back.setdefault(g, w) == w for w, g in zip(words, got))


def test_large_ids_beside_nulls_and_an_id_with_two_texts(spark, monkeypatch):
    """Ids above 2^53 in the exact round (the first one is kept from linking anything), and rows of one id that link apart."""
    monkeypatch.setattr(ngram_join, "MASKS", np.zeros((0, 2), np.uint64))
    rng = random.Random(3)
    prose = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    big = 2**60
    a, b = prose(100), prose(100)
    changed = lambda w, at: " ".join(w[:at] + ["x"] + w[at + 1 :])
    rows = [(big + 1, " ".join(a)), (None, " ".join(a)), (big + 3, changed(a, 50)), (big + 5, changed(a, 1)), (big + 7, " ".join(b)), (big + 9, changed(b, 3)), (big + 9, changed(b, 70)), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in ngram_components(docs, 90, 3).collect())
    assert got == [(0, None), (0, None), (big + 1, big + 1), (big + 3, big + 1), (big + 5, big + 1), (big + 7, big + 7), (big + 9, big + 7), (big + 9, big + 7)]
    two = spark.createDataFrame([(5, " ".join(a)), (5, " ".join(b)), (3, changed(a, 50)), (9, changed(b, 50))], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in ngram_components(two, 90, 3).collect()} == {(3, 3), (5, 3), (9, 3)}
    named = docs.selectExpr("*", "'x' AS _turn", "doc_id AS other")
    kept = one_of_each(named, 90, 3)
    assert kept.columns == named.columns and sorted((r["doc_id"] or 0, r["other"] or 0) for r in kept.collect()) == [(0, 0), (0, 0), (big + 1, big + 1), (big + 7, big + 7)]


def test_long_words_that_meet_in_sums_stay_apart(spark):
    """A word of a and b by the parity of its places' bits, and its complement, have equal sums of powers of every odd base."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    for n in (16, 64, 1024, 2048):
        one, two = ("".join("ab"[b ^ f] for b in bits[:n]) for f in (0, 1))
        hashes = [h.tolist() for _, h, _ in word_hashes(pa.array([one, two, one.upper()]), lower=True)][0]
        assert hashes[0] == hashes[2] != hashes[1]
    long = "x" * 300_000
    values = [v for _, h, _ in word_hashes(pa.array([long + "y", long + "z", "p " + long + "y"])) for v in h.tolist()]
    assert values[0] == values[3] != values[1]


def test_what_no_later_step_reads_is_deleted(spark):
    folder = Path(shared_dir(spark).removeprefix("file:")) / f"callmark-{spark.sparkContext.applicationId}"
    there = lambda: {p.name for p in folder.glob("*")}
    before, text = there(), " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, text + " end"), (3, "other words here")], "doc_id long, text string")
    got = ngram_components(docs, 90, 3)
    kinds = {name.rsplit("-", 1)[0] for name in there() - before}
    assert {"keys", "classes"} <= kinds and kinds.isdisjoint({"sketches", "class-sketches", "postings"})
    assert sorted((r["doc_id"], r["component_id"]) for r in got.collect()) == [(1, 1), (2, 1), (3, 3)]


def test_texts_go_to_python_in_small_batches(spark, monkeypatch):
    """And what is remembered of a set for its frequent shingles is no view of the whole set."""
    from callmark.llm.common import AT_ONCE

    sizes, materialise = [], ngram_join.materialise
    monkeypatch.setattr(ngram_join, "materialise", lambda df, name: sizes.append(int(spark.conf.get(AT_ONCE))) or materialise(df, name))
    before = spark.conf.get(AT_ONCE)
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b c d")], "doc_id long, text string")
    assert {r["component_id"] for r in ngram_components(docs, 90, 3).collect()} == {1}
    assert sizes and max(sizes) <= 2000 and spark.conf.get(AT_ONCE) == before
    own = ngram_join.prefix(np.arange(100, dtype=np.uint64), 80)
    assert own.base is None and own.tolist() == list(range(21))


@pytest.mark.parametrize("others", [0, 40])
def test_each_pair_that_may_be_near_gets_into_one_family(others):
    """Two rows of one component that both may be near a third: either of them alone may be the one that is linked to it."""
    n = 3 + others
    ids, sizes = np.arange(1, n + 1), np.full(n, 100)
    component = np.array([1, 1, 3, *range(4, n + 1)])
    bits = narrow(np.arange(100, dtype=np.uint64) << np.uint64(41)).tobytes()
    far = narrow(np.arange(300, 400, dtype=np.uint64) << np.uint64(40)).tobytes()
    zero = np.zeros(n, np.int64)
    columns = {"token": zero + 7, "bi": zero, "bj": zero, "part": zero, "n": sizes, "place": zero, "component": component, "doc_id": ids}
    table = pa.table({**columns, "bits": pa.array([bits] * 3 + [far] * others, pa.binary())})
    found = [(a, b) for out in ngram_join.candidate_edges(iter(table.to_batches()), 90) for a, b in zip(out["a"].to_pylist(), out["b"].to_pylist())]
    assert {x for e in found if min(e) <= 3 for x in e} == {1, 2, 3}
    assert all((a <= 3) == (b <= 3) for a, b in found)

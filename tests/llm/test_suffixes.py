import random

import numpy as np
import pyarrow as pa

from callmark.llm.suffixes import K, op2_sparse_suffixes, repeats, selected, without_repeats
from callmark.llm.words import sequences, word_hashes
from tests.llm.conftest import SF, documents


def keys(words):
    """The hash of the K words from each place on."""
    return sequences(next(word_hashes(pa.array([" ".join(words)])))[1], K)


def brute(docs, least=50):
    """Words of each document that stand in a window of `least` words found in another document too."""
    have = {}
    for i, t in docs:
        w = (t or "").split()
        for k in range(len(w) - least + 1):
            have.setdefault(tuple(w[k : k + least]), set()).add((i, k))
    out = {}
    for places in have.values():
        if len({i for i, _ in places}) > 1:
            for i, k in places:
                out.setdefault(i, set()).update(range(k, k + least))
    return out


def covered(rows):
    out = {}
    for r in rows:
        out.setdefault(r["doc_id"], set()).update(range(r["start"], r["stop"]))
    return out


def planted():
    rng = random.Random(11)
    prose = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(5000)}" for _ in range(n)]
    shared = [prose(n) for n in (51, 60, 75, 120, 400)]
    docs = []
    for i in range(60):
        own = prose(rng.randint(0, 200))
        if i % 3 == 0:
            at = rng.randint(0, len(own))
            own = own[:at] + shared[i % 5] + own[at:]
        docs.append((i, " ".join(own)))
    docs += [(100, " ".join(prose(30) * 5)), (101, None), (102, ""), (103, docs[0][1]), (104, " ".join(shared[2][:40]))]
    return docs


def test_against_brute_force(spark):
    docs = planted()
    rows = repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    assert covered(rows) == brute(docs)


def test_later_occurrences_are_cut(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in planted()], "doc_id long, text string, lang string")
    left = without_repeats(docs, repeats(docs))
    texts = [(r["doc_id"], r["text"]) for r in left.collect()]
    assert left.columns == docs.columns and len(texts) == docs.count()
    assert brute(texts) == {}
    before = dict(planted())
    assert all(t == before[i] for i, t in texts if i not in brute(planted()))


def test_prose(spark):
    assert covered(op2_sparse_suffixes(spark, SF).collect()) == brute(documents(spark, SF))


def test_odd_and_empty(spark, odd, empty):
    want = brute([(i, t) for i, t in dict(documents(spark, odd)).items() if i is not None])
    assert set(covered(op2_sparse_suffixes(spark, odd).collect())) == set(want)
    assert op2_sparse_suffixes(spark, empty).collect() == []


def test_frequent_keys_lose_no_repeats(spark, monkeypatch):
    """Twelve documents share 24 words that are the one kept suffix; pairs of them share 50."""
    from callmark.llm import suffixes

    monkeypatch.setattr(suffixes, "BLOCK", 3, raising=False)
    rng = random.Random(3)
    prose = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    around = [prose(26) for _ in range(60)]
    while True:  # the key in the middle is the least of every passage
        hot = prose(24)
        if all(list(selected(keys(a[:13] + hot + a[13:]))) == [13] for a in around):
            break
    docs = [(i, " ".join(prose(3) + around[i // 2][:13] + hot + around[i // 2][13:] + prose(3))) for i in range(120)]
    rows = repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    assert sorted((r["doc_id"], r["first"], r["start"], r["stop"]) for r in rows) == [(i, i % 2 == 0, 3, 53) for i in range(120)]


def first_ones(docs, least=50):
    """(doc_id, first) and the words of passages that are in two documents."""
    least_of, out = {}, {}
    passages = [(tuple(w[k : k + least]), i, k) for i, t in docs for w in [t.split()] for k in range(len(w) - least + 1)]
    for p, i, _ in passages:
        least_of.setdefault(p, set()).add(i)
    for p, i, k in passages:
        if len(least_of[p]) > 1:
            out.setdefault((i, i == min(least_of[p])), set()).update(range(k, k + least))
    return out


def test_the_first_one_is_decided_by_passage(spark):
    rng = random.Random(5)
    prose = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    left, key, right, long = prose(27), prose(24), prose(27), prose(100)
    texts = [prose(9) + key + prose(9), left + key + right, prose(4) + left + key + right, long[20:80], long, prose(2) + long + prose(2)]
    # no 50 words with any one other document: a key with left words of one and right words of another
    texts += [left[10:] + key + prose(5) + right[:5], prose(5) + key + right[:20], long[:30] + long[:30] + long[60:]]
    docs = [(i, " ".join(w)) for i, w in enumerate(texts)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {}
    found = repeats(frame).collect()
    for r in found:
        got.setdefault((r["doc_id"], r["first"]), set()).update(range(r["start"], r["stop"]))
    assert got == first_ones(docs)
    kept = {r["doc_id"]: r["text"].split() for r in without_repeats(frame, repeats(frame)).collect()}
    assert kept[1] == texts[1] and kept[2] == texts[2][:4]
    assert kept[4] == long[:20] + long[80:] and {w for t in kept.values() for w in t} == {w for t in texts for w in t}


def test_selection_is_by_content():
    rng = np.random.default_rng(0)
    words = [str(x) for x in rng.integers(0, 10**6, 500)]
    a, b = keys(words[100:150]), keys(words)
    assert len(a) == 27 and (a == b[100:127]).all()
    assert set(selected(a) + 100) <= set(selected(b))


def test_left_words_of_one_and_right_words_of_another_are_no_repeat(spark):
    """41 words shared with one document and 41 with another, around the same 28."""
    rng = random.Random(9)
    prose = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    docs = []
    for i in range(12):
        left, middle, right = prose(13), prose(28), prose(13)
        for j, words in enumerate((left + middle + right, prose(20) + left + middle + prose(20), prose(20) + middle + right + prose(20))):
            docs.append((3 * i + j, " ".join(words)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert repeats(frame).collect() == [] and brute(docs) == {}
    assert {r["text"] for r in without_repeats(frame, repeats(frame)).collect()} == {t for _, t in docs}


def test_ids_stay_exact_and_names_may_clash(spark):
    rows = [(2**60 + 1, "a " * 60, 2**61 + 1, "x"), (None, "a " * 60, None, None), (2**60 + 3, "a " * 60, 2**61 + 3, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, other long, _cuts string").coalesce(1)
    left = without_repeats(docs, repeats(docs))
    assert left.columns == docs.columns
    assert sorted(((r["doc_id"] or 0, r["other"] or 0, r["_cuts"] or "") for r in left.collect())) == [(0, 0, ""), (2**60 + 1, 2**61 + 1, "x"), (2**60 + 3, 2**61 + 3, "y")]

import zlib

import numpy as np

from callmark.llm.toxicity import SIZE, Restorer, character_counts, character_model, op4_deobfuscated_toxicity, restored_words
from tests.llm.conftest import SF, documents


def test_held_out_accuracy(spark):
    rows = op4_deobfuscated_toxicity(spark, SF).collect()
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == 1000
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) > 0.93 * len(held)
    assert not any(r["predicted"] and not labels[r["doc_id"]] for r in held)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["score"] >= 0.7)


def test_odd_and_empty(spark, odd, empty):
    assert len(op4_deobfuscated_toxicity(spark, odd).collect()) == len(documents(spark, odd))
    assert op4_deobfuscated_toxicity(spark, empty).collect() == []


def test_disguises(spark):
    docs = spark.createDataFrame([("the idiot and the stupid moron, a loser with pathetic trash; worthless clown",)] * 20 + [("the ether and other things that are here to stay",)] * 30, "text string")
    restorer = Restorer(character_model(character_counts(docs)))
    for seen, want in [("1d10t", "idiot"), ("i.d.i.o.t", "idiot"), ("idiooooot", "idiot"), ("$tup1d", "stupid"), ("m0r0n", "moron"), ("w0rthl3ss", "worthless"), ("tr4sh!!", "trash"), ("the", "the"), ("2023", "2023")]:
        assert restorer.word(seen) == want
    assert {"idiot", "stupid"} <= restored_words("An i d i o t. $ t u p 1 d", restorer)
    assert restored_words(None, restorer) == set()


def test_long_and_broken_runs():
    text = "the idiot and the stupid moron is a loser with pathetic trash and a worthless clown "
    codes = {c: i + 1 for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")}
    c = np.array([0, *[codes.get(x, 0) for x in text * 50]])
    counts = np.bincount((c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:], minlength=SIZE**3).astype(float)
    restorer = Restorer(character_model(counts))
    letters = " ".join("theidiotandthestupidmoronisaloserwithpathetictrash")
    assert len(letters.replace(" ", "")) > 40
    assert {"idiot", "stupid", "moron", "loser", "pathetic", "trash"} <= restored_words(letters, restorer)
    assert "idiot" in restored_words("a i d i o t", restorer)
    assert "idiot" in restored_words("the id iot", restorer)
    assert "idiot" in restored_words("i\td\ti\to\tt", restorer)
    assert {"idiot", "stupid", "moron"} <= restored_words("1d10t-and-the-$tup1d-m0r0n-is-a-l0ser-with-trash", restorer)
    assert all(len(w) < 4 for w in restored_words("a " * 20_000, restorer))


def test_features_count_alike_at_every_size(spark, monkeypatch):
    """A word of three toxic rows has a weight among 900 of them, and however many ordinary words are more frequent."""
    from callmark.llm import toxicity

    monkeypatch.setattr(toxicity, "FEATURES", 50, raising=False)
    ordinary = " ".join(a + b + "zz" for a in "bcdfgh" for b in "aeiou")
    rows = [(i, ordinary + (" moron" if i < 3 else " idiot" if i < 900 else ""), int(i < 900)) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)
    model = character_model(character_counts(docs)).astype(np.float16).tobytes()
    weights, _ = toxicity.learn(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), model)
    odds = lambda n: np.log((n + 0.5) / 901) - np.log(0.5 / 1101)
    want = {**dict.fromkeys(toxicity.features("moron"), odds(3)), **dict.fromkeys(toxicity.features("idiot"), odds(897))}
    assert set(weights) == set(want) and all(abs(weights[f] - want[f]) < 1e-9 for f in want)


def test_viterbi_finds_the_cheapest_reading():
    """Against all readings of short lattices."""
    from itertools import product

    from callmark.llm import toxicity as T

    rng = np.random.default_rng(4)
    model = rng.random((SIZE, SIZE, SIZE)).astype(np.float32) * 3
    restorer = Restorer(model)
    for seen in ["a1b", "1!0", "aa|3", "c-@tt", "$$1e"]:
        runs = [len(max((r for r in [c * n for n in range(1, 5)] if any(seen[s : s + len(r)] == r and s <= k < s + len(r) for s in range(len(seen)))), key=len)) for k, c in enumerate(seen)]
        choices = []
        for k, c in enumerate(seen):
            own = [(c, 0.0)] if c in restorer.codes else [(x, T.SWAP) for x in T.SUBSTITUTES.get(c, "")]
            run = k > 0 and seen[k - 1] == c
            if c not in restorer.codes or run:
                own.append(("", (T.REPEAT if runs[k] > 2 else T.DOUBLE) if run else T.SKIP if c in T.SEPARATORS else T.FOREIGN))
            choices.append(own)

        def price(reading):
            text = "".join(x for x, _ in reading)
            code = [0, 0, *(restorer.codes[x] for x in text), 0]
            return sum(p for _, p in reading) + sum(model[a, b, c] for a, b, c in zip(code, code[1:], code[2:]))

        best = min(product(*choices), key=price)
        assert restorer.decode(seen) == "".join(x for x, _ in best)


def test_words_that_separators_letters_and_signs_hide():
    text = "the idiot and the stupid moron is a loser with pathetic trash and a worthless clown you l and you are an idiot "
    from callmark.llm.toxicity import LETTERS

    codes = {c: i + 1 for i, c in enumerate(LETTERS)}
    c = np.array([0, *[codes.get(x, 0) for x in text * 50]])
    restorer = Restorer(character_model(np.bincount((c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:], minlength=SIZE**3).astype(float)))
    for seen, want in [
        ("you-idiot", {"you", "idiot"}), ("you,idiot", {"you", "idiot"}), ("you/1d10t", {"you", "idiot"}), ("and...idiot", {"and", "idiot"}), ("l'idiot", {"l", "idiot"}), ("i.d.i.o.t", {"idiot"}),
        ("\u0438\u0434\u0438\u043e\u0442\u0442\u0442", {"\u0438\u0434\u0438\u043e\u0442"}), ("\u03b7\u03bb\u03af\u03b8\u03b9\u03bf\u03c2\u03c2\u03c2", {"\u03b7\u03bb\u03af\u03b8\u03b9\u03bf\u03c2"}), ("\u017e\u017e\u017eoptee", {"\u017eoptee"}),
        ("idi0t!!", {"idiot"}), ("1d10t!!!", {"idiot"}), ("(idi0t)", {"idiot"}), ("i\u200bd\u200biot", {"idiot"}), ("\uff49\uff44\uff49\uff4f\uff54", {"idiot"}), ("2023-10-11", {"2023-10-11"}),
    ]:
        assert restored_words(seen, restorer) == want, seen


def test_runs_find_the_cheapest_reading():
    """Against all readings of short runs: each sign stands for its letters or nothing, each gap is dropped or a border."""
    from itertools import product

    from callmark.llm import toxicity as T

    rng = np.random.default_rng(6)
    model = rng.random((SIZE, SIZE, SIZE)).astype(np.float32) * 3
    restorer = Restorer(model)
    for seen in ["a-1b", "ab -c", "a b!1", "x|y z", "a.a1", "b-0-a", "tt-t"]:
        signs, gaps, between = [], [], False
        for c, edge in zip(seen, restorer.edges(seen)):
            if c.isspace() or c in T.SEPARATORS:
                between = True
            else:
                signs.append((c, edge))
                gaps.append(between)
                between = False
        text = "".join(c for c, _ in signs)
        choices = []
        for k, (c, edge) in enumerate(signs):
            lo = next(i for i in range(k + 1) if set(text[i : k + 1]) == {c})
            length = len(text[lo:]) - len(text[lo:].lstrip(c))
            own = [(c, 0.0)] if c in restorer.codes else [(x, T.SWAP) for x in T.SUBSTITUTES.get(c, "")]
            run = k > 0 and text[k - 1] == c
            if c not in restorer.codes or run:
                own.append(("", T.SKIP if edge else (T.REPEAT if length > 2 else T.DOUBLE) if run else T.FOREIGN))
            choices.append([(g + x, p + q) for g, q in ([("", T.SKIP), (" ", 0.0)] if gaps[k] else [("", 0.0)]) for x, p in own])

        def price(reading):
            words = "".join(x for x, _ in reading).split(" ")
            total = sum(p for _, p in reading)
            if any(not w for w in words[1:-1]) or not words[0] and len(words) > 1 or not words[-1] and len(words) > 1:
                return float("inf")  # a border stands between letters; at the ends it is none
            code = [0, 0, *(restorer.codes.get(x, 0) for x in " ".join(words)), *([0] if words[-1] else [])]
            return total + sum(model[a, b, c] for a, b, c in zip(code, code[1:], code[2:]))

        best = min(product(*choices), key=price)
        assert restorer.decode_run(seen) == "".join(x for x, _ in best).split(), seen


def test_fast_ways_give_the_same():
    """Runs of plain letters as the whole lattice reads them, runs of pieces as a pattern finds them, features as plain counts have them."""
    import random
    import re
    from collections import Counter

    from callmark.llm import toxicity as T

    rng = random.Random(3)
    restorer = Restorer(np.random.default_rng(7).random((SIZE, SIZE, SIZE)).astype(np.float16).astype(np.float32) * 3)
    pattern = re.compile(r"(?<!\S)\S{1,3}(?:\s+\S{1,3})+(?=[\s.,;:!?]|$)")
    texts = ["".join(rng.choice("aab bc  de.,!-1o \t\u00df\u00e9\x1cxz") for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += [" ".join(rng.choice(["a", "de", "la", "of", "the", "to", "x"]) for _ in range(rng.randint(1, 9))) for _ in range(2000)]
    for t in texts:
        assert [" ".join(m.group().split()) for m in pattern.finditer(t)] == list(T.spaced(t.split()))
        assert restorer.decode_run(t) == restorer.decode_lattice(t)
        assert T.thrice(t) == any(a == b == c and a.isalpha() for a, b, c in zip(t, t[1:], t[2:]))
    counted, want = T.FeatureCounts(), (Counter(), Counter())
    for i in range(300):
        words = {"".join(rng.choice("ab\u00df") for _ in range(rng.randint(1, 14))) for _ in range(rng.randint(0, 60))}
        counted.add(words, i % 2)
        want[i % 2].update({f for w in words for f in T.features(w)})
        if i % 70 == 0:
            counted.merge()
    counted.merge()
    names = dict(counted.names)
    assert counted.rows == [150, 150]
    assert {names[h]: n for h, n in zip(counted.values[1].tolist(), counted.n[1].tolist())} == want[1]
    assert sorted(counted.n[0].tolist()) == sorted(want[0].values())
    assert {names[h]: n for h, n in zip(counted.values[0].tolist(), counted.n[0].tolist()) if h in names} == {f: n for f, n in want[0].items() if f in want[1]}
    told = list(counted.told())
    assert sum(int(x["n"].sum()) for x in told) == 300 + sum(x.total() for x in want) and not counted.names

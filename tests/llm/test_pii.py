import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest

from callmark.llm.pii import KINDS, added_spans, base_spans, candidates, decode, find_pii, fit, harmless, luhn, marginals, op13_semi_markov_pii, regions, respelled, tokens_of, train, training_regions
from tests.llm.conftest import SF, documents

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(re.sub("[^0-9]", "", m)) <= 19 and plain_luhn(re.sub("[^0-9]", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def plain_luhn(digits):
    doubled = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1])]
    return sum(doubled) % 10 == 0


def brute(text):
    return sorted((m.start(), k, m.end()) for k, (_, pattern, keep) in enumerate(PATTERNS) for m in re.finditer(pattern, text or "") if keep(m.group()))


def written(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def test_base_spans_of_random_texts():
    rng = random.Random(11)
    pieces = ["@", "a@b.c", ".", "-", "1", "255", "256", "0012", "+", "+1 (705) 555-1902", " ", "(", ")", "4387513035237269", "4387 5130 3523 7269", "1.2.3.4", "x_%", "é", "@@", "a.b", "\n", "٣", "00000000000000000000000"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        assert base_spans(text) == brute(text), text


def checked(spark, folder):
    rows = op13_semi_markov_pii(spark, folder).collect()
    docs = documents(spark, folder)
    assert len(rows) == len(docs)
    want = {}
    for i, t in docs:
        base = brute(t)
        want.setdefault(i, []).append((*(sum(k == x for _, x, _ in base) for k in range(4)), hashlib.sha256(written(base).encode()).hexdigest(), {x for x in written(base).split(",") if x}))
    for r in rows:
        own = [w for w in want[r["doc_id"]] if w[:5] == (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"])]
        assert own and own[0][5] <= set(r["spans"].split(",")), r
    return rows


def test_odd_rows(spark, odd):
    checked(spark, odd)


def test_empty(spark, empty):
    assert op13_semi_markov_pii(spark, empty).collect() == []


def test_prose_has_its_base_spans_and_what_their_neighbours_hid(spark):
    """Two numbers side by side are one match that fails; the method finds each of them, and nothing else in these texts."""
    rows, texts = checked(spark, SF), dict(documents(spark, SF))
    added = [(texts[r["doc_id"]][int(a) : int(b)], kind) for r in rows for kind, a, b in (x.split(":") for x in r["spans"].split(",") if x) if (int(a), KINDS.index(kind), int(b)) not in brute(texts[r["doc_id"]])]
    assert sum(r["n_email"] for r in rows) > 5 and len(added) == sum(r["n_added"] for r in rows) > 0
    assert all((0, KINDS.index(kind), len(t)) in brute(t) for t, kind in added), added


@pytest.fixture(scope="module")
def weights(spark):
    return train(spark.read.parquet(f"{SF}/documents.parquet").select("text"))


def test_sample_is_bounded(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text")
    assert 0 < len(training_regions(docs, sample_docs=50, most=5)) <= 10


def test_respelled_data_of_other_texts(spark, weights):
    """Held out: other documents than those that training may see, with every span respelled, or a harmless number in its place."""
    rng = random.Random(99)
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id > 5000 AND text RLIKE '[0-9@]'").select("text").limit(400).collect()]
    wanted = found = right = wrong = clean = 0
    for text in texts:
        base = [s for s in base_spans(text)[:3]]
        for a, kind, b in base:
            left, right_of = text[max(0, a - 40) : a], text[b : b + 40]
            if base_spans(left) or base_spans(right_of):
                continue
            word = respelled(kind, text[a:b], rng)
            new = left + word + right_of
            have = base_spans(new) + added_spans(new, base_spans(new), weights)
            wanted += 1
            hit = any(k == kind and abs(x - len(left)) <= 1 and y == len(left) + len(word) for x, k, y in have)
            found += hit
            number = left + harmless(rng) + right_of
            clean += 1
            wrong += bool(added_spans(number, base_spans(number), weights))
            right += hit
    assert wanted > 100 and found >= 0.9 * wanted, (found, wanted)
    assert wrong <= 0.03 * clean, (wrong, clean)


def test_examples(weights):
    for text, kinds in [
        ("write to jane.doe [at] mail3 [dot] example [dot] com today", ["email"]),
        ("ring (705) 555-1902 or 41[.]15[.]186[.]233 please", ["phone", "ip"]),
        ("the card 4387/5130/3523/7269 went", ["card"]),
        ("CC BY-NC 4.0. Version 2.0, January 2004, at page 12 at noon", []),
        ("on 2024-01-15 at 10:22:31 there were 1,234.50 of them", []),
        ("", []),
    ]:
        base = base_spans(text)
        got = sorted(base + added_spans(text, base, weights))
        assert [KINDS[k] for _, k, _ in got] == kinds, (text, [(KINDS[k], text[a:b]) for a, k, b in got])


def segmentations(segments, n, at=0):
    """Every sequence of segments and single tokens."""
    if at == n:
        yield []
        return
    yield from segmentations(segments, n, at + 1)
    for k, (i, j) in enumerate(segments):
        if i == at:
            for rest in segmentations(segments, n, j):
                yield [k, *rest]


def test_decoding_and_probabilities_against_all_segmentations():
    rng = np.random.default_rng(5)
    for text in ["555-19 02", "a@b.c 1", "(1) 2.3", "x at 7 dot 1", "+1"]:
        toks = tokens_of(text, 0, len(text))
        segments, f = candidates(text, toks, [])
        score = rng.normal(size=(len(segments), 4))
        weigh, share = [], np.zeros_like(score)
        for ks in segmentations(segments, len(toks)):
            for types in itertools.product(range(4), repeat=len(ks)):
                weigh.append((sum(score[k, t] for k, t in zip(ks, types)), list(zip(ks, types))))
        log_z = math.log(sum(math.exp(w) for w, _ in weigh))
        for w, chosen in weigh:
            for k, t in chosen:
                share[k, t] += math.exp(w - log_z)
        got_z, got_share = marginals(segments, score, len(toks))
        assert abs(got_z - log_z) < 1e-9 and np.allclose(got_share, share)
        assert decode(segments, score, len(toks)) == max(weigh, key=lambda x: x[0])[1]


def test_regions_hold_all_that_can_be_an_entity():
    text = "so write  bob at mail dot example dot com or call 555 - 19 . 02 now\nat home, dot by 7"
    assert [text[a:b] for a, b in regions(text)] == ["bob at mail dot example dot com", "555 - 19 . 02", "7"]
    long = "x1" * 200_000 + " " + "a@" * 50_000 + " " + "1 " * 100_000
    assert len(list(regions(long))) == 1 and base_spans(long) is not None


def test_nothing_is_learnt_without_labels(spark):
    assert fit([])[0].max() < -1e6
    docs = spark.createDataFrame([(1, "no. 555-1902", 1, 2), (2, None, 1, 2)], "doc_id long, text string, base_spans int, _found int")
    out = find_pii(docs, train(docs), names=("b", "a"))
    assert out.columns == ["doc_id", "text", "base_spans", "_found", "b", "a"] and [r["a"] for r in out.collect()] == [[], []]
    assert luhn("4387513035237269") == plain_luhn("4387513035237269")

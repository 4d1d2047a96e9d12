import random

from callmark.llm import hamming
from callmark.llm.hamming import op1_multi_index_hashing, segments_of, top_k
from tests.llm.conftest import SF


def brute(rows, queries, k, bits=64):
    code = lambda v: tuple(bool(x is not None and x > 0) for x in [*v, *[0.0] * (bits - len(v))])
    known = [(i, code(v)) for i, v in rows if i is not None and v is not None]
    out = set()
    for q, v in queries:
        if q is None or v is None:
            continue
        near = sorted((sum(a != b for a, b in zip(code(v), c)), i) for i, c in known)[:k]
        out |= {(q, r + 1, i, d) for r, (d, i) in enumerate(near)}
    return out


def test_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(64)]) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(40)] + [(400, None), (None, rows[1][1]), (401, []), (402, [None, float("nan"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int".replace(", label int", ""))
    queries = df.where("vec_id % 50 = 0")
    got = {tuple(r) for r in top_k(df, queries, 7).collect()}
    assert got == brute(rows, [r for r in rows if r[0] is not None and r[0] % 50 == 0], 7)


def test_fewer_rows_than_k_and_empty(spark, empty):
    df = spark.createDataFrame([(0, [1.0]), (1, [-1.0])], "vec_id long, embedding array<float>")
    assert {tuple(r) for r in top_k(df, df, 5).collect()} == {(0, 1, 0, 0), (0, 2, 1, 1), (1, 1, 1, 0), (1, 2, 0, 1)}
    assert op1_multi_index_hashing(spark, empty).collect() == []


def test_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert {tuple(r) for r in op1_multi_index_hashing(spark, SF).collect()} == brute(rows, [r for r in rows if r[0] % 100 == 0], 10)


def test_wide_codes(spark):
    rng = random.Random(4)
    centres = [[rng.gauss(0, 1) for _ in range(150)] for _ in range(6)]
    rows = [(i, [x if rng.random() > 0.05 else -x for x in centres[i % 6]]) for i in range(120)] + [(200, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {tuple(r) for r in top_k(df, df.where("vec_id % 40 = 0"), 5).collect()}
    assert got == brute(rows, [r for r in rows if r[0] % 40 == 0 and r[0] != 200], 5, 150) | {x for x in got if x[0] == 200}


def test_segments():
    assert [s[2] for s in segments_of(1, 50_000)] == [16] * 4 and [s[2] for s in segments_of(1, 2**40)] == [21, 21, 22]
    assert sum(s[2] for s in segments_of(3, 5)) == 192


def test_a_value_of_a_segment_has_several_codes(spark, monkeypatch):
    rng, seen, whole = random.Random(6), [], hamming.segments_of
    monkeypatch.setattr(hamming, "segments_of", lambda *given: seen.append(whole(*given)) or seen[-1])
    rows = [(i, [rng.gauss(0, 1) for _ in range(64)]) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in top_k(df, df.where("vec_id % 1500 = 0"), 3).collect()} == brute(rows, [rows[0], rows[1500]], 3)
    assert all(2 * 2 ** bits <= 3000 for _, _, bits in seen[-1])

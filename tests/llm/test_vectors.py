"""Operators 11 and 12 against plain versions in Python's integers and fractions."""

import random
from fractions import Fraction

import duckdb
import numpy as np

from callmark.llm.negatives import OP12_SQL, limits, op12_hard_negatives
from callmark.llm.whitening import op11_exact_whitening, sums
from tests.llm.conftest import SF

SCHEMA = "vec_id long, embedding array<double>, label int, block int, anchor string, v string, n int"


def odd_vectors():
    """Repeated rows and vectors, nulls everywhere, entries that are null or not finite, another length, large entries."""
    rng = random.Random(3)
    vec = lambda: [rng.uniform(-1, 1) for _ in range(6)]
    same = vec()
    rows = [(i, vec() if i % 3 else same, rng.randrange(4)) for i in range(160)]
    rows += [(50, same, 1), (50, same, 1), (50, vec(), 2), (None, vec(), 1), (200, None, 1), (201, vec(), None), (202, [0.0] * 5 + [None], 1)]
    rows += [(203, [float("nan")] + [0.0] * 5, 1), (204, [float("-inf")] + [0.0] * 5, 1), (205, vec()[:4], 1), (206, [], 1), (250, [0.0] * 6, 3), (251, [4096.0, -9999.5] + [0.0] * 4, 0)]
    return rows


def write(spark, folder, rows):
    spark.createDataFrame([(*r, 1, "a", "b", 2) for r in rows], SCHEMA).repartition(3).write.mode("overwrite").parquet(f"{folder}/embeddings.parquet")


def usable(rows, d=6):
    return [(i, v, label) for i, v, label in rows if v is not None and len(v) == d and all(c is not None and np.isfinite(c) for c in v)]


def test_whitening_of_odd_rows(spark, tmp_path):
    rows = odd_vectors()
    write(spark, tmp_path, rows)
    check_whitening(op11_exact_whitening(spark, str(tmp_path)), usable(rows))


def test_whitening(spark):
    rows = [(r["vec_id"], list(r["embedding"]), 0) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitening(op11_exact_whitening(spark, SF), rows)


def check_whitening(found, rows):
    got = found.collect()
    x = [[int(np.floor(1024 * c)) + 100_000 for c in v] for _, v, _ in rows]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    cov = np.array([[float(Fraction(sum((r[i] * n - s[i]) * (r[j] * n - s[j]) for r in x), n**3)) for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(8, d)
    assert len(got) == n * k and {r["n"] for r in got} == {n}
    want = {}
    for (i, _, _), r in zip(rows, x):
        z = [n * c - m for c, m in zip(r, s)]
        want.setdefault(i, []).append((sum(c * c for c in z), np.array([c / n for c in z]) @ vectors[:, :k] / np.sqrt(values[:k])))
    for i, own in want.items():
        mine = [r for r in got if r["vec_id"] == i]
        assert sorted(r["deviation"] for r in mine) == sorted(dev for dev, _ in own for _ in range(k))
    signs = np.zeros(k)
    for r in got:
        if len(want[r["vec_id"]]) == 1:
            c = r["component"] - 1
            w = want[r["vec_id"]][0][1][c]
            if abs(w) > 1e-3:
                signs[c] = signs[c] or np.sign(w) * np.sign(r["whitened"])
            assert abs(r["whitened"] - (signs[c] or 1) * w) < 1e-7
            assert abs(r["explained"] / (values[c] / values.sum()) - 1) < 1e-9
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def test_sums_of_any_size():
    y = np.array([[2**61, -(2**61), 3], [2**61 - 1, 5, -7], [-1, 0, 2**40]] * 3000, dtype=np.int64)
    total, cross = sums(y)
    big = y.astype(object)
    assert total == list(big.sum(axis=0))
    assert cross == [sum(big[:, i] * big[:, j]) for i in range(3) for j in range(i, 3)]


def test_whitening_without_variance(spark, tmp_path):
    write(spark, tmp_path, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)])
    assert op11_exact_whitening(spark, str(tmp_path)).collect() == []
    write(spark, tmp_path, [(1, [1.0, 2.0], 0), (2, [1.0, 3.0], 0)])
    assert [r["component"] for r in op11_exact_whitening(spark, str(tmp_path)).collect()] == [1, 1]
    write(spark, tmp_path, [(None, [1.0], 0), (2, [3.0], 0), (3, [1e300], 0)])
    assert {r["vec_id"] for r in op11_exact_whitening(spark, str(tmp_path)).collect()} == {None, 2, 3}


def test_empty(spark, empty):
    assert op11_exact_whitening(spark, empty).collect() == [] and op12_hard_negatives(spark, empty).collect() == []


def brute_negatives(rows):
    kept = [(i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * c)) for c in v]) for i, v, label in usable(rows) if i is not None and label is not None]
    out = []
    for at, (i, label, x) in enumerate(kept):
        if i % 50:
            continue
        others = sorted((-sum(a * b for a, b in zip(x, y)), j, other) for b, (j, other, y) in enumerate(kept) if b != at)
        for ps, pid in [(-s, j) for s, j, other in others if other == label][:5]:
            hard = [(-s, j) for s, j, other in others if other != label and 50 * ps <= -100 * s <= 95 * ps][:3]
            out += [(i, pid, rank, j, ps, s) for rank, (s, j) in enumerate(hard, 1)]
    return sorted(out)


def test_negatives_of_odd_rows(spark, tmp_path, monkeypatch):
    import callmark.llm.negatives as operator

    rows = odd_vectors()
    write(spark, tmp_path, rows)
    want = brute_negatives(rows)
    assert len(want) > 30 and any(r[4] != r[5] for r in want)
    for size in (2048, 7):  # one block, and many, over which copies of an anchor are spread
        monkeypatch.setattr(operator, "ROWS", size)
        assert sorted(map(tuple, op12_hard_negatives(spark, str(tmp_path)).collect())) == want


def test_negatives_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = sorted(con.execute(OP12_SQL).fetchall())
    got = op12_hard_negatives(spark, SF)
    assert got.columns == [c[0] for c in con.execute(OP12_SQL).description]
    assert want and sorted(map(tuple, got.collect())) == want


def test_limits():
    for p in range(-400, 400):
        least, most = limits(p)
        assert [s for s in range(-500, 500) if 50 * p <= 100 * s <= 95 * p] == list(range(least, most + 1))

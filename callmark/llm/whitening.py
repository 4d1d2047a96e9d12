"""Operator 11: embedding whitening from an exact integer scatter.

Each entry c becomes the integer x = floor(1024 c) + SHIFT.  Tasks subtract the shift again and add up y = x - SHIFT
and the products y y' as integers of any size: y is cut into limbs of 20 bits, so that the matrix products of limbs
over a slab of rows are whole numbers below 2^53, which floating point adds exactly; what a task has summed leaves it
as digits of 40 bits, which Spark adds as longs.  n X'X - S S' is formed from these sums in exact integers (a shift
drops out of it), and only then becomes a covariance in floating point, which eigh decomposes.  What reaches the
driver has d (d + 1) / 2 sums, whatever the number of rows.

Rows with a null vector, or with a null or non-finite entry, take no part, nor do those whose length is not the
table's (the most frequent one); an empty table gives no rows.  A null id stays, a repeated row counts each time.
Entries beyond +-2^61 / 1024 count as that bound.  Components without variance (rank below 8, a single row, equal
rows) cannot be scaled to 1 and are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callmark.llm.common import materialise, table
from callmark.llm.vectors import dimension, finite, matrix

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Bits of a limb, rows of a slab: a sum of 2^12 products of 2 x 20 bits stays below 2^53.
LIMB, SLAB = 20, 4096
#: Bits of the digits in which sums travel: Spark may add 2^23 of them in a long.
DIGIT = 40


def integers(v: np.ndarray) -> np.ndarray:
    """floor(1024 c), which is x - SHIFT."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(v * SCALE), -(2.0**61), 2.0**61).astype(np.int64)


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """y as a sum of limbs[k] << (LIMB k), each a matrix of whole doubles below 2^LIMB in size."""
    sign, rest, out = np.sign(y), np.abs(y), []
    while True:
        out.append((sign * (rest & ((1 << LIMB) - 1))).astype(np.float64))
        rest = rest >> LIMB
        if not rest.any():
            return out


def sums(y: np.ndarray) -> tuple[list[int], list[int]]:
    """Exact column sums and exact upper triangle of y'y, as Python integers."""
    d = y.shape[1]
    upper = np.triu_indices(d)
    total, cross = np.zeros(d, dtype=object), np.zeros(len(upper[0]), dtype=object)
    for at in range(0, len(y), SLAB):
        parts = limbs(y[at : at + SLAB])
        for a, p in enumerate(parts):
            total += p.sum(axis=0).astype(np.int64).astype(object) << (LIMB * a)
            for b, q in enumerate(parts):
                cross += (p.T @ q)[upper].astype(np.int64).astype(object) << (LIMB * (a + b))
    return list(total), list(cross)


def digits(values: list[int]) -> Iterator[tuple[int, int, int]]:
    """(place in the list, digit's number, digit with the sign of the value) of all digits that are not 0."""
    for place, v in enumerate(values):
        sign, v, k = (-1 if v < 0 else 1), abs(v), 0
        while v:
            if v & ((1 << DIGIT) - 1):
                yield place, k, sign * (v & ((1 << DIGIT) - 1))
            v >>= DIGIT
            k += 1


def scatter(rows: DataFrame, d: int, vector_col: str = "embedding") -> tuple[int, list[int], np.ndarray]:
    """n, the sums S of y, and n Y'Y - S S' as exact Python integers (an array of objects), of rows that finite() has kept."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, cross = 0, [0] * d, [0] * (d * (d + 1) // 2)
        for batch in batches:
            y = integers(matrix(batch.column(0), d))
            s, c = sums(y)
            n, total, cross = n + len(y), [a + b for a, b in zip(total, s)], [a + b for a, b in zip(cross, c)]
        if n:
            found = [*digits([n, *total, *cross])]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(3)], ["place", "digit", "part"])

    parts = rows.select(vector_col).mapInArrow(partial, "place long, digit long, part long")
    whole = [0] * (1 + d + d * (d + 1) // 2)
    for r in parts.groupBy("place", "digit").agg(F.sum("part").alias("part")).collect():  # a few per pair of components
        whole[r["place"]] += r["part"] << (DIGIT * r["digit"])
    n, s = whole[0], whole[1 : d + 1]
    m = np.zeros((d, d), dtype=object)
    for v, i, j in zip(whole[d + 1 :], *np.triu_indices(d)):
        m[i, j] = m[j, i] = n * v - s[i] * s[j]
    return n, s, m


def components(n: int, m: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, float]:
    """Unit eigenvectors (columns) and eigenvalues of the covariance m / n^2 by falling eigenvalue, and its trace."""
    v = np.array([[x / (n * n) for x in row] for row in m], dtype=np.float64)  # each quotient of integers is rounded once
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = values[:most] > max(values[0], 0.0) * len(v) * np.finfo(np.float64).eps
    return vectors[:, :most][:, kept], values[:most][kept], float(sum(m[i, i] for i in range(len(v))) / (n * n))


def deviations(z: np.ndarray) -> list[int]:
    """Exact sums of the squares of each row's whole numbers."""
    if z.dtype != object:
        parts = limbs(z)
        return list(sum((p * q).sum(axis=1).astype(np.int64).astype(object) << (LIMB * (a + b)) for a, p in enumerate(parts) for b, q in enumerate(parts)))
    return [sum(x * x for x in row) for row in z]


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS) -> tuple[DataFrame, dict]:
    """vec_id, deviation (decimal(38,0), null beyond it), whitened (array<double>, an entry per component) for each row
    that takes part, written to the shared folder; and the model: n, sums (of x), vectors (a list per component),
    values, trace."""
    d = dimension(rows, vector_col)
    fit = finite(rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")), d, "v")
    n, s, m = scatter(fit, d, "v") if d else (0, [], None)
    vectors, values, trace = components(n, m, most) if n else (np.zeros((0, 0)), np.zeros(0), 0.0)
    scaled = vectors / np.sqrt(values) if n else vectors
    small = n * 2**61 < 2**62 or max([abs(x) for x in s], default=0) < 2**61

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums_of = np.array(s, dtype=np.int64 if small else object)
        for batch in batches:
            y = integers(matrix(batch.column(1), d))
            for at in range(0, len(y), SLAB):
                slab = y[at : at + SLAB]
                if small and len(slab) and int(np.abs(slab).max()) * n < 2**61:
                    z = slab * n - sums_of
                else:
                    z = slab.astype(object) * n - sums_of.astype(object)
                deviation = [x if x < 10**38 else None for x in map(int, deviations(z))]
                w = (z / n).astype(np.float64) @ scaled
                lists = pa.ListArray.from_arrays(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32) if w.shape[1] else np.zeros(len(w) + 1, np.int32), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(slab)), pa.array(deviation, pa.decimal128(38, 0)), lists], ["vec_id", "deviation", "whitened"])

    out = materialise(fit.mapInArrow(project, "vec_id long, deviation decimal(38,0), whitened array<double>"), "whitened")
    return out, {"n": n, "sums": [x + n * SHIFT for x in s], "vectors": vectors.T.tolist(), "values": values.tolist(), "trace": trace}


def identity_error(whitened: DataFrame, k: int) -> float:
    """Largest absolute entry of the covariance of the whitened values, centred before multiplying, minus the identity."""
    w = lambda i: F.get("whitened", F.lit(i))
    means = whitened.agg(*[F.avg(w(i)).alias(f"m{i}") for i in range(k)]).first()
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = whitened.agg(*[F.avg((w(i) - means[i]) * (w(j) - means[j])).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(found, pairs))


def op11_exact_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model = whiten(table(spark, sf_dir, "embeddings"))
    k = len(model["values"])
    error = identity_error(rows, k) if k else 0.0
    explained = F.array(*[F.lit(e / model["trace"]) for e in model["values"]]).cast("array<double>")
    each = rows.select("vec_id", F.col("deviation").try_cast("long").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model["n"]).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(float(error)).alias("identity_error"),
    )

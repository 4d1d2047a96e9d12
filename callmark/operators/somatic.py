"""Somatic comparison: classes of query-only calls, allele-frequency bins, rates and intervals of confidence."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callmark.operators.intervals import overlapping


def classified(calls: DataFrame, regions: DataFrame, id_cols: list[str], count_unknown: bool = False) -> DataFrame:
    """calls with tag: FP if an overlapping region is labelled FP, AMBI if any other is, else FP or UNK."""
    extent = calls.withColumn("start", F.col("pos")).withColumn("stop", F.col("pos") + F.length("ref") - 1)
    hits = overlapping(extent, regions).groupBy(*id_cols).agg(F.max((F.col("b_label") == "FP").cast("int")).alias("_fp"))
    outside = F.lit("UNK" if count_unknown else "FP")
    return calls.join(hits, id_cols, "left").withColumn("tag", F.when(F.col("_fp") == 1, "FP").when(F.col("_fp") == 0, "AMBI").otherwise(outside)).drop("_fp")


def af_bins(sizes: list[float]) -> list[tuple[float, float]]:
    """Bins from a list of widths that is used again from its start; the last one closes just above 1."""
    out, at, k = [], 0.0, 0
    while at < 1:
        stop = at + sizes[k % len(sizes)]
        out.append((at, 1.00000001 if stop >= 1 else stop))
        at, k = stop, k + 1
    return out


def af_bin_counts(rows: DataFrame, af: Column, tag: Column, sizes: list[float]) -> DataFrame:
    """Per bin: lo, hi and the numbers of TP, FN and FP.  Bins are few constants, so that a row finds its own by an expression."""
    bins = af_bins(sizes)
    which = F.when(af < 0, None)
    for k, (_, hi) in enumerate(bins):
        which = which.when(af < hi, k)
    n = lambda t: F.count(F.when(F.col("_tag") == t, 1))
    counted = rows.select(which.alias("bin"), tag.alias("_tag")).where("bin is not null").groupBy("bin").agg(n("TP").alias("tp"), n("FN").alias("fn"), n("FP").alias("fp"))
    edge = lambda i: F.element_at(F.array(*[F.lit(float(b[i])) for b in bins]), F.col("bin") + 1)
    return counted.select("bin", edge(0).alias("lo"), edge(1).alias("hi"), "tp", "fn", "fp")


def fp_rate(fp: Column, size: Column) -> Column:
    """False positives per million bases."""
    return F.when(size > 0, 1e6 * fp / size)


def _log_beta(a: float, b: float) -> float:
    return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)


def _beta_share(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(1 - x, b, a)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - _log_beta(a, b)) / a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    f = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d if abs(1 + top * d) > 1e-300 else 1e-300)
            c = 1 + top / c if abs(1 + top / c) > 1e-300 else 1e-300
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f


def beta_quantile(p: float, a: float, b: float) -> float:
    low, high = 0.0, 1.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _beta_share(mid, a, b) < p else (low, mid)
        if high - low < 1e-15:
            break
    return (low + high) / 2


def jeffreys(x: float, n: float, alpha: float = 0.05) -> tuple[float, float, float]:
    """Share, lower and upper end of the modified Jeffreys interval; (0, 0, 1) for n = 0."""
    if n == 0:
        return 0.0, 0.0, 1.0
    q = lambda p: beta_quantile(p, x + 0.5, n - x + 0.5)
    low = (alpha / 2) ** (1 / n) if x == n else 0.0 if x <= 1 else q(alpha / 2)
    high = 1 - (alpha / 2) ** (1 / n) if x == 0 else 1.0 if x >= n - 1 else q(1 - alpha / 2)
    return x / n, min(max(low, 0.0), 1.0), min(max(high, 0.0), 1.0)


def with_interval(counts: DataFrame, x: str, n: str, name: str, alpha: float = 0.05) -> DataFrame:
    """counts with name, name_lower, name_upper.  Each distinct (x, n) is worked out once and joined."""

    @F.pandas_udf("struct<share double, low double, high double>")
    def interval(xs: pd.Series, ns: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([jeffreys(a, b, alpha) for a, b in zip(xs, ns)], columns=["share", "low", "high"])

    pairs = counts.select(x, n).distinct().withColumn("_ci", interval(F.col(x).cast("double"), F.col(n).cast("double")))
    joined = counts.join(pairs, [x, n])
    return joined.select(*counts.columns, F.col("_ci.share").alias(name), F.col("_ci.low").alias(f"{name}_lower"), F.col("_ci.high").alias(f"{name}_upper"))


def feature_table(**tagged: DataFrame) -> DataFrame:
    """Union by name of tables, each with its tag; columns that a table lacks are null."""
    out = None
    for tag, df in tagged.items():
        part = df.withColumn("tag", F.lit(tag))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out

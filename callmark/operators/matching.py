"""Matching of truth and query calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ALLELE = ["chrom", "pos", "ref", "alt"]


def intersection(truth: DataFrame, query: DataFrame, keys: list[str] = ALLELE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct alleles of both, of truth only, of query only."""
    t, q = truth.select(*keys).distinct(), query.select(*keys).distinct()
    return t.join(q, keys, "left_semi"), t.join(q, keys, "left_anti"), q.join(t, keys, "left_anti")


def allele_presence(truth: DataFrame, query: DataFrame, keys: list[str] = ALLELE) -> DataFrame:
    """Each distinct allele once, with in_truth and in_query: one grouping over both samples."""
    both = truth.select(*keys, F.lit(True).alias("_t")).unionByName(query.select(*keys, F.lit(False).alias("_t")))
    return both.groupBy(*keys).agg(F.max("_t").alias("in_truth"), (~F.min("_t")).alias("in_query"))


def one_to_one(truth: DataFrame, query: DataFrame, keys: list[str] = ALLELE, order: tuple[str, ...] = ("rid", "qq")) -> DataFrame:
    """Full outer join in which each call is used at most once: the n-th truth call of a key meets the n-th query call."""
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    t = truth.withColumn("_k", number).select(*keys, "_k", *[F.col(c).alias(f"{c}_truth") for c in truth.columns if c not in keys])
    q = query.withColumn("_k", number).select(*keys, "_k", *[F.col(c).alias(f"{c}_query") for c in query.columns if c not in keys])
    return t.withColumn("in_truth", F.lit(True)).join(q.withColumn("in_query", F.lit(True)), [*keys, "_k"], "full_outer").drop("_k")


def near(a: DataFrame, b: DataFrame, distance: int, found: bool = True) -> DataFrame:
    """Rows of a with (or without) a row of b at most `distance` bases away, on bins as wide as the distance."""
    width = max(1, distance)
    bins = F.explode(F.array(*[F.floor(F.col("pos") / width) + d for d in (-1, 0, 1)]))
    right = b.select("chrom", "pos").distinct().select(F.col("chrom").alias("_c"), F.col("pos").alias("_p"), bins.alias("_b"))
    left = a.withColumn("_bin", F.floor(F.col("pos") / width))
    on = (F.col("chrom") == F.col("_c")) & (F.col("_bin") == F.col("_b")) & (F.abs(F.col("pos") - F.col("_p")) <= distance)
    return left.join(right, on, "left_semi" if found else "left_anti").drop("_bin")


def position_zip(a: DataFrame, b: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """The n-th row of a position joined with the n-th of the same position."""
    number = F.row_number().over(Window.partitionBy("chrom", "pos").orderBy(*order))
    left = a.withColumn("k", number)
    right = b.withColumn("k", number).select("chrom", "pos", "k", *[F.col(c).alias(f"b_{c}") for c in b.columns if c not in ("chrom", "pos")])
    return left.join(right, ["chrom", "pos", "k"])

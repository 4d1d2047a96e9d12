"""Stratified counts, ROC curves and the tables made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callmark.functions import calls as C

TINY = 2.2250738585072014e-308


def labelled(matched: DataFrame) -> DataFrame:
    """matched: a one_to_one() join with in_truth, in_query.  bd_truth (TP, FN or null) and bd_query (TP, FP or null)."""
    both = F.col("in_truth").isNotNull() & F.col("in_query").isNotNull() & (F.col("gt_truth") == F.col("gt_query"))
    return matched.withColumn("bd_truth", F.when(F.col("in_truth"), F.when(both, "TP").otherwise("FN"))).withColumn(
        "bd_query", F.when(F.col("in_query"), F.when(both, "TP").otherwise("FP"))
    )


def unknown_outside(rows: DataFrame, confident: Column) -> DataFrame:
    """Outside of the confident regions both samples' decisions become UNK."""
    out = lambda c: F.when(F.col(c).isNotNull(), F.when(confident, F.col(c)).otherwise("UNK"))
    return rows.withColumn("bd_truth", out("bd_truth")).withColumn("bd_query", out("bd_query"))


def decision_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: truth_total, truth_tp, truth_fn, query_total, query_fp, query_tp, query_unk."""
    n = lambda c: F.count(F.when(c, 1))
    t, q = F.col("bd_truth"), F.col("bd_query")
    return rows.groupBy(*keys).agg(
        n(t.isin("TP", "FN")).alias("truth_total"),
        n(t == "TP").alias("truth_tp"),
        n(t == "FN").alias("truth_fn"),
        n(q.isin("TP", "FP", "UNK")).alias("query_total"),
        n(q == "TP").alias("query_tp"),
        n(q == "FP").alias("query_fp"),
        n(q == "UNK").alias("query_unk"),
    )


def with_metrics(counts: DataFrame, digits: int = 6) -> DataFrame:
    """Recall, precision, share not assessed and F1.  Precision is 0 for an empty query and null where nothing was assessed."""
    p = F.when(F.col("query_total") == 0, F.lit(0.0)).otherwise(C.precision(F.col("query_tp"), F.col("query_fp")))
    r = F.when(F.col("truth_total") == 0, F.lit(0.0)).otherwise(C.recall(F.col("truth_tp"), F.col("truth_fn")))
    rounded = counts.withColumn("recall", r).withColumn("precision", p).withColumn("frac_na", C.ratio(F.col("query_unk"), F.col("query_total"))).withColumn("f1", C.f1(F.col("recall"), F.col("precision")))
    return rounded.select(*counts.columns, *[F.round(c, digits).alias(c) for c in ("recall", "precision", "frac_na", "f1")])


def filter_strata(rows: DataFrame, filter_col: str = "filt") -> DataFrame:
    """Each row under ALL and, as the decision stands after filtering, under PASS: two copies of a row, not two plans."""
    failed = ~F.col(filter_col).isin("PASS", ".")
    passed_truth = F.when(failed & (F.col("bd_truth") == "TP"), "FN").otherwise(F.col("bd_truth"))
    stratum = lambda name, t, q: F.struct(F.lit(name).alias("filter"), t.alias("bd_truth"), q.alias("bd_query"))
    both = F.array(stratum("ALL", F.col("bd_truth"), F.col("bd_query")), stratum("PASS", passed_truth, F.when(~failed, F.col("bd_query"))))
    kept = [c for c in rows.columns if c not in ("bd_truth", "bd_query")]
    return rows.select(*kept, F.inline(both))


def subset_strata(rows: DataFrame, subsets: Column) -> DataFrame:
    """Each row under the subset * and under each of its own (an array of names)."""
    return rows.select(*rows.columns, F.explode(F.concat(F.array(F.lit("*")), F.coalesce(subsets, F.array().cast("array<string>")))).alias("subset"))


def false_positive_split(matched: DataFrame, truth: DataFrame) -> DataFrame:
    """matched: one_to_one() rows with decisions.  fp_kind of false positives: gt (the allele is true, the genotype is not), al (a true call with other alleles stands there), or none."""
    at = truth.select("chrom", "pos").distinct().withColumn("_there", F.lit(True))
    kind = F.when(F.col("in_truth"), "gt").when(F.col("_there"), "al").otherwise("none")
    return matched.where(F.col("bd_query") == "FP").join(at, ["chrom", "pos"], "left").withColumn("fp_kind", kind).drop("_there")


def subtype_strata(rows: DataFrame) -> DataFrame:
    """Each row under its subtype and under *, its genotype and *: the strata overlap, so rows are copied, not cubed."""
    copies = F.explode(F.array(F.struct("subtype", F.lit("*").alias("genotype")), F.struct(F.lit("*").alias("subtype"), "genotype"), F.struct("subtype", "genotype"), F.struct(F.lit("*").alias("subtype"), F.lit("*").alias("genotype"))))
    kept = [c for c in rows.columns if c not in ("subtype", "genotype")]
    return rows.select(*kept, copies.alias("_s")).select(*kept, "_s.subtype", "_s.genotype")


def cumulative(rows: DataFrame, keys: list[str], level: str = "level") -> DataFrame:
    """rows: keys, level, decision (TP, FN, TP2, FP, UNK, N), n.  One row per level: the counts if calls up to it are dropped.

    TP falls and FN rises by what is dropped.  Counts are summed per level first, so that a window holds the
    distinct levels of a stratum and not its calls.
    """
    of = lambda d: F.sum(F.when(F.col("decision") == d, F.col("n")).otherwise(0))
    names = ["TP", "FN", "TP2", "FP", "UNK", "N"]
    per_level = rows.groupBy(*keys, level).agg(*[of(d).alias(f"_{d}") for d in names])
    upto = Window.partitionBy(*keys).orderBy(level).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    c = lambda d: F.sum(f"_{d}").over(upto)
    t = lambda d: F.sum(f"_{d}").over(whole)
    return per_level.select(
        *keys,
        level,
        (t("TP") - c("TP")).alias("tp"),
        (t("FN") + c("TP")).alias("fn"),
        (t("TP2") - c("TP2")).alias("tp2"),
        (t("FP") - c("FP")).alias("fp"),
        (t("UNK") - c("UNK")).alias("unk"),
        (t("N") + c("FP") + c("UNK")).alias("n"),
    )


def thinned(curve: DataFrame, keys: list[str], delta: float, level: str = "level") -> DataFrame:
    """The levels of a curve of which each differs from the one kept before by more than delta; the first is kept.

    Which level is kept depends on the one kept before, so the levels of a stratum (not its calls) are folded in order.
    """
    levels = curve.groupBy(*keys).agg(F.array_sort(F.collect_set(level)).alias("_l"))
    first = F.array(F.get("_l", F.lit(0)))
    kept = F.aggregate(F.slice("_l", F.lit(2), F.greatest(F.size("_l") - 1, F.lit(0))), first, lambda a, x: F.when(F.abs(x - F.element_at(a, -1)) > delta, F.concat(a, F.array(x))).otherwise(a))
    return curve.join(levels.select(*keys, F.explode(kept).alias(level)), [*keys, level], "left_semi")


def simple_roc(rows: DataFrame, value: str, tag: str, keys: list[str] | None = None) -> DataFrame:
    """One row per distinct value: tp and fp at or above it, fn of all and what lies below."""
    keys = keys or []
    n = lambda t: F.count(F.when(F.col(tag) == t, 1))
    per = rows.groupBy(*keys, value).agg(n("TP").alias("_tp"), n("FP").alias("_fp"), n("FN").alias("_fn"))
    onward = Window.partitionBy(*keys).orderBy(value).rowsBetween(0, Window.unboundedFollowing)
    earlier = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    fn = F.sum("_fn").over(whole) + F.coalesce(F.sum("_tp").over(earlier), F.lit(0))
    return per.select(*keys, value, F.sum("_tp").over(onward).alias("tp"), F.sum("_fp").over(onward).alias("fp"), fn.alias("fn"))


def floor_level(level: Column, decision: Column) -> Column:
    """A missed call's score of 0 becomes the least positive double."""
    return F.when((level == 0) & decision.isin("FN", "FN2", "N"), F.lit(TINY)).otherwise(level)

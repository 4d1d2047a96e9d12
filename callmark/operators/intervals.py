"""Interval algebra on (chrom, start, stop, label), both ends inclusive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callmark.sources.scratch import written

#: Width of the bins on which overlaps are joined; an interval is copied into each bin that it touches.
BIN = 1024


def islands(df: DataFrame, keys: list[str], start: str, stop: str, slack: int, bin_width: int = 1 << 20) -> DataFrame:
    """df with island_start: the least start of the maximal run in which no gap exceeds `slack`.

    A run ends where the greatest stop so far plus slack is less than the next start.  Rows are scanned within
    bins of positions, and only one row per bin is scanned for the whole key, so that a key with very many
    rows (a chromosome) is spread over tasks.  df is computed once and written, since three steps read it.
    """
    b = written(df.withColumn("_bin", F.floor(F.col(start) / bin_width)), "islands")
    ahead = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    reach = b.groupBy(*keys, "_bin").agg(F.max(stop).alias("_reach")).withColumn("_before", F.max("_reach").over(ahead)).drop("_reach")
    local = Window.partitionBy(*keys, "_bin").orderBy(start, stop)
    seen = F.greatest(F.max(stop).over(local.rowsBetween(Window.unboundedPreceding, -1)), F.col("_before"))
    marked = b.join(reach, [*keys, "_bin"]).withColumn("_seen", seen)
    marked = marked.withColumn("_first", F.when(F.col("_seen").isNull() | (F.col("_seen") + slack < F.col(start)), F.col(start))).drop("_seen", "_before")
    last = marked.groupBy(*keys, "_bin").agg(F.max("_first").alias("_last")).withColumn("_open", F.max("_last").over(ahead)).drop("_last")
    own = F.max("_first").over(local.rangeBetween(Window.unboundedPreceding, Window.currentRow))  # equal rows see each other
    return marked.join(last, [*keys, "_bin"]).withColumn("island_start", F.coalesce(own, F.col("_open"))).drop("_bin", "_first", "_open")


def merged(df: DataFrame, keys: list[str], start: str = "start", stop: str = "stop") -> DataFrame:
    """Union of the intervals of each key; adjacent ones are joined."""
    runs = islands(df, keys, start, stop, 1)
    return runs.groupBy(*keys, F.col("island_start").alias(start)).agg(F.max(stop).alias(stop)).select(*keys, start, stop)


def _bins(start: Column, stop: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor(F.greatest(start, stop) / width)))


def overlapping(a: DataFrame, b: DataFrame, start: str = "start", stop: str = "stop", width: int = BIN) -> DataFrame:
    """Pairs of rows of the same chrom that overlap: columns of a, and those of b with the prefix b_.

    A pair that shares several bins is kept in the first of them.
    """
    right = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns])
    left = a.withColumn("_bin", _bins(F.col(start), F.col(stop), width))
    right = right.withColumn("_bin", _bins(F.col("b_start"), F.col("b_stop"), width))
    on = (F.col("chrom") == F.col("b_chrom")) & (left["_bin"] == right["_bin"]) & (F.col(start) <= F.col("b_stop")) & (F.col(stop) >= F.col("b_start"))
    first = F.floor(F.greatest(F.col(start), F.col("b_start")) / width)
    return left.join(right, on & (left["_bin"] == first)).drop("_bin")


def touched(a: DataFrame, b: DataFrame, keys: list[str], out: str, start: str = "start", stop: str = "stop", width: int = BIN) -> DataFrame:
    """The distinct keys (chrom among them) of a with `out`: whether an interval of b overlaps one of their rows.  a is read once, no pairs are kept."""
    right = b.select(F.col("chrom"), F.col("start").alias("_b_start"), F.col("stop").alias("_b_stop"), _bins(F.col("start"), F.col("stop"), width).alias("_bin"))
    left = a.select(*keys, F.col(start).alias("_a_start"), F.col(stop).alias("_a_stop"), _bins(F.col(start), F.col(stop), width).alias("_bin"))
    hit = F.coalesce((F.col("_a_start") <= F.col("_b_stop")) & (F.col("_a_stop") >= F.col("_b_start")), F.lit(False))
    return left.join(right, ["chrom", "_bin"], "left").groupBy(*keys).agg(F.max(hit).alias(out))


def with_labels(calls: DataFrame, regions: DataFrame, id_cols: list[str], start: str = "start", stop: str = "stop") -> DataFrame:
    """calls with `labels`, the sorted distinct labels that they overlap (empty if none)."""
    hits = overlapping(calls, regions, start, stop).groupBy(*id_cols).agg(F.array_sort(F.collect_set("b_label")).alias("labels"))
    return calls.join(hits, id_cols, "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))


def covered(calls: DataFrame, regions: DataFrame, start: str = "start", stop: str = "stop") -> DataFrame:
    """Pairs of a call and a merged interval of one label that contains it."""
    whole = merged(regions, ["chrom", "label"])
    return overlapping(calls, whole, start, stop).where((F.col("b_start") <= F.col(start)) & (F.col(stop) <= F.col("b_stop")))


def intersection_size(a: DataFrame, b: DataFrame) -> DataFrame:
    """Bases that the merged intervals of each pair of labels share."""
    pairs = overlapping(merged(a, ["chrom", "label"]), merged(b, ["chrom", "label"]))
    size = F.least("stop", "b_stop") - F.greatest("start", "b_start") + 1
    return pairs.groupBy("label", "b_label").agg(F.sum(size).alias("bases"))


def region_sizes(regions: DataFrame) -> DataFrame:
    """Sum of lengths per label; bases covered twice count twice."""
    return regions.groupBy("label").agg(F.sum(F.col("stop") - F.col("start") + 1).alias("bases"))


def disorder(regions: DataFrame) -> DataFrame:
    """Intervals that begin before an earlier one of the same chrom has ended."""
    spread = regions.withColumn("_bin", F.floor(F.col("start") / (1 << 20)))
    ahead = Window.partitionBy("chrom").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    reach = spread.groupBy("chrom", "_bin").agg(F.max("stop").alias("_r")).withColumn("_before", F.max("_r").over(ahead)).drop("_r")
    local = Window.partitionBy("chrom", "_bin").orderBy("start", "stop", "label").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.greatest(F.max("stop").over(local), F.col("_before"))
    return spread.join(reach, ["chrom", "_bin"]).withColumn("_seen", seen).where("_seen >= start").select(*regions.columns)

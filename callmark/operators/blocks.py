"""Superloci: maximal runs of calls with gaps of at most a window, and what is passed on within them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callmark.operators.intervals import islands

WINDOW = 50


def superloci(calls: DataFrame, window: int = WINDOW) -> DataFrame:
    """calls with bs, the first position of the run; a run ends where the greatest end so far plus window is less than the next pos."""
    ended = calls.withColumn("_stop", F.col("pos") + F.length("ref") - 1)
    return islands(ended, ["chrom"], "pos", "_stop", window).withColumnRenamed("island_start", "bs").drop("_stop")


def block_table(blocked: DataFrame) -> DataFrame:
    return blocked.groupBy("chrom", "bs").agg(F.count("*").alias("n"), F.max(F.col("pos") + F.length("ref") - 1).alias("be"))


def chunks(blocked: DataFrame, pieces: int) -> DataFrame:
    """Blocks dealt into about equal contiguous chunks of each chrom: chrom, bs, n, chunk (from 0)."""
    table = block_table(blocked)
    before = Window.partitionBy("chrom").orderBy("bs").rowsBetween(Window.unboundedPreceding, -1)
    total = table.groupBy("chrom").agg(F.sum("n").alias("_all"))
    at = F.coalesce(F.sum("n").over(before), F.lit(0))
    return table.withColumn("_at", at).join(total, "chrom").select("chrom", "bs", "n", F.floor(F.col("_at") * pieces / F.col("_all")).alias("chunk"))


def propagated_qq(rows: DataFrame) -> DataFrame:
    """rows: chrom, bs, bd_query, qq_query, bd_truth.  qq_truth: the query's own score if it is a TP, else the least of the block's."""
    block = Window.partitionBy("chrom", "bs")
    least = F.min(F.when(F.col("bd_query") == "TP", F.col("qq_query"))).over(block)
    own = F.when(F.col("bd_query") == "TP", F.col("qq_query"))
    return rows.withColumn("qq_truth", F.when(F.col("bd_truth").isNotNull(), F.coalesce(own, least)))


def propagated_filters(rows: DataFrame) -> DataFrame:
    """rows: chrom, bs, filters, bd_truth, bd_query.  A truth TP without a query call takes the block's filters."""
    union = rows.select("chrom", "bs", F.explode("filters").alias("_f")).groupBy("chrom", "bs").agg(F.array_sort(F.collect_set("_f")).alias("_all"))
    takes = (F.col("bd_truth") == "TP") & F.col("bd_query").isNull()
    joined = rows.join(union, ["chrom", "bs"], "left")
    return joined.withColumn("filters", F.when(takes, F.coalesce("_all", F.array().cast("array<string>"))).otherwise(F.col("filters"))).drop("_all")


def confidence_flags(rows: DataFrame) -> DataFrame:
    """rows: chrom, bs, conf (boolean).  Per block: ts_boundary if it has both kinds of rows, ts_contained if all are confident."""
    any_, all_ = F.max("conf"), F.min("conf")
    return rows.groupBy("chrom", "bs").agg((any_ & ~all_).alias("ts_boundary"), all_.alias("ts_contained"))

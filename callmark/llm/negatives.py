"""Operator 12: hard negatives by sorting every score of an anchor.

Rows are dealt to blocks, and every anchor is sent to each block.  A task reads a block's rows, then the block's
anchors as they come; all integer scores of an anchor are computed and sorted (higher first, ties by the smaller id).
A first round reads the leading rows of the anchor's own label; the leaders of the blocks are merged into its
positives.  A second round sorts the scores of the rows of other labels, searches each positive's upper limit by
bisection and reads the first ones from there, down to the lower limit; of the blocks' findings the first ones stay.
The leaders of the blocks contain the leaders of the table, so that nothing is lost; a task holds one block and one
batch of anchors, whatever the size of the table.

Rows with a null id, label or vector, with a null or non-finite component, or with another number of components than
the table (the most frequent one) take no part.  Of rows that are equal in every respect each is a row of its own:
an anchor leaves out one of them, itself.  Components whose floor(256 x) is so large that a score might not fit a
long count as the largest that does (2^28 for 64 components).  An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callmark.llm.common import materialise, table
from callmark.llm.vectors import dimension, finite, matrix

SCALE, POSITIVES, NEGATIVES = 256, 5, 3
#: Percent of a positive's score between which a negative's lies.
LOWER, UPPER = 50, 95
#: Rows of a block; anchors whose scores a task holds at once.
ROWS, ANCHORS = 2048, 256


def quantised(v: np.ndarray) -> np.ndarray:
    """floor(256 x), within the bound that keeps a score a long."""
    most = float(math.isqrt(2**62 // v.shape[1]))
    with np.errstate(over="ignore"):
        return np.clip(np.floor(v * SCALE), -most, most).astype(np.int64)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of a with all rows of b."""
    if a.shape[1] * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def limits(score: int) -> tuple[int, int]:
    """Least and greatest whole s with LOWER p <= 100 s <= UPPER p."""
    return -(-LOWER * score // 100), UPPER * score // 100


def _meet(batches: Iterator[pa.RecordBatch], d: int, body: Callable) -> Iterator[pa.RecordBatch]:
    """body(rows of a block, some of its anchors) for batches of (block, anchor, id, label, v, ...), sorted by block, rows (anchor null) first."""
    now, rows, parts = None, None, []
    for batch in batches:
        block = batch.column(0).to_numpy()
        is_row = np.asarray(batch.column(1).is_null())
        cuts = [0, *(np.flatnonzero((np.diff(block) != 0) | (np.diff(is_row.astype(np.int8)) != 0)) + 1), len(block)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo == hi:
                continue
            if block[lo] != now:
                now, rows, parts = block[lo], None, []
            part = batch.slice(lo, hi - lo)
            if is_row[lo]:
                parts.append(part)
                continue
            if rows is None:
                held = pa.Table.from_batches(parts).combine_chunks() if parts else part.slice(0, 0)
                rows = held.column("id").to_numpy(), held.column("label").to_numpy(), quantised(np.concatenate([matrix(p.column(4), d) for p in parts]) if parts else np.zeros((0, d)))
                parts = []
            for at in range(0, hi - lo, ANCHORS):
                some = part.slice(at, ANCHORS)
                yield from body(rows, some, quantised(matrix(some.column(4), d)))


def _table(found: list[tuple], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    if found:
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)], names)


def leading_same(met: DataFrame, d: int, k: int) -> DataFrame:
    """anchor, score, id: the first k rows of each anchor's label, itself left out."""
    names, kinds = ["anchor", "score", "id", "self"], [pa.int64(), pa.int64(), pa.int64(), pa.bool_()]

    def lead(rows, some, a):
        ids, labels, x = rows
        keys, a_ids, a_labels = (some.column(n).to_numpy() for n in ("anchor", "id", "label"))
        found = []
        for label in np.unique(a_labels):
            mine, theirs = np.flatnonzero(a_labels == label), np.flatnonzero(labels == label)
            for p, row in zip(mine, scores(a[mine], x[theirs])):
                for o in np.lexsort((ids[theirs], -row))[: k + 1]:
                    at = theirs[o]
                    found.append((int(keys[p]), int(row[o]), int(ids[at]), bool(ids[at] == a_ids[p] and (x[at] == a[p]).all())))
        return _table(found, names, kinds)

    found = met.mapInArrow(lambda batches: _meet(batches, d, lead), "anchor long, score long, id long, self boolean")
    # one of the rows that equal the anchor is the anchor itself; blocks give one leader more for it
    own = F.row_number().over(Window.partitionBy("anchor", "self").orderBy(F.col("score").desc(), "id"))
    others = found.withColumn("_own", F.col("self") & (own == 1)).where(~F.col("_own"))
    return others.withColumn("_r", F.row_number().over(Window.partitionBy("anchor").orderBy(F.col("score").desc(), "id"))).where(F.col("_r") <= k).select("anchor", "score", "id")


def between(met: DataFrame, d: int, k: int) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores: the first k rows of other labels within each positive's limits."""
    names = ["anchor", "at", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
    kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]

    def read(rows, some, a):
        ids, labels, x = rows
        keys, a_ids, a_labels = (some.column(n).to_numpy() for n in ("anchor", "id", "label"))
        found = []
        for p, (row, positives) in enumerate(zip(scores(a, x), some.column("positives").to_pylist())):
            other = labels != a_labels[p]
            score, own = row[other], ids[other]
            order = np.lexsort((own, -score))
            falling = -score[order]
            for at, positive in enumerate(positives):
                least, most = limits(positive["score"])
                first, last = np.searchsorted(falling, -most, side="left"), np.searchsorted(falling, -least, side="right")
                found += [(int(keys[p]), at, int(a_ids[p]), positive["id"], positive["score"], int(own[o]), int(score[o])) for o in order[first : min(last, first + k)]]
        return _table(found, names, kinds)

    found = met.mapInArrow(lambda batches: _meet(batches, d, read), "anchor long, at int, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    ahead = Window.partitionBy("anchor", "at").orderBy(F.col("negative_score").desc(), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(ahead).cast("int")).where(F.col("rank") <= k)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def hard_negatives(rows: DataFrame, is_anchor: str | Column, positives: int = POSITIVES, negatives: int = NEGATIVES, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; is_anchor: a condition on the column id."""
    d = dimension(rows, vector_col)
    own = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("v")).where("id IS NOT NULL AND label IS NOT NULL")
    own = finite(own, max(d, 1), "v")
    blocks = max(1, -(-own.count() // ROWS))
    # dealt in turn, so that blocks are equally large, whatever repeats
    dealt = materialise(own.repartition(blocks).withColumn("block", F.spark_partition_id().cast("long")), "rows")
    asked = materialise(own.where(is_anchor).withColumn("anchor", F.monotonically_increasing_id()), "anchors")

    def met(anchors: DataFrame) -> DataFrame:
        sent = anchors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))
        more = [c for c in anchors.columns if c not in ("anchor", "id", "label", "v")]
        order = ["block", "anchor", "id", "label", "v", *more]
        both = dealt.select("block", F.lit(None).cast("long").alias("anchor"), "id", "label", "v", *[F.lit(None).cast(anchors.schema[c].dataType).alias(c) for c in more])
        return both.unionByName(sent.select(*order)).repartition("block").sortWithinPartitions("block", F.col("anchor").asc_nulls_first())

    firsts = leading_same(met(asked), d, positives)
    # at most `positives` entries of an anchor
    lists = firsts.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "id"))).alias("p"))
    known = lists.select("anchor", F.transform("p", lambda x: F.struct((-x["less"]).alias("score"), x["id"].alias("id"))).alias("positives"))
    known = materialise(asked.join(known, "anchor"), "positives")
    return between(met(known), d, negatives)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", "embedding", label.alias("label")), F.col("id") % 50 == 0)


OP12_SQL = """
WITH t AS (
  SELECT row_number() OVER () AS r, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT) for c in embedding] AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([c for c in embedding if c IS NOT NULL AND isfinite(c)]) = len(embedding)
), s AS (
  SELECT a.r AS ar, a.id AS anchor_id, b.r AS br, b.id AS id, a.label = b.label AS same,
         CAST(list_sum([a.x[i] * b.x[i] for i in range(1, len(a.x) + 1)]) AS BIGINT) AS score
  FROM t a, t b WHERE a.id % 50 = 0 AND a.r <> b.r
), p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, id) AS pos FROM s WHERE same) ranked WHERE pos <= 5
), n AS (
  SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.ar, p.pos ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
  FROM p JOIN s ON s.ar = p.ar AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

"""Operator 1: exact top-k search among binary codes by incremental multi-index hashing.

Codes are cut into segments of about the logarithm of an eighth of the number of codes, each of which is an index from
the segment's value to the codes that have it.  Radius 0 looks up a query's own values in all segments; then the
radius grows one segment after the other: a step looks up all values at distance r in one segment.  When of m
segments j have been searched up to r and the others up to r - 1, all codes within m r + j - 1 have been seen
(one that is farther off in each segment differs in more bits).  Hits are verified by the whole Hamming
distance, and those beyond the k-th that is known are dropped within the join; a query is done when its k-th
verified distance lies within that radius, and the others go on.

Equal codes are one entry of the index, with their number and their k least ids, so that copies cost nothing.
Ties are broken by the least id.  Rows without a vector or an id are neither found nor asked for; codes have as
many words of 64 bits as the longest vector needs, shorter vectors have 0 in the remaining bits, and entries
that are null or NaN give 0.  A repeated id is found as often as it stands.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callmark.llm.common import materialise, table

WORD, TOP = 64, 10
#: Bits of a segment: about the logarithm of the number of codes, within these bounds.
LEAST_BITS, MOST_BITS = 8, 22
#: Codes that a look-up is to meet: it is made, dealt and sorted, while a code that it meets is only compared.
MET = 8


def words_of(rows: DataFrame, vector_col: str = "embedding") -> int:
    """Words of 64 bits that the longest vector needs."""
    return max(1, -(-(rows.agg(F.max(F.size(vector_col))).first()[0] or 0) // WORD))


def sign_codes(rows: DataFrame, words: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, code (array of `words` longs): bit i is set where entry i is above 0."""
    v, one, none = F.col(vector_col), F.lit(1).cast("long"), F.lit(0).cast("long")
    positive = lambda i: F.coalesce((F.get(v, i) > 0) & ~F.isnan(F.get(v, i)), F.lit(False))
    places = F.sequence(F.lit(0), F.lit(WORD - 1))
    word = lambda w: F.aggregate(places, none, lambda a, i: a.bitwiseOR(F.when(positive(i + w * WORD), F.call_function("shiftleft", one, i)).otherwise(none)))
    return rows.where(v.isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.array(*[word(w) for w in range(words)]).alias("code"))


def code_index(codes: DataFrame, k: int) -> DataFrame:
    """code, n (rows with it), ids (the k least)."""
    salted = codes.withColumn("_salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    few = salted.withColumn("_r", F.row_number().over(Window.partitionBy("code", "_salt").orderBy("vec_id"))).where(F.col("_r") <= k)
    fewer = few.withColumn("_r", F.row_number().over(Window.partitionBy("code").orderBy("vec_id"))).where(F.col("_r") <= k)
    ids = fewer.groupBy("code").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))  # at most k
    return codes.groupBy("code").agg(F.count("*").alias("n")).join(ids, "code")


def segments_of(words: int, entries: int) -> list[tuple[int, int, int]]:
    """(word, first bit, bits) of each segment: equal shares of a word."""
    bits = min(MOST_BITS, max(LEAST_BITS, math.log2(max(2, entries))))
    parts = max(round(WORD / bits), -(-WORD // MOST_BITS))
    cuts = [WORD * i // parts for i in range(parts + 1)]
    return [(w, lo, hi - lo) for w in range(words) for lo, hi in zip(cuts, cuts[1:])]


def nearest_codes(asked: DataFrame, index: DataFrame, words: int, k: int) -> DataFrame:
    """asked: q (distinct codes); index as code_index() gives.  q, code, distance: the k nearest codes of each q."""
    entries = index.count()
    segments = segments_of(words, entries // MET)
    m = len(segments)
    value = lambda c, s: F.shiftrightunsigned(F.get(c, F.lit(s[0])), s[1]).bitwiseAND(F.lit((1 << s[2]) - 1).cast("long"))
    parts = lambda c: F.array(*[F.struct(F.lit(j).alias("seg"), value(c, s).alias("value")) for j, s in enumerate(segments)])
    apart = sum((F.bit_count(F.get("q", F.lit(w)).bitwiseXOR(F.get("code", F.lit(w)))) for w in range(words)), F.lit(0))
    lookup = index.select("code", "n", F.get("ids", F.lit(0)).alias("least"), F.inline(parts(F.col("code"))))
    lookup = materialise(lookup.repartitionByRange("seg", "value").sortWithinPartitions("seg", "value"), "segments")
    asked = materialise(asked.select("q").distinct(), "asked")
    ahead = Window.partitionBy("q").orderBy("distance", "least", "code")
    first = lambda hits, n: hits.withColumn("_r", F.row_number().over(ahead)).where(F.col("_r") <= n).drop("_r")

    def met(probes: Column, pending: DataFrame, found: DataFrame) -> DataFrame:
        """probes: (seg, value) of each query; pending: q, limit (the distance of the k-th that is known, null before).

        Look-ups are many more than queries, so both sides are dealt by value; what is farther than the limit goes within the join.
        """
        looked = pending.select("q", "limit", F.inline(probes)).join(found.hint("merge"), ["seg", "value"])
        near = looked.where(F.col("limit").isNull() | (apart <= F.col("limit")))
        return near.select("q", "code", apart.alias("distance"), "n", "least")

    unlimited = asked.withColumn("limit", F.lit(None).cast("int"))
    best = materialise(first(first(met(parts(F.col("q")), unlimited, lookup), m * k).distinct(), k), "nearest")
    for radius, j in itertools.product(range(1, max(s[2] for s in segments) + 1), range(m)):
        covered = m * radius + j - 1
        upto = F.sum("n").over(ahead.rowsBetween(Window.unboundedPreceding, 0))
        all_of_them = F.count("*").over(Window.partitionBy("q")) == entries
        done = best.select("q", (all_of_them | (upto >= k) & (F.col("distance") <= covered)).alias("_done")).where("_done").select("q").distinct()
        limits = best.select("q", F.when(upto >= k, F.col("distance")).alias("_d")).groupBy("q").agg(F.min("_d").alias("limit"))
        pending = asked.join(done, "q", "left_anti").join(limits, "q", "left")
        if covered >= WORD * words or pending.isEmpty():
            break
        if radius > segments[j][2]:
            continue
        masks = " ".join(str(sum(1 << b for b in on)) for on in itertools.combinations(range(segments[j][2]), radius))
        own = value(F.col("q"), segments[j])
        probes = F.transform(F.expr(f"cast(split('{masks}', ' ') as array<bigint>)"), lambda x: F.struct(F.lit(j).alias("seg"), own.bitwiseXOR(x).alias("value")))
        # a code is met once in this segment, and once at most in an earlier step
        hits = met(probes, pending, lookup.where(F.col("seg") == j)).unionByName(best)
        best = materialise(first(first(hits, 2 * k).distinct(), k), "nearest")
    return best.select("q", "code", "distance")


def top_k(rows: DataFrame, queries: DataFrame, k: int = TOP, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, distance: the k rows nearest to each query, a query itself included if it is a row."""
    words = max(words_of(rows, vector_col), words_of(queries, vector_col))
    index = materialise(code_index(sign_codes(rows, words, id_col, vector_col), k), "codes")
    asked = materialise(sign_codes(queries, words, id_col, vector_col).select(F.col("vec_id").alias("query_id"), F.col("code").alias("q")), "queries")
    near = nearest_codes(asked.select("q"), index, words, k).join(index.select("code", "ids"), "code").select("q", "distance", F.explode("ids").alias("vec_id"))
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("distance", "vec_id"))).where(F.col("rank") <= k)
    return asked.join(ranked, "q").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("distance").cast("int").alias("distance"))


def op1_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows, rows.where("vec_id % 100 = 0"))


OP1_SQL = """
WITH codes AS (
  SELECT vec_id, embedding AS v FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
), d AS (
  SELECT q.vec_id AS query_id, r.vec_id AS vec_id,
         CAST(list_sum([CASE WHEN (q.v[i] > 0) <> (r.v[i] > 0) THEN 1 ELSE 0 END for i in range(1, len(r.v) + 1)]) AS INTEGER) AS distance
  FROM codes q, codes r WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank, vec_id, distance FROM d
)
SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= 10
"""

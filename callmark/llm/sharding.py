"""Operator 3: sharding by minimax contiguous partition.

Groups of equal texts are atomic and stand in the order of a hash of their text.  The smallest capacity
with which a greedy walk over that order fills no more than the wanted number of shards is found by binary
search.  Groups are not brought to the driver one by one: it walks over segments of the hash range with
their sizes, and only segments in which a cut may fall are split further, until each of them is one group.
The cuts are hash values, so that a row's shard follows from its own text and no join is needed.

Nulls count as empty texts; texts whose 64-bit hashes agree count as one group.  A single group larger than
an even share sets the capacity; the other shards then share the rest evenly within that capacity.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callmark.llm.common import materialise, table

#: Segments of the first look at the hash range, and the factor of each further look: bounds on what reaches the driver.
FIRST_BITS, MORE_BITS = 14, 8
#: Segments with no more groups than this in all are split into single groups at once.
SINGLE_GROUPS = 50_000
#: Cells in which the rows of a shard are numbered apart.
CELLS = 1024


def _ordered(h: Column) -> Column:
    """A signed 64-bit hash as 63 bits that are never negative, so that high bits order as numbers do."""
    return F.shiftrightunsigned(h, 1)


class Segments:
    """Sizes of consecutive ranges of the hash order. rows: (first value, width in bits, bytes, groups)."""

    def __init__(self, rows: list[tuple[int, int, int, int]]):
        self.rows = sorted(rows)
        self.ends = [0, *accumulate(r[2] for r in self.rows)]
        self.total = self.ends[-1]
        self.wanted: set[int] = set()

    def _inside(self, at: int) -> None:
        """Byte position `at` lies within a segment: more must be known of it unless it is one group."""
        k = bisect_right(self.ends, at) - 1
        if 0 <= k < len(self.rows) and self.ends[k] != at and self.rows[k][3] > 1:
            self.wanted.add(k)

    def floor(self, at: int) -> int:
        """The last border of groups at or before `at`."""
        self._inside(at)
        return self.ends[bisect_right(self.ends, at) - 1]

    def ceil(self, at: int) -> int:
        """The first border of groups at or after `at`."""
        self._inside(at)
        return self.ends[min(bisect_left(self.ends, at), len(self.ends) - 1)]

    def fits(self, capacity: int, shards: int) -> bool:
        at = 0
        for _ in range(shards):
            after = self.floor(at + capacity)
            if after >= self.total:
                return True
            if after <= at:
                return False
            at = after
        return False

    def capacity(self, shards: int, largest: int) -> int:
        low = max(-(-self.total // shards), largest, 1)
        high = low + largest
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if self.fits(middle, shards) else (middle + 1, high)
        return low

    def cuts(self, capacity: int, shards: int) -> list[int]:
        """Borders of the shards: none above the capacity, each as near as may be to an even share of what is left."""
        needed = [self.total]  # the earliest place from which so many shards suffice
        for _ in range(shards - 1):
            needed.append(self.ceil(max(0, needed[-1] - capacity)))
        at, out = 0, []
        for left in range(shards, 1, -1):
            goal = at + (self.total - at) // left
            below, above = self.floor(goal), self.ceil(goal)
            near = above if above - goal < goal - below and above <= at + capacity else below
            at = min(max(near, needed[left - 1], at), self.floor(at + capacity))
            out.append(at)
        return out

    def value(self, cut: int) -> int:
        """The first hash value after the border."""
        k = bisect_right(self.ends, cut) - 1
        while k > 0 and self.ends[k - 1] == cut:
            k -= 1
        return self.rows[k][0] if k < len(self.rows) else 1 << 63


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[list[int], int]:
    """groups: h (0 to 2^63-1), bytes.  The first hash value of each shard after the first, and the capacity."""
    width = 63 - FIRST_BITS
    top = F.shiftright("h", width)
    sums = (F.sum("bytes").alias("bytes"), F.count("*").alias("groups"), F.max("bytes").alias("largest"))
    first = groups.groupBy(top.alias("k")).agg(*sums).collect()  # at most 2^FIRST_BITS rows
    if not first:
        return [1 << 62] * (shards - 1), 1
    largest = max(r["largest"] for r in first)
    rows = [(r["k"] << width, width, r["bytes"], r["groups"]) for r in first]
    while True:
        seen = Segments(rows)
        capacity = seen.capacity(shards, largest)
        cuts = seen.cuts(capacity, shards)
        if not seen.wanted:
            return [seen.value(c) for c in cuts], capacity
        opened = [seen.rows[k] for k in sorted(seen.wanted)]
        rows = [r for k, r in enumerate(seen.rows) if k not in seen.wanted]
        whole = sum(r[3] for r in opened) <= SINGLE_GROUPS
        bits = {w for _, w, _, _ in opened}
        for w in bits:
            own = [r[0] >> w for r in opened if r[1] == w]
            next_w = 0 if whole else max(0, w - MORE_BITS)
            more = groups.where(F.shiftright("h", w).isin(own)).groupBy(F.shiftright("h", next_w).alias("k")).agg(*sums).collect()
            rows += [(r["k"] << next_w, next_w, r["bytes"], r["groups"]) for r in more]


def minimax_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's shard and place there: doc_id, size, text_crc32, law, shard, slot, grown_shard, capacity."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialise(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(text).cast("long") + 8).alias("size"),
            F.crc32(text).alias("text_crc32"),
            _ordered(F.xxhash64(text)).alias("h"),
        ),
        "shard-rows",
    )
    groups = materialise(rows.groupBy("h").agg(F.sum("size").alias("bytes")), "shard-groups")
    cuts, capacity = minimax_cuts(groups, shards)
    shard = sum((F.when(F.col("h") >= c, 1).otherwise(0) for c in cuts if c < 1 << 63), F.lit(0)).cast("int")
    # rows are numbered in cells, by a hash that knows nothing of texts, and each cell starts where those before it end
    dealt = rows.select("doc_id", "size", "text_crc32", shard.alias("shard"), F.pmod(F.xxhash64("doc_id", "h"), F.lit(CELLS)).cast("int").alias("cell"))
    counts = dealt.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "cell", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size")
    numbered = dealt.withColumn("rank", F.row_number().over(within))
    return numbered.join(F.broadcast(starts), ["shard", "cell"]).select(  # at most shards x CELLS rows
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("start") + F.col("rank") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.lit(capacity).cast("long").alias("capacity"),
    )


def op3_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minimax_shards(table(spark, sf_dir, "documents"))

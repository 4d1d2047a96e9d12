"""Queries over the comparison of alleles in blocks and over realigned alleles, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callmark.operators import alignment, allele_blocks
from callmark.operators.allele_blocks import APART, GAP, MOST
from callmark.sources.adapter import VIEWS, genome, query, sited_calls, truth
from callmark.sources.files import fetched

QUERIES, ORACLE = {}, {}


def query_of(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = VIEWS + sql
        return f

    return add


def _copies(spark, sf) -> DataFrame:
    one = lambda side, n: side(spark, sf).select("chrom", "pos", "ref", "alt", F.lit(n).alias("side"), F.when(F.col("gt") == "homalt", 2).otherwise(1).alias("copies"))
    return one(truth, 0).unionByName(one(query, 1))


def _runs(table: str, start: str, stop: str, slack: int, out: str) -> str:
    """table with the first start of each row's run in the column `out`, for DuckDB."""
    over = f"OVER (PARTITION BY chrom ORDER BY {start} ROWS BETWEEN UNBOUNDED PRECEDING AND"
    return f"""(SELECT * EXCLUDE (seen, run), min({start}) OVER (PARTITION BY chrom, run) AS {out} FROM (
    SELECT *, sum(CASE WHEN seen IS NULL OR seen + {slack} < {start} THEN 1 ELSE 0 END) {over} CURRENT ROW) AS run FROM (SELECT *, max({stop}) {over} 1 PRECEDING) AS seen FROM {table})))"""


BLOCKS = f"""
, a AS (SELECT chrom, pos, ref, alt, side, unnest(CASE WHEN gt = 'homalt' THEN [1, 2] ELSE [1] END) AS copy FROM (SELECT *, 0 AS side FROM truth UNION ALL SELECT *, 1 FROM query))
, size AS (SELECT chrom, pos, count(*) AS n, max(pos + length(ref) - 1) AS be FROM a GROUP BY ALL)
, sites AS (SELECT chrom, pos, n, be, CASE WHEN sum(n) OVER (PARTITION BY chrom, first) > {MOST} THEN pos ELSE first END AS atom FROM {_runs('size', 'pos', 'be', APART, 'first')})
, atoms AS (SELECT chrom, atom, sum(n) AS n, max(be) AS be FROM sites GROUP BY ALL)
, filled AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY chrom, far ORDER BY atom ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {MOST} AS k FROM {_runs('atoms', 'atom', 'be', GAP, 'far')})
, blocks AS (SELECT chrom, atom, min(atom) OVER (PARTITION BY chrom, far, k) AS block FROM filled)
, placed AS (SELECT a.*, block FROM a JOIN sites USING (chrom, pos) JOIN blocks USING (chrom, atom))
"""


@query_of(BLOCKS + """
, kinds AS (SELECT chrom, block, pos, ref, alt, count(*) AS n, 2 * least(count(*) FILTER (side = 0), count(*) FILTER (side = 1)) AS m FROM placed GROUP BY ALL)
SELECT chrom, block, CAST(sum(n) AS BIGINT) AS alleles, CAST(sum(m) AS BIGINT) AS matched FROM kinds GROUP BY ALL""")
def block_allele_scores(spark, sf):
    """Blocks with their copies of alleles, and how many have an equal one in the other sample."""
    return allele_blocks.block_counts(_copies(spark, sf), "alleles")


@query_of(BLOCKS + """
, spans AS (SELECT *, CASE WHEN length(ref) < length(alt) THEN pos + length(ref) - 1 ELSE pos END AS lo, greatest(pos + length(ref) - 1, CASE WHEN length(ref) < length(alt) THEN pos + length(ref) - 1 ELSE pos END) AS hi FROM placed)
, kinds AS (SELECT DISTINCT chrom, side, lo, hi FROM spans)
, near AS (SELECT * FROM kinds k WHERE EXISTS (SELECT 1 FROM kinds o WHERE o.chrom = k.chrom AND o.side <> k.side AND o.lo - 1 <= k.hi AND o.hi + 1 >= k.lo))
SELECT chrom, block, count(*) AS alleles, count(near.lo) AS matched FROM spans LEFT JOIN near USING (chrom, side, lo, hi) GROUP BY ALL""")
def block_distance_scores(spark, sf):
    """Blocks with their copies of alleles, and how many have one of the other sample within a base (the calls lie close)."""
    return allele_blocks.block_counts(_copies(spark, sf), "distance", distance=1)


@query_of()
def block_haplotype_decisions(spark, sf):
    """The copies of alleles on the genome with repeats that can be put on haplotypes on which both samples agree, by sample.  No SQL: a search."""
    alleles = allele_blocks.copies_of(sited_calls(spark, sf, 0), 0).unionByName(allele_blocks.copies_of(sited_calls(spark, sf, 1), 1))
    rows = allele_blocks.compared(alleles, genome(spark, sf), "haplotypes")
    snp = (F.length("ref") == 1) & (F.length("alt") == 1)
    return rows.groupBy("chrom", "side", F.when(snp, "SNP").otherwise("INDEL").alias("type"), "decision").agg(F.count("*").alias("alleles"), F.min("proven").alias("proven"))


def complex_alleles(spark, sf) -> DataFrame:
    """chrom, pos, ref, alt: the calls of the query that lie within 110 bases as one allele; of calls that overlap the first."""
    own = sited_calls(spark, sf, 1).select("chrom", "pos", "ref", F.get("alts", F.lit(0)).alias("alt"), F.floor(F.col("pos") / 110).alias("_near")).distinct()
    calls = F.array_sort(F.collect_list(F.struct("pos", "ref", "alt"))).alias("_calls")  # at most a few to each of 110 positions
    sites = own.groupBy("chrom", "_near").agg(calls, F.min("pos").alias("pos"), F.max(F.col("pos") + F.length("ref")).alias("_stop"))
    sites = fetched(sites.withColumn("_from", F.col("pos") - 1).withColumn("_to", F.col("_stop") - 2), genome(spark, sf), "_from", "_to", "ref")
    start = F.struct(F.lit("").alias("made"), F.col("pos").alias("here"))

    def add(a, c):
        kept = F.substr("ref", (a["here"] - F.col("pos") + 1).cast("int"), (c["pos"] - a["here"]).cast("int"))
        longer = F.struct(F.concat(a["made"], kept, c["alt"]).alias("made"), (c["pos"] + F.length(c["ref"])).alias("here"))
        return F.when(c["pos"] < a["here"], a).otherwise(longer)

    rest = lambda a: F.concat(a["made"], F.substr("ref", (a["here"] - F.col("pos") + 1).cast("int"), F.length("ref")))
    return sites.select("chrom", "pos", "ref", F.aggregate("_calls", start, add, rest).alias("alt"))


@query_of()
def realigned_primitives(spark, sf):
    """Complex alleles taken apart by alignment: edits and bases by chromosome and kind.  No SQL: affine alignment."""
    edits = alignment.realigned(complex_alleles(spark, sf))
    kind = F.when(F.length("ref") == 0, "insertion").when(F.length("alt") == 0, "deletion").otherwise("substitution")
    return edits.groupBy("chrom", kind.alias("kind")).agg(F.count("*").alias("edits"), F.sum(F.greatest(F.length("ref"), F.length("alt"))).alias("bases"))

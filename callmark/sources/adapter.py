"""Truth calls, query calls and confident regions derived from the driver tables, by arithmetic alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callmark.sources.files import CHUNK


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rid, chrom, pos (1-based), ref, alt, filt, gt (het, homalt), qq; two in ten are insertions or deletions."""
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus")
    q = F.col("l_quantity").cast("long")
    base = lambda i: F.substring(F.lit("ACGT"), (i + 1).cast("int"), F.lit(1))
    ref, alt = base(q % 4), base((q + 1 + F.col("l_linenumber") % 3) % 4)
    longer = (F.col("l_linenumber") * 3 - 2).cast("int")
    kind = F.col("l_partkey") % 10
    return li.select(
        F.col("l_orderkey").alias("rid"),
        F.concat(F.lit("chr"), (F.col("l_suppkey") % 22 + 1).cast("string")).alias("chrom"),
        (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("pos"),
        F.when(kind == 1, F.concat(ref, F.repeat(F.lit("T"), longer))).otherwise(ref).alias("ref"),
        F.when(kind == 0, F.concat(ref, F.repeat(F.lit("G"), longer))).when(kind == 1, ref).otherwise(alt).alias("alt"),
        F.when(F.col("l_returnflag") == "R", "LowQual").otherwise("PASS").alias("filt"),
        F.when(F.col("l_linestatus") == "O", "het").otherwise("homalt").alias("gt"),
        F.col("l_quantity").cast("double").alias("qq"),
    )


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir).where("rid % 3 <> 0")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls(spark, sf_dir).where("rid % 3 <> 1")


def conf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chrom, start, stop (1-based, inclusive), label."""
    p = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(
        F.concat(F.lit("chr"), (p % 22 + 1).cast("string")).alias("chrom"), (p * 10 - 5).alias("start"), (p * 10 + F.col("p_size")).alias("stop"), F.col("p_brand").alias("label")
    )


def _contigs(spark: SparkSession, last: int, chunk: int, base, period: int) -> DataFrame:
    """chrom, at, seq: 22 contigs of `last` bases, base(p, k) at place p of contig k, in chunks.  The bases recur after `period` places,
    so that one period is made base by base, once for a contig, and the rest repeats it.  With it, as fetched() takes them, unit (one
    period, from the contig's first place on) and length (of the contig)."""
    places = F.sequence(F.lit(0).cast("long"), F.lit(period - 1).cast("long"))
    units = spark.range(1, 23).select("id", F.array_join(F.transform(places, lambda p: base(p, F.col("id"))), "").alias("unit")).collect()  # 22 rows
    of = F.array(*[F.lit(r["unit"]) for r in sorted(units)])
    chunks = spark.range(0, last, chunk).select(F.col("id").alias("at"), F.explode(F.sequence(F.lit(1), F.lit(22))).alias("k")).withColumn("unit", F.element_at(of, F.col("k")))
    size: Column = F.least(F.lit(chunk).cast("long"), F.lit(last) - F.col("at"))
    seq = F.substr(F.repeat("unit", F.lit(chunk // period + 2)), (F.col("at") % period + 1).cast("int"), size.cast("int"))
    return chunks.select(F.concat(F.lit("chr"), F.col("k").cast("string")).alias("chrom"), "at", seq.alias("seq"), "unit", F.lit(last).cast("long").alias("length"))


def reference(spark: SparkSession, sf_dir: str, chunk: int = CHUNK) -> DataFrame:
    """chrom, at, seq: made-up contigs as long as the positions go, in chunks."""
    last = read(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0] * 10 + 200  # one row
    return _contigs(spark, last, chunk, lambda p, k: F.substring(F.lit("ACGT"), ((p * 7 + F.floor(p / 5) + k) % 4 + 1).cast("int"), F.lit(1)), 20)


#: The same views for DuckDB.
VIEWS = """
WITH calls AS (
  SELECT l_orderkey AS rid, 'chr' || (l_suppkey % 22 + 1) AS chrom, l_partkey * 10 + l_linenumber AS pos,
    CASE WHEN l_partkey % 10 = 1 THEN r || repeat('T', CAST(l_linenumber * 3 - 2 AS BIGINT)) ELSE r END AS ref,
    CASE WHEN l_partkey % 10 = 0 THEN r || repeat('G', CAST(l_linenumber * 3 - 2 AS BIGINT)) WHEN l_partkey % 10 = 1 THEN r ELSE a END AS alt,
    CASE WHEN l_returnflag = 'R' THEN 'LowQual' ELSE 'PASS' END AS filt,
    CASE WHEN l_linestatus = 'O' THEN 'het' ELSE 'homalt' END AS gt, CAST(l_quantity AS DOUBLE) AS qq
  FROM (SELECT *, substr('ACGT', CAST(CAST(l_quantity AS BIGINT) % 4 + 1 AS BIGINT), 1) AS r,
               substr('ACGT', CAST((CAST(l_quantity AS BIGINT) + 1 + l_linenumber % 3) % 4 + 1 AS BIGINT), 1) AS a FROM lineitem)
), truth AS (SELECT * FROM calls WHERE rid % 3 <> 0), query AS (SELECT * FROM calls WHERE rid % 3 <> 1),
conf AS (SELECT 'chr' || (p_partkey % 22 + 1) AS chrom, p_partkey * 10 - 5 AS start, p_partkey * 10 + p_size AS stop, p_brand AS label FROM part)
"""


def _base(p, k):
    """The base at a 0-based place of contig k: runs of A, runs of AC and mixed stretches of 50 bases each."""
    mixed = F.substring(F.lit("ACGT"), ((p * 7 + F.floor(p / 5) + k) % 4 + 1).cast("int"), F.lit(1))
    stretch = F.floor(p / 50) % 3
    return F.when(stretch == 0, "A").when(stretch == 1, F.when(p % 2 == 0, "A").otherwise("C")).otherwise(mixed)


def genome(spark: SparkSession, sf_dir: str, chunk: int = CHUNK) -> DataFrame:
    """chrom, at, seq: made-up contigs with repeats, as long as the places of sited_calls() go, in chunks."""
    last = (read(spark, sf_dir, "lineitem").agg(F.max("l_orderkey")).first()[0] or 0) * 110 + 1000  # one row
    return _contigs(spark, last, chunk, _base, 300)  # stretches recur after 150 bases, mixed ones after 20, runs of AC after 2


def sited_calls(spark: SparkSession, sf_dir: str, side: int) -> DataFrame:
    """Calls whose REF is what genome() has there, in the form of read_calls(), one sample: truth (side 0) or query (1).

    One in five is an insertion or deletion; within a run of A the two sides put the same one at different places.
    """
    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus")
    li = li.where(F.col("l_orderkey") % 3 != (0 if side == 0 else 1)).withColumn("k", F.col("l_suppkey") % 22 + 1)
    kind, p = F.col("l_partkey") % 10, F.col("l_orderkey") * 110 + F.col("l_linenumber") * 9
    run = F.floor((p - 1) / 50) % 3 == 0
    p = F.when((kind < 2) & run & F.lit(side == 1), F.floor((p - 1) / 50) * 50 + 20).otherwise(p)
    at = lambda n: _base(F.col("pos") - 1 + n, F.col("k"))
    rows = li.withColumn("pos", p).dropDuplicates(["k", "pos", "l_partkey", "l_quantity", "l_returnflag", "l_linestatus"])
    ref = F.when(kind == 1, F.concat(at(0), at(1))).otherwise(at(0))
    other = F.substring(F.lit("ACGT"), ((F.instr(F.lit("ACGT"), at(0)) + F.col("l_linenumber") % 3) % 4 + 1).cast("int"), F.lit(1))
    alt = F.when(kind == 0, F.concat(at(0), at(1))).when(kind == 1, at(0)).otherwise(other)
    gt = F.when(F.col("l_linestatus") == "O", F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1), F.lit(1)))
    formats = F.create_map(F.lit("GT"), F.lit("."))
    return rows.select(
        F.concat(F.lit("chr"), F.col("k").cast("string")).alias("chrom"), "pos", F.lit(".").alias("id"), ref.alias("ref"), F.array(alt).alias("alts"), F.col("l_quantity").cast("float").alias("qual"),
        F.when(F.col("l_returnflag") == "R", F.array(F.lit("LowQual"))).otherwise(F.array().cast("array<string>")).alias("filters"), F.create_map(F.lit("DP"), F.lit("1")).alias("info"),
        F.array(F.struct(F.lit("S").alias("sample"), gt.alias("gt"), F.lit(False).alias("phased"), formats.alias("formats"))).alias("calls"), F.lit(False).alias("failed"),
    )


def as_records(calls_of: DataFrame) -> DataFrame:
    """calls() rows in the form of read_calls(), one sample."""
    gt = F.when(F.col("gt") == "homalt", F.array(F.lit(1), F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1)))
    call = F.struct(F.lit("S").alias("sample"), gt.alias("gt"), F.lit(False).alias("phased"), F.create_map(F.lit("GT"), F.lit(".")).alias("formats"))
    return calls_of.select(
        "chrom", "pos", F.lit(".").alias("id"), "ref", F.array("alt").alias("alts"), F.col("qq").cast("float").alias("qual"), F.when(F.col("filt") == "PASS", F.array().cast("array<string>")).otherwise(F.array("filt")).alias("filters"),
        F.create_map(F.lit("DP"), F.lit("1")).alias("info"), F.array(call).alias("calls"), F.lit(False).alias("failed"),
    )

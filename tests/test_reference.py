"""The made-up contigs base by base, and that bases reach their sites without a broadcast of the reference."""

from pyspark.sql import functions as F

from callmark.operators import normalise
from callmark.sources import adapter, files

SF = "/root/testdata/sf0.001"


def plan(df, kind="executedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_contigs_base_by_base(spark):
    plain = lambda p, k: "ACGT"[(p * 7 + p // 5 + k) % 4]
    mixed = lambda p, k: ("A", "AC"[p % 2], plain(p, k))[p // 50 % 3]
    for make, base in ((adapter.reference, plain), (adapter.genome, mixed)):
        rows = make(spark, SF, chunk=777).where("chrom in ('chr1', 'chr22')").orderBy("chrom", "at").collect()
        for chrom, k in (("chr1", 1), ("chr22", 22)):
            whole = "".join(r["seq"] for r in rows if r["chrom"] == chrom)
            assert len(whole) > 2000 and whole[:5000] == "".join(base(p, k) for p in range(min(5000, len(whole))))
            assert whole[-2000:] == "".join(base(p, k) for p in range(len(whole) - 2000, len(whole)))
            assert all(r["at"] % 777 == 0 and len(r["seq"]) == min(777, len(whole) - r["at"]) for r in rows if r["chrom"] == chrom)


def test_reference_is_never_broadcast(spark):
    sites = adapter.query(spark, SF).select("chrom", F.col("pos").alias("a"), (F.col("pos") + 9).alias("b"))
    for make in (adapter.reference, adapter.genome):
        text = plan(files.fetched(sites, make(spark, SF), "a", "b"))
        assert "SortMergeJoin" in text and "Broadcast" not in text


def test_room_is_measured_once(spark):
    """Neighbouring bases are translated once each, not at every step of the comparison and for every column that uses the result."""
    alleles = adapter.query(spark, SF).select("chrom", "pos", "ref", "alt")
    for shift in (normalise.left_shifted, normalise.right_shifted):
        assert plan(shift(alleles, adapter.reference(spark, SF)), "optimizedPlan").count("translate(") == 2

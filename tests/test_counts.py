"""Blocks scored by counts against listed copies, and how often calls are read and matched."""

import random

from pyspark.sql import functions as F

from callmark.operators import allele_blocks, intervals
from callmark.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_block_counts_against_copies(spark):
    rng = random.Random(14)
    rows = [("c", rng.randrange(1, 3000), *rng.choice([("A", "C"), ("A", "AT"), ("ATT", "A"), ("AC", "GT")]), rng.randrange(2), rng.choice([1, 2])) for _ in range(400)] + [("c", 7, "A", "C", None, 1)]
    frame = spark.createDataFrame(rows, "chrom string, pos long, ref string, alt string, side int, copies int")
    listed = frame.select("chrom", "pos", "ref", "alt", "side", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).drop("col")
    for matcher, options in (("alleles", {}), ("distance", {"distance": 2})):
        sizes = {"gap": 60, "most": 32, "apart": 3}
        want = allele_blocks.block_scores(allele_blocks.compared(listed, None, matcher, **sizes, **options)).collect()
        got = allele_blocks.block_counts(frame, matcher, **sizes, **options).collect()
        assert len(want) > 3 and [tuple(r) for r in got] == [tuple(r) for r in want]


def test_touched_against_all_pairs(spark):
    rng = random.Random(16)
    spans = lambda n, most: [("c", s := rng.randrange(300), s + rng.randrange(most)) for _ in range(n)]
    a, b = spans(60, 40), spans(8, 20)
    frame = lambda rows: spark.createDataFrame(rows, "chrom string, start long, stop long")
    got = {tuple(r) for r in intervals.touched(frame(a), frame(b), ["chrom", "start", "stop"], "hit", width=16).collect()}
    assert got == {(*x, any(x[1] <= y[2] and x[2] >= y[1] for y in b)) for x in a}


def test_calls_are_matched_once(spark):
    """A curve matches the calls once, not for each sample and each reading of the curve."""
    observed = catalogue.observations(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert observed.count("Join FullOuter") == 1
    thinned = catalogue.roc_thinned(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join FullOuter" not in thinned

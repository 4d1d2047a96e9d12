"""Comparison of alleles in blocks, by a matcher that is chosen by its name.

The rows are alleles: chrom, pos, ref, alt, side (0 truth, 1 query), one row for each copy.  Blocks end before gaps of more than
GAP bases, and after about MOST alleles, but not between alleles that stand near each other.  Each matcher takes rows with
their block, and gives them back with `matched` (boolean, null if it could not be told).  Equal rows are counted one by
one.  Nulls in chrom, pos, ref, alt or side are no alleles and are left away.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callmark.operators.assignment import MOST_WAYS, Allele, assigned
from callmark.operators.haplotypes import MARGIN, bare
from callmark.operators.intervals import islands, merged
from callmark.operators.normalise import fully_left_shifted
from callmark.sources.files import fetched
from callmark.sources.scratch import written

GAP, MOST, APART, DISTANCE = 100_000, 1024, 50, 30
ROW = ["chrom", "pos", "ref", "alt", "side"]
#: Positions that are summed first when block sizes are added up along a chrom.
STRETCH = 1 << 20
#: Parts in which equal rows are numbered.
PARTS = 64
#: Blocks, with their bases, that go to Python at once.
BLOCKS_AT_ONCE = 16


def _before(table: DataFrame, keys: list[str], at: str, value: str, out: str) -> DataFrame:
    """table with the sum of `value` over the rows of the same keys with a smaller `at`: first by stretches, then within them."""
    binned = table.withColumn("_stretch", F.floor(F.col(at) / STRETCH))
    earlier = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = binned.groupBy(*keys, "_stretch").agg(F.sum(value).alias("_all")).withColumn("_earlier", F.coalesce(F.sum("_all").over(earlier), F.lit(0))).drop("_all")
    within = Window.partitionBy(*keys, "_stretch").orderBy(at).rangeBetween(Window.unboundedPreceding, -1)
    joined = binned.join(sums, [*keys, "_stretch"])
    return joined.withColumn(out, F.col("_earlier") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop("_earlier", "_stretch")


def in_blocks(alleles: DataFrame, gap: int = GAP, most: int = MOST, apart: int = APART) -> DataFrame:
    """alleles with `block`, the first position of the block.

    What is never parted are runs of alleles at most `apart` bases from each other, or single positions in runs of more
    than `most` alleles.  A block is full with the run that takes the number of alleles since the gap over the next multiple of `most`.
    """
    rows = alleles.dropna(subset=ROW)
    size = rows.groupBy("chrom", "pos").agg(F.count("*").alias("_n"), F.max(F.col("pos") + F.length("ref") - 1).alias("_be"))
    return rows.join(_blocks(size, gap, most, apart).select("chrom", "pos", "block"), ["chrom", "pos"])


def _blocks(size: DataFrame, gap: int, most: int, apart: int) -> DataFrame:
    """size: chrom, pos, _n (alleles there), _be (their greatest end), other columns stay; with `block`."""
    others = [c for c in size.columns if c not in ("chrom", "pos", "_n", "_be")]
    runs = written(islands(size, ["chrom"], "pos", "_be", apart).withColumnRenamed("island_start", "_run"), "runs")
    of_run = runs.groupBy("chrom", "_run").agg(F.sum("_n").alias("_of_run"))
    atom = F.when(F.col("_of_run") > most, F.col("pos")).otherwise(F.col("_run"))
    sites = written(runs.join(of_run, ["chrom", "_run"]).select("chrom", "pos", "_n", "_be", atom.alias("_atom"), *others), "sites")
    atoms = sites.groupBy("chrom", "_atom").agg(F.sum("_n").alias("_n"), F.max("_be").alias("_be"))
    far = islands(atoms, ["chrom"], "_atom", "_be", gap).withColumnRenamed("island_start", "_far")
    counted = written(_before(written(far, "far"), ["chrom", "_far"], "_atom", "_n", "_at").withColumn("_k", F.floor(F.col("_at") / most)), "counted")
    first = counted.groupBy("chrom", "_far", "_k").agg(F.min("_atom").alias("block"))
    table = counted.join(first, ["chrom", "_far", "_k"]).select("chrom", "_atom", "block")
    return sites.join(table, ["chrom", "_atom"]).drop("_atom")


def by_alleles(blocked: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """The n-th copy of an allele in the truth matches the n-th in the query, after both are shifted left (with a reference).

    Only numbers are compared: of a sample's equal copies as many match as the other has, the leftmost spellings first; rows with
    equal alleles are interchangeable.  `blocked` is to be a written table, as compared() hands it on.
    """
    kinds = blocked.select("chrom", "pos", "ref", "alt").distinct()
    own = ["chrom", "pos", "ref", "alt"]
    if reference is None:
        keyed = kinds.select(*own, F.struct("pos", "ref", "alt").alias("_key"))
    else:
        shifted = fully_left_shifted(kinds.select(*own, F.col("pos").alias("_pos0"), F.col("ref").alias("_ref0"), F.col("alt").alias("_alt0")), reference)
        keyed = shifted.select("chrom", F.struct("pos", "ref", "alt").alias("_key"), F.col("_pos0").alias("pos"), F.col("_ref0").alias("ref"), F.col("_alt0").alias("alt"))
    kind = ["chrom", "pos", "ref", "alt", "side"]
    counts = blocked.groupBy(*kind).agg(F.count("*").alias("_n")).join(keyed, own)
    of_key = Window.partitionBy("chrom", "_key")
    total = lambda side: F.coalesce(F.sum(F.when(F.col("side") == side, F.col("_n"))).over(of_key), F.lit(0))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("chrom", "_key", "side").orderBy("pos", "ref", "alt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = counts.select(*kind, "_n", F.greatest(F.lit(0), F.least(F.col("_n"), F.least(total(0), total(1)) - before)).alias("_m"))
    # a kind of which all rows match, or none, needs no numbers; others are numbered by parts, so that no allele is one task
    rows = blocked.withColumn("_row", F.monotonically_increasing_id()).withColumn("_part", F.pmod(F.xxhash64("_row"), F.lit(PARTS)))
    joined = rows.join(taken, kind)
    told = joined.where("_m = 0 or _m = _n").withColumn("matched", F.col("_m") > 0)
    some = joined.where("_m > 0 and _m < _n")
    parts = some.groupBy(*kind, "_part").agg(F.count("*").alias("_c"))
    parts = parts.withColumn("_earlier", F.coalesce(F.sum("_c").over(Window.partitionBy(*kind).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    number = F.row_number().over(Window.partitionBy(*kind, "_part").orderBy("_row"))
    numbered = some.withColumn("_k", number).join(parts, [*kind, "_part"]).withColumn("matched", F.col("_k") + F.col("_earlier") <= F.col("_m"))
    columns = [*blocked.columns, "matched"]
    return told.select(*columns).unionByName(numbered.select(*columns))


def by_distance(blocked: DataFrame, reference: DataFrame | None = None, distance: int = DISTANCE) -> DataFrame:
    """An allele matches if one of the other sample reaches within `distance` bases of it.

    The reaches of each sample are merged first, so that an allele meets few of them in its bins.
    """
    # the bases that an allele touches; an insertion touches those on both sides of it, which an indel record begins before
    lo = F.when(F.length("ref") < F.length("alt"), F.col("pos") + F.length("ref") - 1).otherwise(F.col("pos"))
    spans = blocked.select("*", lo.alias("_lo"), F.greatest(F.col("pos") + F.length("ref") - 1, lo).alias("_hi"))
    kinds = written(spans.select("chrom", "side", "_lo", "_hi").distinct(), "reaches")
    reach = merged(kinds.select("chrom", (1 - F.col("side")).alias("side"), (F.col("_lo") - distance).alias("start"), (F.col("_hi") + distance).alias("stop")), ["chrom", "side"])
    width = 1024
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width)))
    right = reach.select("chrom", "side", "start", "stop", bins("start", "stop").alias("_bin"))
    near = kinds.withColumn("_bin", bins("_lo", "_hi")).join(right, ["chrom", "side", "_bin"]).where("start <= _hi and stop >= _lo")
    near = near.select("chrom", "side", "_lo", "_hi").distinct().withColumn("_near", F.lit(True))
    return spans.join(near, ["chrom", "side", "_lo", "_hi"], "left").withColumn("matched", F.coalesce("_near", F.lit(False))).drop("_near", "_lo", "_hi")


def by_haplotypes(blocked: DataFrame, reference: DataFrame, haps: int = 2, most: int = 4 * MOST, ways: int = MOST_WAYS) -> DataFrame:
    """The most alleles that stand on haplotypes on which both samples agree.

    Columns copies (1) and phase_set (null) of the rows are used if there are any.  Rows of blocks with more than `most` alleles (a position
    with that many) have null; so have those of blocks with phased alleles that don't agree.  `proven`: whether the result is proven to be the best.
    """
    rows = blocked if "copies" in blocked.columns else blocked.withColumn("copies", F.lit(1))
    rows = rows if "phase_set" in rows.columns else rows.withColumn("phase_set", F.lit(None).cast("long"))
    own = [c for c in rows.columns if c not in ("chrom", "block")]
    size = rows.groupBy("chrom", "block").agg(F.count("*").alias("_n"), (F.min("pos") - 1 - MARGIN).alias("_from"), (F.max(F.col("pos") + F.length("ref") - 1) - 1 + MARGIN).alias("_to"))
    size = written(size, "block-sizes")
    large = rows.join(size.where(F.col("_n") > most).select("chrom", "block"), ["chrom", "block"], "left_semi")
    told = size.where(F.col("_n") <= most).select("chrom", "block", F.greatest("_from", F.lit(0)).alias("_from"), "_to")
    order = ["pos", "ref", "alt", "side", *[c for c in own if c not in ROW]]
    lists = rows.join(told.select("chrom", "block"), ["chrom", "block"], "left_semi").groupBy("chrom", "block").agg(F.array_sort(F.collect_list(F.struct(*order))).alias("_rows"))
    with_bases = lists.join(fetched(told, reference, "_from", "_to", "_bases"), ["chrom", "block"])

    @F.pandas_udf("masks array<int>, proven boolean")
    def masks(bases: pd.Series, start: pd.Series, found: pd.Series) -> pd.DataFrame:
        out = []
        for b, at, own in zip(bases, start, found):
            alleles = []
            for c in own:
                pos, ref, alt = bare(c["pos"] - 1, c["ref"], c["alt"])
                phase_set = None if c["phase_set"] is None or pd.isna(c["phase_set"]) else int(c["phase_set"])
                alleles.append(Allele(c["side"], pos, pos + len(ref) - 1, alt, c["copies"], phase_set))
            got, proven = assigned(b, at, alleles, haps, ways)
            out.append((got, proven))
        return pd.DataFrame({"masks": [m for m, _ in out], "proven": [p for _, p in out]})

    # a structure of the columns asked for keeps Python from seeing others
    seen = F.transform("_rows", lambda r: F.struct(*[r[c].alias(c) for c in ("side", "pos", "ref", "alt", "copies", "phase_set")]))
    done = with_bases.select("chrom", "block", "_rows", masks("_bases", "_from", seen).alias("_m"))
    zipped = F.transform("_rows", lambda r, i: F.struct(r.alias("r"), (F.get(F.col("_m.masks"), i) > 0).alias("matched")))
    flat = done.select("chrom", "block", F.explode(zipped).alias("_z"), F.col("_m.proven").alias("proven"))
    flat = written(flat.select("chrom", "block", "_z.r.*", "_z.matched", "proven"), "assigned", BLOCKS_AT_ONCE)
    columns = [*rows.columns, "matched", "proven"]
    return flat.select(*columns).unionByName(large.withColumns({"matched": F.lit(None).cast("boolean"), "proven": F.lit(False)}).select(*columns))


#: Matchers by name; another one is a function of (rows with blocks, reference).
MATCHERS = {"alleles": by_alleles, "distance": by_distance, "haplotypes": by_haplotypes}


def compared(alleles: DataFrame, reference: DataFrame | None, matcher: str = "alleles", gap: int = GAP, most: int = MOST, apart: int = APART, **options) -> DataFrame:
    """The rows of alleles with block, matched, and decision (TP; FN in the truth, FP in the query; UNK if it could not be told)."""
    rows = MATCHERS[matcher](written(in_blocks(alleles, gap, most, apart), "blocked-alleles"), reference, **options)
    missed: Column = F.when(F.col("side") == 0, "FN").otherwise("FP")
    return rows.withColumn("decision", F.when(F.col("matched").isNull(), "UNK").when(F.col("matched"), "TP").otherwise(missed))


def block_scores(rows: DataFrame) -> DataFrame:
    """compared() rows by block, in the order of output: chrom, block, alleles, matched (alleles of both samples)."""
    return rows.groupBy("chrom", "block").agg(F.count("*").alias("alleles"), F.count(F.when(F.col("matched"), 1)).alias("matched")).orderBy("chrom", "block")


def block_counts(alleles: DataFrame, matcher: str = "alleles", gap: int = GAP, most: int = MOST, apart: int = APART, **options) -> DataFrame:
    """block_scores(compared(alleles, None, matcher)) for rows with `copies`, a number of equal alleles: copies are counted, never
    listed, and what is put into blocks is a row for each position.  Only for matchers that need no reference."""
    n = F.sum("copies")
    if matcher == "alleles":  # of equal alleles as many match on either side as the other has
        of = lambda side: F.coalesce(F.sum(F.when(F.col("side") == side, F.col("copies"))), F.lit(0))
        kinds = alleles.dropna(subset=ROW).groupBy("chrom", "pos", "ref", "alt").agg(n.alias("copies"), (2 * F.least(of(0), of(1))).alias("_m"))
    elif matcher == "distance":
        rows = written(alleles.dropna(subset=ROW).groupBy("chrom", "pos", F.length("ref").alias("_r"), (F.length("ref") < F.length("alt")).alias("_ins"), "side").agg(n.alias("copies")), "kinds")
        spelled = rows.select("chrom", "pos", F.repeat(F.lit("N"), F.col("_r")).alias("ref"), F.repeat(F.lit("N"), F.when(F.col("_ins"), F.col("_r") + 1).otherwise(0)).alias("alt"), "side", "copies")
        kinds = by_distance(spelled, **options).select("chrom", "pos", "ref", "copies", F.when(F.col("matched"), F.col("copies")).otherwise(0).alias("_m"))
    else:
        raise ValueError(f"{matcher} does not go by counts")
    size = kinds.groupBy("chrom", "pos").agg(F.sum("copies").alias("_n"), F.max(F.col("pos") + F.length("ref") - 1).alias("_be"), F.sum("_m").alias("_m"))
    return _blocks(size, gap, most, apart).groupBy("chrom", "block").agg(F.sum("_n").alias("alleles"), F.sum("_m").alias("matched")).orderBy("chrom", "block")


def copies_of(calls: DataFrame, side: int, sample: int = 0) -> DataFrame:
    """A row for each copy of an allele that a sample of read_calls() rows has."""
    gt = F.get(F.col("calls"), F.lit(sample))["gt"]
    alleles = F.filter(F.transform(gt, lambda g: F.get(F.col("alts"), g - 1)), lambda a: a.isNotNull())
    return calls.select("chrom", "pos", "ref", F.explode(F.when(F.size("alts") > 0, alleles)).alias("alt"), F.lit(side).alias("side"))

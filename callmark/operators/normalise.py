"""Normalisation of alleles.  Steps are functions from DataFrame to DataFrame, put together with df.transform.

An allele is (chrom, pos, ref, alt) with a 1-based pos; alt may be empty (a deletion), ref too (an insertion
before pos).  All steps are expressions; alignment stands in operators.alignment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callmark.operators.intervals import islands
from callmark.sources.files import fetched
from callmark.sources.scratch import written

#: Bases to the left of an allele that shifting may look at.
FLANK = 256


#: Powers of two by which a common prefix or suffix is measured, the greatest first.
STEPS = [1 << i for i in range(26, -1, -1)]


def _common(a: Column, b: Column, limit: Column, end, most: int = STEPS[0]) -> Column:
    """Length of the common prefix (end: F.left) or suffix (F.right) of two strings, at most `limit` (which is at most `most`): by halves,
    so that a string is compared as often as `most` has bits, and not at all where the first letters differ.

    a, b and limit are evaluated at each step, so they should be columns where they are not cheap.
    """
    one = F.lit(1)
    longer = lambda n, step: (n + step <= limit) & (end(a, n + step) == end(b, n + step))
    halves = F.aggregate(F.array(*[F.lit(x) for x in STEPS if x <= most]), F.lit(0), lambda n, step: F.when(longer(n, step), n + step).otherwise(n))
    return F.when((limit >= 1) & (end(a, one) == end(b, one)), halves).otherwise(0)


def _cut(alleles: DataFrame, padding: int, left: bool) -> DataFrame:
    """The shared prefix (or suffix) removed, but for `padding` bases."""
    spare = F.least(F.length("ref"), F.length("alt")) - padding
    cut = alleles.withColumn("_n", _common(F.col("ref"), F.col("alt"), spare, F.left if left else F.right))
    keep = (lambda c: F.substr(c, F.col("_n") + 1, F.length(c))) if left else (lambda c: F.left(c, F.length(c) - F.col("_n")))
    cut = cut.withColumns({"ref": keep("ref"), "alt": keep("alt")})
    return (cut.withColumn("pos", F.col("pos") + F.col("_n")) if left else cut).drop("_n")


def trimmed(alleles: DataFrame, padding: int = 0, prefix_first: bool = False) -> DataFrame:
    """Shared suffix, then shared prefix removed (or the other way round); `padding` shared bases at least stay at the left."""
    return _cut(_cut(alleles, padding, prefix_first), padding, not prefix_first)


def _rolled(alleles: DataFrame, k: Column, towards_left: bool) -> DataFrame:
    """Pure insertions and deletions moved by k bases, along which they may roll: their bases turn by k places."""
    seq, m = F.concat("ref", "alt"), F.length("ref") + F.length("alt")
    turn = F.when(m > 0, F.col("_k") % m).otherwise(0)
    turned = F.concat(F.right(seq, turn), F.left(seq, m - turn)) if towards_left else F.concat(F.right(seq, m - turn), F.left(seq, turn))
    out = alleles.withColumn("_k", k).withColumn("_y", F.when(F.col("_k") > 0, turned).otherwise(seq))
    is_ins, is_del = (F.length("ref") == 0) & (F.length("alt") > 0), (F.length("alt") == 0) & (F.length("ref") > 0)
    out = out.withColumn("_ref", F.when(is_del, F.col("_y")).otherwise(F.col("ref"))).withColumn("alt", F.when(is_ins, F.col("_y")).otherwise(F.col("alt")))
    return out.withColumn("ref", F.col("_ref")).withColumn("pos", F.col("pos") + F.col("_k") * (-1 if towards_left else 1)).drop("_y", "_k", "_ref")


def _with_room(alleles: DataFrame, flank: int, towards_left: bool) -> DataFrame:
    """alleles with _room, the bases (at most `flank`) by which pure insertions and deletions roll along the neighbouring reference bases
    (_bases, dropped here), never over N; 0 for others."""
    pure = (F.length("ref") == 0) != (F.length("alt") == 0)
    # rolling over i bases asks that the i nearest bases are those that lie a length of the allele further on; N equals nothing
    seq, same = F.concat("ref", "alt"), F.translate("_bases", "N", "%")
    own = alleles.withColumns({"_near": F.translate("_bases", "N", "#"), "_on": F.concat(same, seq) if towards_left else F.concat(seq, same)})
    room = _common(F.col("_near"), F.col("_on"), F.length("_near"), F.right if towards_left else F.left, flank)
    return own.withColumn("_room", F.when(pure, room).otherwise(0)).drop("_bases", "_near", "_on")


def _near(alleles: DataFrame, reference: DataFrame, flank: int, towards_left: bool) -> DataFrame:
    """alleles with _bases, at most `flank` reference bases beside each."""
    if towards_left:
        sites = alleles.withColumn("_from", F.greatest(F.col("pos") - 1 - flank, F.lit(1))).withColumn("_to", F.col("pos") - 2)  # a base before it stays
    else:
        sites = alleles.withColumn("_from", F.col("pos") - 1 + F.length("ref")).withColumn("_to", F.col("_from") + flank - 1)
    near = fetched(sites, reference, "_from", "_to", "_bases")
    return near.withColumn("_bases", F.when(F.col("_to") < F.col("_from"), "").otherwise(F.col("_bases"))).drop("_from", "_to")


def left_shifted(alleles: DataFrame, reference: DataFrame, flank: int = FLANK, not_before: str | None = None) -> DataFrame:
    """Trimmed alleles moved as far left as the reference allows, by at most `flank` bases and not before that column's position."""
    near = _with_room(_near(trimmed(alleles), reference, flank, True), flank, True)
    room = F.col("_room")
    if not_before is not None:
        room = F.least(room, F.greatest((F.col("pos") - F.col(not_before)).cast("int"), F.lit(0)))
    return _rolled(near, room, True).drop("_room")


def right_shifted(alleles: DataFrame, reference: DataFrame, flank: int = FLANK) -> DataFrame:
    """Trimmed alleles moved as far right as the reference allows, by at most `flank` bases."""
    near = _with_room(_near(trimmed(alleles), reference, flank, False), flank, False)
    return _rolled(near, F.col("_room"), False).drop("_room")


def _fully(alleles: DataFrame, reference: DataFrame, flank: int, shift) -> DataFrame:
    """Those that used up their flank go on with one four times as long; what each round has is written, once.  Only insertions and
    deletions roll, so that no bases are fetched for others."""
    columns = alleles.columns
    whole = written(trimmed(alleles), "trimmed")
    pure = (F.length("ref") == 0) != (F.length("alt") == 0)
    done, going = whole.where(~pure), whole.where(pure)
    while True:
        moved = written(shift(going.withColumn("_start", F.col("pos")), reference, flank).select(*columns, "_start"), "shifted")
        far = F.abs(F.col("_start") - F.col("pos")) >= flank
        ended = moved.where(~far).select(*columns)
        done = done.unionByName(ended)
        going = moved.where(far).select(*columns)
        if going.isEmpty():
            return done
        flank *= 4


def fully_left_shifted(alleles: DataFrame, reference: DataFrame, flank: int = FLANK) -> DataFrame:
    """Trimmed alleles moved as far left as the reference allows, however far that is."""
    return _fully(alleles, reference, flank, left_shifted)


def fully_right_shifted(alleles: DataFrame, reference: DataFrame, flank: int = FLANK) -> DataFrame:
    """Trimmed alleles moved as far right as the reference allows, however far that is."""
    return _fully(alleles, reference, flank, right_shifted)


def shifted_lists(alleles: DataFrame, reference: DataFrame, keys: list[str], flank: int = FLANK, towards_left: bool = True) -> DataFrame:
    """Trimmed alleles, all of them, moved left (or right) as far as the reference and the neighbour before allow.

    keys: the columns that make a list, the contig among them (chrom and, say, a sample).  In a list ordered by
    where alleles stood, a deletion may come to lie next to the bases of the one before, an insertion leaves one
    base between; nothing passes another.  Where an allele may roll at all, it may also stop half way, so that the
    free shifts of all alleles are found first, and only alleles whose reaches touch are folded in order: a fold
    holds the alleles of one repeat, not a contig.
    """
    shift = fully_left_shifted if towards_left else fully_right_shifted
    columns = alleles.columns
    kept = trimmed(alleles).withColumn("_id", F.monotonically_increasing_id()).withColumn("_own", F.struct("pos", "ref", "alt"))
    free = shift(kept, reference, flank).withColumn("_room", F.abs(F.col("pos") - F.col("_own.pos")))
    reach = free.select(*keys, "_id", "_room", "_own", F.col("_own.pos").alias("_p"), (F.col("_own.pos") + F.length("_own.ref") - 1).alias("_e"))
    low, high = (F.col("_p") - F.col("_room") - 2, F.greatest("_p", "_e") + 1) if towards_left else (F.col("_p") - 2, F.greatest("_p", "_e") + F.col("_room") + 1)
    runs = islands(reach.withColumn("_low", low).withColumn("_high", high), keys, "_low", "_high", 0)
    # seen from the right, positions run backwards: the first base is the negative of the last
    first = F.col("_p") if towards_left else -F.col("_e")
    last = F.col("_e") if towards_left else -F.col("_p")
    entry = F.struct(first.alias("first"), last.alias("last"), F.col("_id").alias("id"), F.col("_room").cast("long").alias("room"), (F.length("_own.ref") == 0).alias("ins"))
    lists = runs.groupBy(*keys, "island_start").agg(F.array_sort(F.collect_list(entry)).alias("_list")).where(F.exists("_list", lambda x: x["room"] > 0))
    none = F.lit(-(1 << 60)).cast("long")
    start = F.struct(none.alias("end"), F.array().cast("array<struct<id:bigint,k:bigint>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        # an insertion ends before it begins: its last base is the one before it
        bound = a["end"] + F.when(x["ins"], 2).otherwise(1)
        k = F.least(x["room"], F.greatest(x["first"] - bound, F.lit(0).cast("long")))
        return F.struct(F.greatest(a["end"], x["last"] - k).alias("end"), F.concat(a["out"], F.array(F.struct(x["id"].alias("id"), k.alias("k")))).alias("out"))

    moves = lists.select(F.inline(F.aggregate("_list", start, step, lambda a: a["out"]))).where("k > 0").select(F.col("id").alias("_id"), F.col("k").alias("_move"))
    at = free.join(moves, "_id", "left").na.fill(0, ["_move"]).withColumns({c: F.col(f"_own.{c}") for c in ("pos", "ref", "alt")})
    return _rolled(at, F.col("_move").cast("int"), towards_left).select(*columns)


def left_padded(alleles: DataFrame, reference: DataFrame) -> DataFrame:
    """Alleles with an empty side get the reference base before them."""
    sites = alleles.withColumn("_before", F.col("pos") - 2)
    near = fetched(sites, reference, "_before", "_before", "_b").drop("_before")
    bare = (F.length("ref") == 0) | (F.length("alt") == 0)
    pad = lambda c: F.when(bare, F.concat("_b", c)).otherwise(F.col(c))
    moved = near.withColumn("_bare", bare).withColumn("_ref", pad("ref")).withColumn("alt", pad("alt")).withColumn("ref", F.col("_ref"))
    return moved.withColumn("pos", F.when(F.col("_bare"), F.col("pos") - 1).otherwise(F.col("pos"))).drop("_b", "_bare", "_ref")


def primitives(alleles: DataFrame, prefix_first: bool = False) -> DataFrame:
    """Each allele as its single-base changes from the left and the insertion or deletion that remains."""
    cut = trimmed(alleles, prefix_first=prefix_first)
    shared = F.least(F.length("ref"), F.length("alt"))
    steps = F.when(shared > 0, F.sequence(F.lit(1), shared)).otherwise(F.array().cast("array<int>"))
    snps = F.filter(
        F.transform(steps, lambda i: F.struct((F.col("pos") + i - 1).alias("pos"), F.substr("ref", i, F.lit(1)).alias("ref"), F.substr("alt", i, F.lit(1)).alias("alt"))),
        lambda s: s["ref"] != s["alt"],
    )
    rest = F.struct((F.col("pos") + shared).alias("pos"), F.substr("ref", shared + 1, F.length("ref")).alias("ref"), F.substr("alt", shared + 1, F.length("alt")).alias("alt"))
    parts = F.when(F.length("ref") == F.length("alt"), snps).otherwise(F.concat(snps, F.array(rest)))
    others = [c for c in alleles.columns if c not in ("pos", "ref", "alt")]
    return cut.select(*others, F.explode(parts).alias("_p")).select(*others, "_p.*")


def used_alleles(records: DataFrame) -> DataFrame:
    """Alleles that no genotype names are dropped, the others renumbered."""
    named = F.array_distinct(F.flatten(F.transform("calls", lambda c: c["gt"])))
    keep = F.filter(F.sequence(F.lit(1), F.size("alts")), lambda i: F.array_contains(F.col("_named"), i))
    out = records.withColumn("_named", named).withColumn("_keep", F.when(F.size("alts") > 0, keep).otherwise(F.array().cast("array<int>")))
    out = out.withColumn("calls", F.transform("calls", lambda c: c.withField("gt", F.transform(c["gt"], lambda g: F.when(g > 0, F.array_position("_keep", g).cast("int")).otherwise(g)))))
    return out.withColumn("alts", F.transform("_keep", lambda i: F.get(F.col("alts"), i - 1))).drop("_named", "_keep")


def unique_alleles(records: DataFrame) -> DataFrame:
    """Equal alleles become one, genotypes renumbered."""
    once = records.withColumn("_u", F.array_distinct("alts"))
    renumber = lambda g: F.when(g > 0, F.array_position("_u", F.get(F.col("alts"), g - 1)).cast("int")).otherwise(g)
    out = once.withColumn("calls", F.transform("calls", lambda c: c.withField("gt", F.transform(c["gt"], renumber))))
    return out.withColumn("alts", F.col("_u")).drop("_u")


def split_alleles(records: DataFrame) -> DataFrame:
    """One row per allele that is called, with gt 1 for it and 0 for any other; reference records stay, with a null alt."""
    rows = records.select("*", F.posexplode_outer("alts").alias("_i", "alt"))
    number = F.col("_i") + 1
    calls = F.transform("calls", lambda c: c.withField("gt", F.transform(c["gt"], lambda g: F.when(F.col("_i").isNull() | (g < 0), g).otherwise((g == number).cast("int")))))
    called = F.exists("calls", lambda c: F.exists(c["gt"], lambda g: g > 0))
    return rows.withColumn("calls", calls).where(F.col("alt").isNull() | called).drop("_i", "alts")


def per_base(records: DataFrame) -> DataFrame:
    """Reference blocks (END in info) as one row per base."""
    stop = F.coalesce(F.col("info")["END"].cast("long"), F.col("pos") + F.length("ref") - 1)
    return records.withColumn("pos", F.explode(F.sequence(F.col("pos"), F.greatest(stop, F.col("pos")))))


def joined_at_position(alleles: DataFrame, sample: str = "gt") -> DataFrame:
    """Two heterozygous calls of one class at one position as one record with two alleles (1/2); others stay alone."""
    snp = (F.length("ref") == 1) & (F.length("alt") == 1)
    keyed = alleles.withColumn("class", F.when(snp, "SNP").otherwise("INDEL"))
    parts = F.array_sort(F.collect_list(F.struct("ref", "alt", F.col(sample).alias("gt"))))
    groups = keyed.groupBy("chrom", "pos", "class").agg(parts.alias("parts"))
    two = (F.size("parts") == 2) & F.forall("parts", lambda p: p["gt"] == "het")
    one = lambda p: F.struct(p["ref"].alias("ref"), F.array(p["alt"]).alias("alts"), p["gt"].alias("gt"))
    a, b = F.get("parts", F.lit(0)), F.get("parts", F.lit(1))
    ref = F.when(F.length(a["ref"]) >= F.length(b["ref"]), a["ref"]).otherwise(b["ref"])
    padded = lambda p: F.concat(p["alt"], F.substr(ref, F.length(p["ref"]) + 1, F.length(ref)))
    both = F.array(F.struct(ref.alias("ref"), F.array(padded(a), padded(b)).alias("alts"), F.lit("hetalt").alias("gt")))
    return groups.select("chrom", "pos", "class", F.explode(F.when(two, both).otherwise(F.transform("parts", one))).alias("_r")).select("chrom", "pos", "class", "_r.*")

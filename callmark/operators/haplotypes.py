"""Haplotype comparison within superloci.

A block's calls of one sample stand for every pair of haplotypes that their genotypes allow (het calls on either
side, hetalt calls both ways round, phased calls only as they are phased); two samples match in a block if they have
a pair in common, whichever way round.  The pairs are not listed: both samples' haplotypes are written side by side
along the block, and what is remembered of them is only how far each has come and which bases one of them is ahead
of the other.  Ways to distribute the calls that lead to the same remainder are one way, those whose haplotypes differ
end at once, so that thirty heterozygous calls are compared exactly.  Blocks that are too long, or have more open ways
at once than MOST_PAIRS, stay unknown, and only blocks in which a plain comparison failed, both samples have calls and
one of them is no SNP are looked at at all.
"""

from __future__ import annotations

from itertools import product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callmark.operators.blocks import superloci
from callmark.sources.files import fetched
from callmark.sources.scratch import discard, written

#: Bases of a block, and pairs of haplotypes of a sample, above which it stays unknown.
MOST_BASES, MOST_PAIRS, MARGIN = 4096, 16768, 30
#: Blocks that go to Python at once: each may have thousands of calls, which take many times their size there.
BLOCKS_AT_ONCE = 64


def sequence(bases: str, at: int, edits: list[tuple[int, str, str]]) -> str | None:
    """bases (from position `at`) with edits (pos, ref, alt) applied; None if edits overlap."""
    out, here = [], at
    for pos, ref, alt in sorted(edits):
        if pos < here:
            return None
        out.append(bases[here - at : pos - at])
        out.append(alt)
        here = pos + len(ref)
    return "".join([*out, bases[here - at :]])


def pairs(bases: str, at: int, calls: list[tuple[int, str, str, str]], most: int = MOST_PAIRS) -> set[tuple[str, str]] | None:
    """The unordered pairs of haplotypes of calls (pos, ref, alt, gt het or homalt); None if there are too many ways."""
    both = [c[:3] for c in calls if c[3] == "homalt"]
    one = [c[:3] for c in calls if c[3] == "het"]
    if 2 ** max(0, len(one) - 1) > most:
        return None
    found = set()
    for rest in product((0, 1), repeat=max(0, len(one) - 1)):
        side = (0, *rest) if one else ()
        made = [sequence(bases, at, [*both, *(e for e, s in zip(one, side) if s == k)]) for k in (0, 1)]
        if None not in made:
            found.add(tuple(sorted(made)))
    return found


def bare(pos: int, ref: str, alt: str) -> tuple[int, str, str]:
    """The allele without shared bases at the beginning, then at the end: what is left stands where the record puts it, an insertion before its position."""
    n = 0
    while n < min(len(ref), len(alt)) and ref[n] == alt[n]:
        n += 1
    pos, ref, alt = pos + n, ref[n:], alt[n:]
    while ref and alt and ref[-1] == alt[-1]:
        ref, alt = ref[:-1], alt[:-1]
    return pos, ref, alt


def ways(call: tuple) -> list[tuple[tuple, tuple]]:
    """call: (pos, ref, alts, gt, phased).  The edits of the first and of the second haplotype, for each way round."""
    pos, ref, alts, gt, phased = call
    sides = [tuple(bare(pos, ref, alts[g - 1]) for g in (n,) if g > 0) for n in (gt if len(gt) > 1 else gt * 2)][:2]
    first, second = sides
    return [(first, second)] if phased or first == second else [(first, second), (second, first)]


def _advanced(lane: tuple, side: int, upto: int, more: str, bases: str, at: int) -> tuple | None:
    """A lane (how far the first and the second sample have come, who is ahead, by which bases, edits to come, edits that
    another may undo) after one sample's haplotype has gone on to `upto` and then written `more`; None if the two differ."""
    here, ahead, lead = lane[side], lane[2], lane[3]
    new = bases[here - at : max(upto, here) - at] + more
    cursors = (max(upto, here), lane[1]) if side == 0 else (lane[0], max(upto, here))
    if not lead or ahead == side:
        return (*cursors, side if lead + new else 0, lead + new, *lane[4:])
    n = min(len(lead), len(new))
    if lead[:n] != new[:n]:
        return None
    rest = lead[n:] or new[n:]
    return (*cursors, (ahead if lead[n:] else side) if rest else 0, rest, *lane[4:])


def _level(lane: tuple | None, key: tuple[int, bool], bases: str, at: int) -> tuple | None:
    """A lane in which all edits before `key` (position, whether bases go) are written and both samples have come to its position;
    None if edits overlap or the haplotypes differ."""
    while lane and lane[4] and lane[4][0][:2] < key:
        (pos, _, side, ref, alt), *rest = lane[4]
        if pos < lane[side]:
            return None
        lane = _advanced((*lane[:4], tuple(rest), lane[5]), side, pos, alt, bases, at)
        if lane:
            lane = (pos + len(ref), *lane[1:]) if side == 0 else (lane[0], pos + len(ref), *lane[2:])
    for side in (0, 1):
        lane = lane and _advanced(lane, side, key[0], "", bases, at)
    return lane


def undoing(bases: str, at: int, calls: list[tuple]) -> set[frozenset]:
    """Pairs of edits of heterozygous calls that together leave the reference as it is: no haplotype has both of them."""
    edits = sorted({e for c in calls if 0 in c[3] for e in (bare(c[0], c[1], c[2][max(c[3]) - 1]),) if len(e[1]) != len(e[2])})
    pairs_of = ((a, b) for i, a in enumerate(edits) for b in edits[i + 1 :] if len(a[1]) + len(b[1]) == len(a[2]) + len(b[2]))
    return {frozenset((a, b)) for a, b in pairs_of if sequence(bases, at, [a, b]) == bases}


def agree(bases: str, at: int, truth: list[tuple], query: list[tuple], most: int = MOST_PAIRS) -> bool | None:
    """Whether calls (pos, ref, alts, gt, phased) of two samples allow a common pair of haplotypes; None beyond `most` open ways."""
    calls = []
    for side, own in enumerate((truth, query)):
        for c in own:
            edits = [bare(c[0], c[1], c[2][g - 1]) for g in c[3] if g > 0]
            calls.append((min((pos, len(ref) > 0) for pos, ref, _ in edits), side, c))
    calls.sort(key=lambda x: x[:2])
    undone = [undoing(bases, at, own) for own in (truth, query)]
    risky = [{e for pair in own for e in pair} for own in undone]
    phased = [any(c[4] for c in own) for own in (truth, query)]

    def taken(lane: tuple, side: int, edits: tuple) -> tuple | None:
        own = tuple((side, e) for e in edits if e in risky[side])
        if any(frozenset((e, o)) in undone[side] for _, e in own for s, o in lane[5] if s == side):
            return None
        return (*lane[:4], tuple(sorted([*lane[4], *((pos, len(ref) > 0, side, ref, alt) for pos, ref, alt in edits)])), tuple(sorted(lane[5] + own)))

    for flip in (False, True) if all(phased) else (False,):  # the phases of the two samples may be told the other way round
        states = {((at, at, 0, "", (), ()),) * 2}
        for key, side, call in calls:
            options = [(b, a) if flip and side else (a, b) for a, b in ways(call)]
            after = set()
            for lanes in states:
                level = [_level(lane, key, bases, at) for lane in lanes]
                if None in level:
                    continue
                for option in options:
                    new = [taken(lane, side, edits) for lane, edits in zip(level, option)]
                    if None not in new:
                        after.add(tuple(new if any(phased) else sorted(new)))
            states = after
            if len(states) > most:
                return None
        end = (at + len(bases), True)
        if any(all(e is not None and not e[3] for e in (_level(lane, end, bases, at) for lane in lanes)) for lanes in states):
            return True
    return False


def same_alleles(bases: str, at: int, truth: list[tuple], query: list[tuple]) -> bool:
    """Whether one sample is heterozygous and the other homozygous for the same haplotype."""
    kinds = [{"homalt" if len(set(c[3])) == 1 else "het" if 0 in c[3] else "hetalt" for c in calls} for calls in (truth, query)]
    if sorted(kinds, key=sorted) != [{"het"}, {"homalt"}]:
        return False
    made = []
    for calls in (truth, query):
        if any(c[4] for c in calls) and len({next(i for i, g in enumerate(c[3]) if g > 0) for c in calls if c[4] and 0 in c[3]}) > 1:
            return False
        made.append(sequence(bases, at, [bare(c[0], c[1], c[2][max(c[3]) - 1]) for c in calls]))
    return made[0] is not None and made[0] == made[1]


def outcome(bases: str, at: int, truth: list, query: list, length: int | None = None) -> str:
    """match, gt_mismatch (the same haplotype, het in one sample and homalt in the other), mismatch or unknown; length: of the block itself."""
    if (len(bases) if length is None else length) > MOST_BASES:
        return "unknown"
    found = agree(bases, at, truth, query)
    if found is None:
        return "unknown"
    return "match" if found else "gt_mismatch" if same_alleles(bases, at, truth, query) else "mismatch"


def asked_blocks(blocked: DataFrame) -> DataFrame:
    """blocked: chrom, bs, side (0 truth, 1 query), pos, ref, alts, gt, mismatch.  chrom, bs, be, n_truth, n_query of the
    blocks with a mismatch, calls of both samples and an allele that is no single base."""
    snp = (F.length("ref") == 1) & F.forall("alts", lambda a: F.length(a) == 1)
    table = blocked.groupBy("chrom", "bs").agg(
        F.max(F.col("pos") + F.length("ref") - 1).alias("be"),
        F.count(F.when(F.col("side") == 0, 1)).alias("n_truth"),
        F.count(F.when(F.col("side") == 1, 1)).alias("n_query"),
        F.max("mismatch").alias("_m"),
        F.max(~snp).alias("_indel"),
    )
    return table.where("n_truth > 0 and n_query > 0 and _indel and _m").drop("_indel", "_m")


def block_outcomes(blocked: DataFrame, reference: DataFrame) -> DataFrame:
    """blocked: as asked_blocks() has it, with gt as allele numbers and phased.  chrom, bs, be, n_truth, n_query, outcome."""
    asked = written(asked_blocks(blocked), "asked")  # read for the long ones, for the bases and for the calls
    size = F.col("be") - F.col("bs") + 1
    long = asked.where(size > MOST_BASES).withColumn("outcome", F.lit("unknown"))
    short = asked.where(size <= MOST_BASES)
    sites = short.withColumn("_from", F.greatest(F.col("bs") - 1 - MARGIN, F.lit(0))).withColumn("_to", F.col("be") - 1 + MARGIN)
    with_bases = fetched(sites, reference, "_from", "_to", "bases")
    found = F.collect_list(F.struct("side", "pos", "ref", "alts", "gt", "phased")).alias("calls")  # those of MOST_BASES positions
    rows = blocked.join(short.select("chrom", "bs"), ["chrom", "bs"], "left_semi").groupBy("chrom", "bs").agg(found).join(with_bases, ["chrom", "bs"])

    @F.pandas_udf("string")
    def compare(bases: pd.Series, start: pd.Series, calls: pd.Series, size: pd.Series) -> pd.Series:
        of = lambda own, side: [(c["pos"], c["ref"], list(c["alts"]), tuple(c["gt"]), bool(c["phased"])) for c in own if c["side"] == side]
        return pd.Series([outcome(b, s + 1, of(own, 0), of(own, 1), n) for b, s, own, n in zip(bases, start, calls, size)], dtype=object)

    done = rows.select("chrom", "bs", "be", "n_truth", "n_query", compare("bases", "_from", "calls", size).alias("outcome"))
    done = written(done, "outcomes", BLOCKS_AT_ONCE)
    return done.unionByName(long.select(*done.columns))


def compared(truth: DataFrame, query: DataFrame, reference: DataFrame, window: int = 50) -> DataFrame:
    """chrom, bs, be, n_truth, n_query, outcome (match, mismatch, unknown) of the blocks that need a comparison; calls: chrom, pos, ref, alt, gt (het or homalt)."""
    keep = ["chrom", "pos", "ref", "alt", "gt"]
    both = truth.select(*keep, F.lit(1).alias("_side")).unionByName(query.select(*keep, F.lit(2).alias("_side")))
    # a call of both samples is one row until the blocks are known
    single = both.groupBy(*keep).agg(F.bit_or("_side").alias("_sides"))
    blocked = superloci(single, window)
    numbers = F.when(F.col("gt") == "homalt", F.array(F.lit(1), F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1)))
    sides = F.when(F.col("_sides") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.col("_sides") - 1))
    table = written(blocked.select("chrom", "bs", F.explode(sides).alias("side"), "pos", "ref", F.array("alt").alias("alts"), numbers.alias("gt"), F.lit(False).alias("phased"), (F.col("_sides") < 3).alias("mismatch")), "blocked")
    discard(blocked, "islands")
    return block_outcomes(table, reference).withColumn("outcome", F.regexp_replace("outcome", "^gt_", ""))


def haplotype_rescued(rows: DataFrame, outcomes: DataFrame) -> DataFrame:
    """rows: chrom, bs, bd_truth, bd_query.  In blocks that match, calls that do not fail a filter become TP."""
    joined = rows.join(outcomes.where("outcome = 'match'").select("chrom", "bs", F.lit(True).alias("hap_match")), ["chrom", "bs"], "left")
    better = lambda c: F.when(F.col("hap_match") & F.col(c).isNotNull(), "TP").otherwise(F.col(c))
    return joined.withColumn("bd_truth", better("bd_truth")).withColumn("bd_query", better("bd_query")).withColumn("hap_match", F.coalesce("hap_match", F.lit(False)))

"""Assignment of alleles to haplotypes and comparison in blocks, against literals and brute force."""

import random
from itertools import product

import pytest

from callmark.operators import allele_blocks, assignment
from callmark.operators.assignment import Allele, agreeing, assigned, placements, rotated, ways_to_assign

#: A contig of published tests.
REPEATS = "AAACCCAAACCCAAACCCGGGTTTGGGTTTGGGTTT"


def test_insertions_of_one_repeat_match():
    alleles = [Allele(0, 6, 5, "AAACCC"), Allele(1, 0, -1, "AAACCC")]
    masks, proven = assigned(REPEATS, 0, alleles)
    assert proven and masks[0] == masks[1] > 0 and agreeing(REPEATS, 0, alleles, masks)
    assert ways_to_assign(alleles) == 9 and ways_to_assign(alleles, 1) == 4
    assert placements(1) == [1, 2] and placements(2) == [3] and placements(2, 3) == [3, 5, 6]
    assert [rotated(0b001, r, 3) for r in range(3)] == [1, 2, 4]


def brute(bases, alleles, haps=2):
    """The most alleles of any assignment that agrees, None if there is none."""
    sets = sorted({(a.side, a.phase_set) for a in alleles if a.phase_set is not None})
    best = None
    for turns in product(range(haps), repeat=len(sets)):
        turn = dict(zip(sets, turns))
        options = [[*placements(a.copies, haps), 0] if a.phase_set is None else [rotated(a.copies, turn[a.side, a.phase_set], haps)] for a in alleles]
        for masks in product(*options):
            n = sum(1 for a, m in zip(alleles, masks) if m or a.phase_set is not None)
            if (best is None or n > best) and agreeing(bases, 0, alleles, list(masks), haps):
                best = n
    return best


def some_alleles(rng, bases, n, phased=False):
    out = []
    for _ in range(n):
        start = rng.randrange(2, len(bases) - 8)
        kind = rng.randrange(3)
        phase = {"copies": rng.choice([1, 2, 3]), "phase_set": rng.randrange(2)} if phased and rng.random() < 0.5 else {"copies": rng.choice([1, 1, 2])}
        if kind == 0:
            out.append(Allele(rng.randrange(2), start, start, rng.choice("ACGT".replace(bases[start], "")), **phase))
        elif kind == 1:
            out.append(Allele(rng.randrange(2), start, start - 1, rng.choice(["A", "C", "AC", "CA"]), **phase))
        else:
            out.append(Allele(rng.randrange(2), start, start + rng.randrange(2), "", **phase))
    return out


@pytest.mark.parametrize("phased", [False, True])
def test_against_brute_force(phased):
    rng = random.Random(7)
    told = {0: 0, 1: 0}
    for i in range(250):
        bases = "".join(rng.choice(["A", "AC", "ACAC", "AAAA", "G"]) for _ in range(7)) + "TTTTTTTTTT"
        some = some_alleles(rng, bases, rng.randint(1, 4), phased)
        alleles = some + [a._replace(side=1 - a.side) for a in some if rng.random() < 0.5]  # up to eight
        if len(alleles) > 7:
            alleles = alleles[:7]
        masks, proven = assigned(bases, 0, alleles)
        want = brute(bases, alleles)
        assert proven
        if want is None:
            assert masks is None
            told[0] += 1
        else:
            assert agreeing(bases, 0, alleles, masks)
            assert sum(1 for a, m in zip(alleles, masks) if m or a.phase_set is not None) == want
            told[1] += want > 0
    assert told[1] > 80 and (told[0] > 20 if phased else told[0] == 0)


def test_ten_calls_and_three_haplotypes():
    rng = random.Random(3)
    for _ in range(4):
        bases = "".join(rng.choice(["AC", "AAAA", "G"]) for _ in range(6)) + "TTTTTTTTTT"
        alleles = some_alleles(rng, bases, 10)
        masks, _ = assigned(bases, 0, alleles)
        assert sum(1 for m in masks if m) == brute(bases, alleles)
    bases = "ACACACGGTTTTTTTTTT"
    alleles = [a._replace(copies=min(a.copies, 3)) for a in some_alleles(rng, bases, 5)]
    masks, _ = assigned(bases, 0, alleles, haps=3)
    assert sum(1 for m in masks if m) == brute(bases, alleles, 3)


def test_many_calls_of_one_repeat_stay_exact():
    """Sixty alleles, of which all but one have a partner at another place of its repeat."""
    unit = "A" * 12 + "CGT" * 3
    bases = unit * 30 + "G" * 10
    alleles = [Allele(0, 21 * i + 1, 21 * i, "A") for i in range(30)] + [Allele(1, 21 * i + 9, 21 * i + 8, "A") for i in range(29)] + [Allele(1, 5, 5, "T")]
    masks, proven = assigned(bases, 0, alleles)
    assert proven and [i for i, m in enumerate(masks) if not m] == [29, 59] and agreeing(bases, 0, alleles, masks)


def test_too_many_ways_are_told():
    bases = "A" * 60 + "C"
    alleles = [Allele(i % 2, i + 1, i, "A" * (1 + i % 5)) for i in range(24)]
    masks, proven = assigned(bases, 0, alleles, most=8)
    assert not proven and agreeing(bases, 0, alleles, masks)


def plain_blocks(sites, gap, most, apart):
    """sites: sorted (pos, end, n) of one contig.  The block of each position, by a scan."""
    runs, reach = [], None
    for pos, end, n in sites:
        if reach is None or reach + apart < pos:
            runs.append([])
        runs[-1].append((pos, end, n))
        reach = end if reach is None else max(reach, end)
    atoms = []
    for r in runs:
        atoms += [[s] for s in r] if sum(n for *_, n in r) > most else [r]
    out, reach, seen, block, k = {}, None, 0, None, None
    for a in atoms:
        if reach is None or reach + gap < a[0][0]:
            seen, k = 0, None
        if k != seen // most:
            k, block = seen // most, a[0][0]
        seen += sum(n for *_, n in a)
        out |= {pos: block for pos, *_ in a}
        reach = max([e for _, e, _ in a] + ([] if reach is None else [reach]))
    return out


def test_blocks_against_a_scan(spark):
    rng = random.Random(5)
    rows = [("c", rng.choice([rng.randrange(1, 3000), rng.randrange(9000, 9100)]), "A" * rng.choice([1, 1, 30]), "C", rng.randrange(2), "x") for _ in range(400)]
    rows += [("d", 7, "A", "C", 0, "x")] * 40 + [(None, 1, "A", "C", 0, "x"), ("d", 9, None, "C", 0, "x")]
    frame = spark.createDataFrame(rows, "chrom string, pos long, ref string, alt string, side int, _n string")
    got = {(r["chrom"], r["pos"]): r["block"] for r in allele_blocks.in_blocks(frame.drop("_n"), gap=300, most=16, apart=5).collect()}
    sites = {}
    for c, pos, ref, *_ in rows:
        if c == "c":
            end, n = sites.get(pos, (0, 0))
            sites[pos] = (max(end, pos + len(ref) - 1), n + 1)
    want = plain_blocks([(p, *s) for p, s in sorted(sites.items())], 300, 16, 5)
    assert {p: b for (c, p), b in got.items() if c == "c"} == want and got["d", 7] == 7 and len(set(want.values())) > 10


def test_three_matchers_in_one_driver(spark):
    contig = REPEATS + "ACGT" * 100
    reference = spark.createDataFrame([("q", 0, contig)], "chrom string, at long, seq string")
    rows = [
        ("q", 6, "C", "CAAACCC", 0, 1),  # one insertion at two places of its repeat
        ("q", 12, "C", "CAAACCC", 1, 2),
        ("q", 200, "T", "C", 0, 3),  # a SNP of one sample, 20 bases from one of the other
        ("q", 220, "T", "G", 1, 4),
        ("q", 300, "T", "A", 0, 5),  # two copies against one
        ("q", 300, "T", "A", 0, 6),
        ("q", 300, "T", "A", 1, 7),
        ("q", 340, "TACG", "AACC", 0, 8),  # one record against two
        ("q", 340, "T", "A", 1, 9),
        ("q", 343, "G", "C", 1, 10),
    ]
    frame = spark.createDataFrame(rows, "chrom string, pos long, ref string, alt string, side int, id int").repartition(3)
    got = {m: {r["id"]: r["decision"] for r in allele_blocks.compared(frame, reference, m).collect()} for m in allele_blocks.MATCHERS}
    assert {i for i, d in got["alleles"].items() if d == "TP"} in ({1, 2, 5, 7}, {1, 2, 6, 7})
    assert {i for i, d in got["distance"].items() if d == "TP"} == {1, 2, 3, 4, 5, 6, 7, 8, 9, 10}
    assert {i for i, d in got["haplotypes"].items() if d == "TP"} in ({1, 2, 5, 7, 8, 9, 10}, {1, 2, 6, 7, 8, 9, 10})
    assert got["haplotypes"][3] == "FN" and got["haplotypes"][4] == "FP"
    scores = allele_blocks.block_scores(allele_blocks.compared(frame, reference, "haplotypes", gap=50, apart=10)).collect()
    assert [(r["block"], r["alleles"], r["matched"]) for r in scores] == [(6, 2, 2), (200, 2, 0), (300, 6, 5)]


def test_positions_with_very_many_copies_are_unknown(spark):
    reference = spark.createDataFrame([("q", 0, "ACGT" * 100)], "chrom string, at long, seq string")
    rows = [("q", 101, "A", "C", i % 2) for i in range(50)] + [("q", 301, "A", "C", 0), ("q", 301, "A", "C", 1)]
    frame = spark.createDataFrame(rows, "chrom string, pos long, ref string, alt string, side int")
    out = allele_blocks.by_haplotypes(allele_blocks.in_blocks(frame, most=20), reference, most=20)
    told = {(r["pos"], r["matched"]) for r in out.collect()}
    assert told == {(101, None), (301, True)}


def test_empty(spark):
    frame = spark.createDataFrame([], "chrom string, pos long, ref string, alt string, side int")
    reference = spark.createDataFrame([("q", 0, "ACGT")], "chrom string, at long, seq string")
    for m in allele_blocks.MATCHERS:
        assert allele_blocks.compared(frame, reference, m).collect() == []


def test_frequent_alleles_are_counted_copy_by_copy(spark):
    """300 copies against 170, and two spellings of one allele of which the left one matches first."""
    contig = "AAACCCAAACCCAAACCC" + "GGGTTT" * 30
    reference = spark.createDataFrame([("q", 0, contig)], "chrom string, at long, seq string")
    rows = [("q", 100, "T", "C", 0)] * 300 + [("q", 100, "T", "C", 1)] * 170 + [("q", 6, "C", "CAAACCC", 0)] * 2 + [("q", 12, "C", "CAAACCC", 0)] * 2 + [("q", 6, "C", "CAAACCC", 1)] * 3
    frame = spark.createDataFrame(rows, "chrom string, pos long, ref string, alt string, side int").repartition(4)
    got = {}
    for r in allele_blocks.compared(frame, reference, "alleles").collect():
        key = (r["pos"], r["side"], r["decision"])
        got[key] = got.get(key, 0) + 1
    assert got == {(100, 0, "TP"): 170, (100, 0, "FN"): 130, (100, 1, "TP"): 170, (6, 0, "TP"): 2, (12, 0, "TP"): 1, (12, 0, "FN"): 1, (6, 1, "TP"): 3}


def test_places_where_both_samples_are_level_stand_alone(monkeypatch):
    """Single bases are paired place by place, and a search goes no further than its own surroundings."""
    bases = "".join("ACGT"[(i * 7 + i // 5) % 4] for i in range(3000))
    changed = lambda i, n=1: "ACGT"[("ACGT".index(bases[i]) + n) % 4]
    alleles = [Allele(side, i, i, changed(i)) for i in range(10, 2900, 10) for side in (0, 1)]
    alleles += [Allele(0, i, i, changed(i, 2)) for i in range(15, 2900, 50)]  # only the truth has these
    indels = [Allele(side, i, i - 1, "GATTACA") for i in range(13, 2900, 500) for side in (0, 1)]
    asked, search = [], assignment._pass
    monkeypatch.setattr(assignment, "_pass", lambda bases, at, alleles, order, first, *rest: asked.append((first, got := search(bases, at, alleles, order, first, *rest))) or got)
    masks, proven = assigned(bases, 0, alleles)
    assert proven and not asked and [m > 0 for m in masks] == [i < 578 for i in range(len(alleles))] and agreeing(bases, 0, alleles, masks)
    masks, proven = assigned(bases, 0, alleles + indels)
    assert proven and all(masks[-len(indels):]) and agreeing(bases, 0, alleles + indels, masks)
    assert len(asked) >= 6 and max(got[0] - first for first, got in asked) < 20

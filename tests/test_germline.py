"""The germline path against published results for small inputs: annotated records, summary and extended table."""

import itertools
import random

from pyspark.sql import functions as F

from callmark.functions import calls as C
from callmark.operators import germline, haplotypes, normalise, tables
from callmark.sources import files

SCHEMA = (
    "chrom string, pos long, id string, ref string, alts array<string>, qual float, filters array<string>, info map<string,string>, "
    "calls array<struct<sample:string,gt:array<int>,phased:boolean,formats:map<string,string>>>, failed boolean"
)


def records(spark, chrom, rows, qual=None):
    """rows: pos, ref, alts, genotype and, if any, the sample's filters."""
    out = []
    for pos, ref, alts, gt, *ft in rows:
        numbers = [int(x) for x in gt.replace("|", "/").split("/")]
        out.append((chrom, pos, ".", ref, alts.split(","), qual, [], {}, [("S", numbers, "|" in gt, {"GT": gt, **({"FT": ft[0]} if ft else {})})], False))
    return spark.createDataFrame(out, SCHEMA)


def genome(spark, chrom, seq):
    return spark.createDataFrame([(chrom, 0, seq)], "chrom string, at long, seq string")


def lines(spark, annotated, path):
    """The records as a file has them: position, alleles, INFO and the two samples."""
    files.write_calls(germline.as_calls(annotated), path, germline.HEADER, ["TRUTH", "QUERY"])
    text = [r["value"] for r in spark.read.text(path).collect()]
    assert text[0] == "##fileformat=VCFv4.1" and text[len(germline.HEADER)].startswith("#CHROM")
    cells = [t.split("\t") for t in text if not t.startswith("#")]
    assert all(c[8] == "GT:BD:BK:BI:BVT:BLT:QQ" for c in cells)
    return [(int(c[1]), c[3], c[4], c[7], c[9], c[10]) for c in cells]


def table(df, keys, columns):
    return {tuple(r[k] for k in keys): tuple(round(r[c], 6) if isinstance(r[c], float) else r[c] for c in columns) for r in df.collect()}


COUNTS = ["TRUTH.TOTAL", "TRUTH.TP", "TRUTH.FN", "QUERY.TOTAL", "QUERY.FP", "QUERY.UNK", "FP.gt", "METRIC.Recall", "METRIC.Precision", "METRIC.Frac_NA"]


def test_confident_regions(spark, tmp_path):
    """Single bases inside and outside, insertions whose places are covered in part, a record of two insertions that haplotypes match."""
    truth = records(spark, "c", [(5, "A", "T", "0/1"), (100, "A", "ATT", "0|1"), (105, "AAAAAA", "AAAAAATC", "0/1"), (110, "A", "ATT", "0/1")])
    query = records(spark, "c", [(2, "A", "T", "0/1"), (4, "A", "T", "0/1"), (5, "A", "T", "0/1"), (6, "A", "T", "0/1"), (7, "A", "T", "0/1"), (100, "A", "ATT", "0/1"), (110, "A", "ATT,ATC", "2/1"), (520, "A", "ATT,T", "2/1")])
    spans = [(1, 4), (5, 5), (6, 6), (100, 100), (110, 111), (520, 520)]
    regions = spark.createDataFrame([("c", a, b, "CONF") for a, b in spans], "chrom string, start long, stop long, label string")
    got = germline.compared(truth, query, genome(spark, "c", "C" + "A" * 650), regions).cache()
    snp, none = "0/1:{}:{}:tv:SNP:het:0".format, "./.:.:.:.:NOCALL:nocall:."
    edge, held = "BS=2;Regions=CONF,TS_boundary", "BS=100;Regions=CONF,TS_contained"
    het = "0/1:TP:gm:i1_5:INDEL:het:0"
    want = [
        (2, "A", "T", edge, none, snp("FP", ".")),
        (4, "A", "T", edge, none, snp("FP", ".")),
        (5, "A", "T", edge, snp("TP", "gm"), snp("TP", "gm")),
        (6, "A", "T", edge, none, snp("FP", ".")),
        (7, "A", "T", "BS=2;Regions=TS_boundary", none, snp("UNK", ".")),
        (100, "A", "ATT", held, "0|1" + het[3:], het),
        (105, "AAAAAA", "AAAAAATC", held, het, none[:-1] + "0"),
        (110, "A", "ATC,ATT", held, none, "2/1:TP:gm:i1_5:INDEL:hetalt:0"),
        (110, "A", "ATT", held, het, none[:-1] + "0"),
        (520, "A", "ATT", "BS=520;Regions=TS_boundary", none, "0/1:UNK:.:i1_5:INDEL:het:0"),
        (520, "A", "T", "BS=520;Regions=CONF,TS_boundary", none, snp("FP", ".")),
    ]
    assert sorted(lines(spark, got, str(tmp_path / "a"))) == sorted(want)
    again = germline.requantified(files.read_calls(spark, str(tmp_path / "a")))
    for rows in (got, again):
        indel, single = (3, 3, 0, 3, 0, 1, 0, 1.0, 1.0, 0.333333), (1, 1, 0, 6, 4, 1, 0, 1.0, 0.2, 0.166667)
        assert table(tables.summary(rows), ["Type", "Filter"], COUNTS) == {(t, f): x for t, x in (("INDEL", indel), ("SNP", single)) for f in ("ALL", "PASS")}


def test_shift_of_lists(spark):
    """Deletions come to lie next to each other, insertions leave a base between; nothing passes its neighbour."""
    seq = "CTCTCTCTGTCATAGG"
    two = spark.createDataFrame([("c", 3, "CTC", "C", "t"), ("c", 5, "CTC", "C", "t"), ("c", 3, "CTCTC", "C", "q")], "chrom string, pos long, ref string, alt string, side string")
    moved = normalise.left_padded(normalise.shifted_lists(two, genome(spark, "c", seq), ["chrom", "side"]), genome(spark, "c", seq))
    assert sorted((r["side"], r["pos"], r["ref"], r["alt"]) for r in moved.collect()) == [("q", 1, "CTCTC", "C"), ("t", 1, "CTC", "C"), ("t", 3, "CTC", "C")]
    seq = "GGC" + "TG" * 10 + "CC"
    three = spark.createDataFrame([("c", 12, "", "TG"), ("c", 16, "TG", ""), ("c", 18, "", "TG"), ("c", 22, "T", "A")], "chrom string, pos long, ref string, alt string")
    moved = [(r["pos"], r["ref"], r["alt"]) for r in normalise.shifted_lists(three, genome(spark, "c", seq), ["chrom"]).orderBy("pos").collect()]
    assert moved == [(4, "", "TG"), (4, "TG", ""), (7, "", "GT"), (22, "T", "A")]


def test_shift_of_lists_against_a_fold(spark):
    rng = random.Random(8)
    seq = "".join(rng.choice(["A", "AC", "ACG", "T"]) * rng.randint(1, 9) for _ in range(60))
    rows, at = [], 5
    while at < len(seq) - 8:
        n = rng.randint(1, 3)
        rows.append((at, seq[at - 1 : at - 1 + n], "") if rng.random() < 0.5 else (at, "", "".join(rng.choice("ACGT") for _ in range(n))))
        at += n + rng.randint(0, 5)
    rows = sorted(set(rows))
    for left in (True, False):
        want, end = [], None
        for pos, ref, alt in sorted(rows, key=lambda r: (r[0] if left else -(r[0] + len(r[1]) - 1), (r[0] + len(r[1]) - 1) if left else -r[0])):
            x, own = ref or alt, pos
            while True:
                first, last = (own, own + len(ref) - 1) if left else (-(own + len(ref) - 1), -own)
                if end is not None and first - 1 < end + (1 if ref else 2):
                    break
                if left and own > 2 and seq[own - 2] == x[-1]:
                    x, own = x[-1] + x[:-1], own - 1
                elif not left and own - 1 + len(ref) < len(seq) and seq[own - 1 + len(ref)] == x[0]:
                    x, own = x[1:] + x[0], own + 1
                else:
                    break
            first, last = (own, own + len(ref) - 1) if left else (-(own + len(ref) - 1), -own)
            end = last if end is None else max(end, last)
            want.append((own, x if ref else "", "" if ref else x))
        df = spark.createDataFrame([("c", *r) for r in rows], "chrom string, pos long, ref string, alt string").repartition(3)
        got = normalise.shifted_lists(df, genome(spark, "c", seq), ["chrom"], flank=4, towards_left=left)
        assert sorted((r["pos"], r["ref"], r["alt"]) for r in got.collect()) == sorted(want)


def test_far_shifts_have_no_limit(spark):
    ref = genome(spark, "c", "G" + "A" * 2000 + "C")
    one = spark.createDataFrame([("c", 3, "A", "")], "chrom string, pos long, ref string, alt string")
    assert normalise.fully_right_shifted(one, ref, flank=8).first()["pos"] == 2001
    one = spark.createDataFrame([("c", 2001, "A", "")], "chrom string, pos long, ref string, alt string")
    assert normalise.fully_left_shifted(one, ref, flank=8).first()["pos"] == 2


def test_shifted_and_decomposed(spark, tmp_path):
    """A record of a deletion and an insertion is taken apart, deletions of two and of four bases match by haplotypes; the whole extended table."""
    seq = "CTCTCTCTGTCATAGGGACT" + "N" * 100 + "AATATATATATATCTCTCTCTAAATATATATATGG"
    a = 121
    truth = [(3, "CTC", "C", "0/1"), (5, "CTC", "C", "0/1"), (a + 5, "ATA", "A", "0/1"), (a + 7, "ATA", "A", "0/1"), (a + 22, "AAT", "A,AATAT", "2/1")]
    query = [(3, "CTCTC", "C", "0/1"), (a + 5, "ATATA", "A", "0/1"), (a + 25, "ATA", "A", "0/1"), (a + 29, "A", "ATA", "0/1")]
    got = germline.compared(records(spark, "c", truth, 100.0), records(spark, "c", query, 100.0), genome(spark, "c", seq), prepare_truth=True, shift=True).cache()
    het, none = "0/1:TP:gm:{}:INDEL:het:100".format, "./.:.:.:.:NOCALL:nocall:{}".format
    want = [
        (1, "CTC", "C", "BS=1", het("d1_5"), none(0)), (1, "CTCTC", "C", "BS=1", none("."), het("d1_5")), (3, "CTC", "C", "BS=1", het("d1_5"), none(0)),
        (a, "AAT", "A", f"BS={a}", het("d1_5"), none(0)), (a, "AATAT", "A", f"BS={a}", none("."), het("d1_5")), (a + 2, "TAT", "T", f"BS={a}", het("d1_5"), none(0)),
        (a + 22, "AAT", "A", f"BS={a}", het("d1_5"), het("d1_5")), (a + 24, "T", "TAT", f"BS={a}", het("i1_5"), none(0)), (a + 25, "A", "ATA", f"BS={a}", none("."), het("i1_5")),
    ]
    assert sorted(lines(spark, got, str(tmp_path / "a"))) == sorted(want)
    whole = tables.extended(got, total=len(seq))
    assert len(whole.columns) == 65
    rows = table(whole, ["Type", "Subtype", "Filter", "Genotype"], ["TRUTH.TOTAL", "TRUTH.TP.het", "QUERY.TOTAL", "QUERY.TP", "QUERY.TP.ti", "METRIC.Recall", "METRIC.Frac_NA", "Subset.Size"])
    assert len(rows) == (10 + 3) * 2 * 4
    assert rows["INDEL", "*", "ALL", "*"] == rows["INDEL", "*", "PASS", "het"] == (6, 6, 4, 4, None, 1.0, 0.0, len(seq))
    assert rows["INDEL", "I1_5", "ALL", "*"][:4] == (1, 1, 1, 1) and rows["SNP", "TV", "ALL", "*"] == (0, 0, 0, 0, 0, 0.0, 0.0, len(seq))


def test_filters_haploid_calls_and_reference_haplotypes(spark, tmp_path):
    truth = records(spark, "c", [(1, "A", "G", "0/1"), (2, "A", "T", "0/1"), (3, "A", "T", "0/1")])
    query = records(spark, "c", [(1, "A", "G", "0/1"), (2, "A", "T", "0/1", "A"), (3, "A", "T", "0/1", "A;B")])
    got = table(tables.summary(germline.compared(truth, query, genome(spark, "c", "AAACCCAAACCC"))), ["Type", "Filter"], [*COUNTS, "QUERY.TOTAL.TiTv_ratio"])
    assert got == {("SNP", "ALL"): (3, 3, 0, 3, 0, 0, 0, 1.0, 1.0, 0.0, 0.5), ("SNP", "PASS"): (3, 1, 2, 1, 0, 0, 0, 0.333333, 1.0, 0.0, None)}
    haploid = germline.compared(records(spark, "chrX", [(5, "A", "T", "1")]), records(spark, "chrX", [(5, "A", "T", "1/1")]), genome(spark, "chrX", "CAAAAAAAAAA"))
    assert lines(spark, haploid, str(tmp_path / "x")) == [(5, "A", "T", "BS=5", "1/1:TP:gm:tv:SNP:homalt:0", "1/1:TP:gm:tv:SNP:homalt:0")]
    # an insertion and a deletion that undo each other are no haplotype
    truth = records(spark, "c", [(2, "A", "T", "0/1"), (3, "A", "AA", "0/1"), (5, "AA", "A", "0/1")])
    got = table(tables.summary(germline.compared(truth, records(spark, "c", [(2, "A", "T", "0/1")]), genome(spark, "c", "CAAAAAAA"))), ["Type", "Filter"], COUNTS[:5])
    assert got["INDEL", "ALL"] == (2, 0, 2, 0, 0) and got["SNP", "ALL"] == (1, 1, 0, 1, 0)


def test_records_that_cannot_be_imported_and_genotype_mismatches(spark):
    bad = records(spark, "c", [(3, "A", "<X>", "0/1"), (9, "A", "C", "0/1"), (12, "A", "C", "1/1")]).selectExpr("chrom", "pos", "id", "ref", "alts", "qual", "filters", "info", "calls", "pos = 3 AS failed")
    rows = {r["pos"]: r for r in germline.compared(bad, records(spark, "c", [(9, "A", "C", "1/1"), (12, "A", "C", "0/1"), (14, "A", "C", "0/1")]), genome(spark, "c", "G" + "A" * 30)).collect()}
    assert rows[3]["truth"]["bd"] == "N" and rows[3]["truth"]["blt"] == "fail"
    assert (rows[9]["truth"]["bd"], rows[9]["query"]["bd"], rows[9]["query"]["bk"]) == ("FN", "FP", "am")
    assert rows[14]["query"]["bd"] == "FP" and rows[14]["query"]["bk"] == "."
    empty = germline.compared(bad.limit(0), bad.limit(0), genome(spark, "c", "GAAA"))
    assert empty.collect() == [] and tables.summary(empty).collect() == []


def every_pair(seq, calls):
    out = set()
    for pick in itertools.product(*[haplotypes.ways(c) for c in calls]):
        made = []
        for h in (0, 1):
            edits = sorted((e for option in pick for e in option[h]), key=lambda e: (e[0], len(e[1]) > 0))
            if any(frozenset(p) in haplotypes.undoing(seq, 1, calls) for p in itertools.combinations(edits, 2)):
                break
            text, here = "", 1
            for pos, ref, alt in edits:
                if pos < here:
                    break
                text, here = text + seq[here - 1 : pos - 1] + alt, pos + len(ref)
            else:
                made.append(text + seq[here - 1 :])
        if len(made) == 2:
            out |= {tuple(made), tuple(made[::-1])}
    return out


def test_haplotypes_against_all_pairs():
    """Het, homalt and hetalt calls, phased and not."""
    rng, agreed = random.Random(4), 0
    for _ in range(1500):
        seq = "".join(rng.choice("AC") for _ in range(14))

        def calls(seq=seq):
            out = []
            for _ in range(rng.randint(1, 3)):
                p = rng.randint(2, 11)
                ref = seq[p - 1 : p + rng.choice([0, 0, 1, 2])]
                alt = rng.choice([ref + "A", ref[0], ref[:1] + "AC", "C" if ref[0] == "A" else "A"])
                alts, gt = [alt if alt != ref else ref + "G"], rng.choice([(0, 1), (1, 1), (1, 0)])
                if rng.random() < 0.25:
                    alts, gt = [*alts, ref + "GG"], rng.choice([(1, 2), (2, 1)])
                out.append((p, ref, alts, gt, rng.random() < 0.3))
            return out

        truth = calls()
        query = [(*c[:4], False) for c in truth] if rng.random() < 0.3 else calls()
        want = bool(every_pair(seq, truth) & every_pair(seq, query))
        agreed += want
        assert haplotypes.agree(seq, 1, truth, query) == want, (seq, truth, query)
    assert agreed > 200


def test_thirty_heterozygous_calls_are_compared():
    rng = random.Random(2)
    seq = "".join(rng.choice("ACGT") for _ in range(400))
    truth = [(p, seq[p - 1], [next(x for x in "ACGT" if x != seq[p - 1])], (0, 1), False) for p in range(10, 370, 12)]
    assert len(truth) == 30 and haplotypes.outcome(seq, 1, truth, [(*c[:3], (1, 0), False) for c in truth]) == "match"
    assert haplotypes.outcome(seq, 1, truth, truth[:-1]) == "mismatch" and haplotypes.outcome(seq, 1, truth, truth, length=5000) == "unknown"
    assert haplotypes.outcome(seq, 1, truth[:2], [(*c[:3], (1, 1), False) for c in truth[:2]]) == "gt_mismatch"
    phased = [(*c[:3], c[3], True) for c in truth[:2]]
    assert haplotypes.outcome(seq, 1, phased, [phased[0], (*phased[1][:3], (1, 0), True)]) == "mismatch"
    assert haplotypes.outcome(seq, 1, phased, [(*c[:3], (1, 0), True) for c in phased]) == "match"
    assert haplotypes.agree(seq, 1, truth, truth, most=0) is None


def test_repeated_info_keys(spark):
    rows = spark.createDataFrame([("DP=1;X;DP=2", "GT:A:A", "0/1:3")], "i string, k string, v string")
    r = rows.select(C.info_map(F.col("i")).alias("i"), C.format_map(F.col("k"), F.col("v")).alias("f")).first()
    assert r["i"] == {"DP": "1", "X": "true"} and r["f"] == {"GT": "0/1", "A": "3"}


def test_complex_alleles_are_aligned_when_they_are_taken_apart(spark):
    """A published alignment: five bases inserted, three deleted, none changed."""
    ref, alt = "CCCCAAATGACGGGGCATTGCCACACA", "CCCCAAATGACCACCAGGATTGCCACACA"
    got = germline.prepared(records(spark, "c", [(3, ref, alt, "0/1")]), genome(spark, "c", "GT" + ref + "GT"), decompose=True).collect()
    assert sorted((len(r["ref"]), len(r["alts"][0])) for r in got) == [(1, 6), (4, 1)] and all(r["gt"] == [0, 1] for r in got)


def test_calls_of_the_query_are_shifted(spark):
    """Insertions and deletions of A that the adapter puts on the 20th place of a run are found at its beginning."""
    from callmark.plans.catalogue import QUERIES

    rows = QUERIES["germline_annotated"](spark, "/root/testdata/sf0.001").where("truth like '.%' and length(ref) <> length(alts) and alts not like '%,%'")
    places = {r["at"]: r["count"] for r in rows.groupBy((F.col("pos") % 150).alias("at")).count().collect()}
    assert places.get(20, 0) < 10 and places[0] > 100  # neighbours hold a few; unshifted, 281 stood there

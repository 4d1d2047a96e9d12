"""Literal cases for readers, writers, normalisation and haplotypes."""

import random

import pytest
from pyspark.sql import functions as F

from callmark.functions import calls as C
from callmark.operators import alignment, haplotypes, normalise
from callmark.sources import files

VCF = """##fileformat=VCFv4.1
##source=caller 1.2.3
##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth, total">
##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB
chr1\t5\t.\ta\tT,G\t30\tPASS\tDP=7;SOMATIC\tGT:DP:FT\t0/1:3:PASS\t1|2:4:q10
chr1\t9\trs1\tAC\tA\t.\tLowQual\t.\tGT\t1/1\t./.
chr2\t3\t.\tA\t*-\t1\t.\tDP=1\tGT\t0/3\t0/0
"""


@pytest.fixture
def vcf(tmp_path):
    (tmp_path / "a.vcf").write_text(VCF)
    return str(tmp_path / "a.vcf")


def test_calls(spark, vcf, tmp_path):
    rows = {(r["chrom"], r["pos"]): r for r in files.read_calls(spark, vcf).collect()}
    a = rows["chr1", 5]
    assert (a["ref"], a["alts"], a["qual"], a["filters"], a["info"]) == ("A", ["T", "G"], 30.0, ["PASS"], {"DP": "7", "SOMATIC": "true"})
    assert [(c["sample"], c["gt"], c["phased"], c["formats"]["DP"]) for c in a["calls"]] == [("A", [0, 1], False, "3"), ("B", [1, 2], True, "4")]
    assert rows["chr1", 9]["calls"][1]["gt"] == [-1, -1] and not a["failed"] and rows["chr2", 3]["failed"]
    strict = {r["pos"]: r for r in files.read_calls(spark, vcf, apply_filters=True).collect()}
    assert [c["gt"] for c in strict[5]["calls"]] == [[0, 1], []] and [c["gt"] for c in strict[9]["calls"]] == [[], []]
    files.write_calls(files.read_calls(spark, vcf), str(tmp_path / "out"), ["##fileformat=VCFv4.1"], ["A", "B"])
    again = files.read_calls(spark, str(tmp_path / "out" / "*"))
    assert again.count() == 3 and again.where("pos = 5").first()["alts"] == ["T", "G"]


def test_header(spark, vcf):
    assert {r["id"] for r in files.header(spark, vcf).where("id is not null").collect()} == {"DP", "GT"}
    assert '"Description":"Depth, total"' in files.header_json(spark, vcf).where("kind = 'INFO'").first()["json"]
    assert tuple(files.provenance(spark, vcf).first())[:2] == ("caller", "1.2.3")


def test_merge(spark, vcf):
    first = files.read_calls(spark, vcf)
    other = spark.createDataFrame([("chr1", 5, "A", ["G", "C"], [("C", [1, 2], False, {"GT": "1/2"})])], "chrom string, pos long, ref string, alts array<string>, calls array<struct<sample:string,gt:array<int>,phased:boolean,formats:map<string,string>>>")
    row = files.merged_calls([first, other]).where("pos = 5").first()
    assert row["alts"] == ["T", "G", "C"] and [c["gt"] for c in row["calls"]] == [[0, 1], [1, 2], [2, 3]]


def test_intervals_and_reference(spark, tmp_path):
    (tmp_path / "r.bed").write_text("#x\n1\t0\t5\tone\n1\t7\tx\n2\t9\t3\nX\t4\t6\n")
    assert sorted(map(tuple, files.read_intervals(spark, str(tmp_path / "r.bed"), fix_chr=True).collect())) == [("chr1", 1, 5, "one"), ("chrX", 5, 6, "")]
    (tmp_path / "s.tsv").write_text("a\tr.bed\nb\tr.bed\n")
    assert files.read_stratification(spark, str(tmp_path / "s.tsv")).groupBy("label").count().count() == 2
    (tmp_path / "s.fa").write_text(">c1 text\nNNacgt\nACGTNN\n>c2\nNN\n")
    ref = files.read_reference(spark, str(tmp_path / "s.fa"), chunk=4)
    assert {tuple(r) for r in files.contig_lengths(ref).collect()} == {("c1", 12, 8), ("c2", 2, 0)}
    sites = spark.createDataFrame([("c1", 2, 9), ("c1", 10, 40), ("c2", 5, 6)], "chrom string, a long, b long")
    assert {r["a"]: r["bases"] for r in files.fetched(sites, ref, "a", "b", chunk=4).collect()} == {2: "ACGTACGT", 10: "NN", 5: ""}


def reference(spark, seq, chunk=files.CHUNK):
    return spark.createDataFrame([("c", at, seq[at : at + chunk]) for at in range(0, len(seq), chunk)], "chrom string, at long, seq string")


def alleles(spark, rows):
    return spark.createDataFrame([("c", *r) for r in rows], "chrom string, pos long, ref string, alt string")


def plain(df):
    return sorted((r["pos"], r["ref"], r["alt"]) for r in df.collect())


def test_trim(spark):
    assert plain(normalise.trimmed(alleles(spark, [(5, "ACGT", "ACT")]))) == [(7, "G", "")]
    assert plain(normalise.trimmed(alleles(spark, [(5, "CAAA", "CA")]), padding=1)) == [(5, "CAA", "C")]
    assert plain(normalise.trimmed(alleles(spark, [(5, "A", "T"), (9, "A", "A")]))) == [(5, "A", "T"), (9, "", "")]


def test_shift(spark):
    seq = "GGCAAAAATTCACACAG"
    ref = reference(spark, seq)
    assert plain(normalise.left_shifted(alleles(spark, [(8, "A", "")]), ref)) == [(4, "A", "")]
    assert plain(normalise.left_shifted(alleles(spark, [(17, "", "CA")]), ref)) == [(11, "", "CA")]
    assert plain(normalise.left_shifted(alleles(spark, [(17, "", "CA")]), ref, flank=2)) == [(15, "", "CA")]
    assert plain(normalise.right_shifted(alleles(spark, [(4, "A", "")]), ref)) == [(8, "A", "")]
    assert plain(normalise.left_padded(alleles(spark, [(4, "A", ""), (5, "A", "C")]), ref)) == [(3, "CA", "C"), (5, "A", "C")]


def test_shift_keeps_the_haplotype(spark):
    rng = random.Random(3)
    seq = "".join(rng.choice("AC") for _ in range(200))
    rows = []
    for _ in range(60):
        p, n = rng.randrange(20, 180), rng.randint(1, 4)
        rows.append((p, seq[p - 1 : p - 1 + n], "") if rng.random() < 0.5 else (p, "", "".join(rng.choice("AC") for _ in range(n))))
    rows = sorted(set(rows))
    ref = reference(spark, seq, 64)
    ref_chunked = alleles(spark, rows).withColumn("key", F.concat_ws(":", "pos", "ref", "alt"))
    ref_whole = reference(spark, seq)
    assert ref.count() > 1
    apply = lambda p, r, a: seq[: p - 1] + a + seq[p - 1 + len(r) :]
    for f in (normalise.left_shifted, normalise.right_shifted):
        for r in f(ref_chunked, ref_whole).collect():
            p, a, b = r["key"].split(":")
            assert apply(r["pos"], r["ref"], r["alt"]) == apply(int(p), a, b)
            assert seq[r["pos"] - 1 : r["pos"] - 1 + len(r["ref"])] == r["ref"]


def test_primitives(spark):
    assert plain(normalise.primitives(alleles(spark, [(5, "ACG", "TCC")]))) == [(5, "A", "T"), (7, "G", "C")]
    assert plain(normalise.primitives(alleles(spark, [(5, "AC", "TGG")]))) == [(5, "A", "T"), (6, "C", "G"), (7, "", "G")]


def test_records(spark):
    schema = "chrom string, pos long, ref string, alts array<string>, calls array<struct<sample:string,gt:array<int>>>, info map<string,string>"
    df = spark.createDataFrame([("c", 1, "A", ["C", "G", "T"], [("s", [1, 3])], {"END": "3"}), ("c", 9, "A", ["C", "C"], [("s", [1, 2])], {})], schema)
    assert [(r["alts"], r["calls"][0]["gt"]) for r in normalise.used_alleles(df).orderBy("pos").collect()][0] == (["C", "T"], [1, 2])
    assert [(r["alts"], r["calls"][0]["gt"]) for r in normalise.unique_alleles(df).orderBy("pos").collect()][1] == (["C"], [1, 1])
    assert sorted((r["alt"], r["calls"][0]["gt"]) for r in normalise.split_alleles(df).where("pos = 1").collect()) == [("C", [1, 0]), ("T", [0, 1])]
    assert [r["pos"] for r in normalise.per_base(df.where("pos = 1")).orderBy("pos").collect()] == [1, 2, 3]
    het = spark.createDataFrame([("c", 1, "A", "C", "het"), ("c", 1, "A", "G", "het"), ("c", 1, "AT", "A", "homalt")], "chrom string, pos long, ref string, alt string, gt string")
    assert sorted((r["alts"], r["gt"]) for r in normalise.joined_at_position(het).collect()) == [(["A"], "homalt"), (["C", "G"], "hetalt")]


def test_alignment(spark):
    assert alignment.align("ACGT", "ACGT") == (4, [("M", 4)])
    assert alignment.align("ACGTTT", "ACTTT")[1] == [("M", 2), ("D", 1), ("M", 3)]
    r = spark.createDataFrame([("AAAA", "AAGA"), ("ACG", "ACGTT")], "ref string, alt string").select(alignment.aligned("ref", "alt").alias("x")).select("x.*").collect()
    assert (r[0]["snp"], r[0]["ti"], r[0]["cigar"]) == (1, 1, "4M") and (r[1]["ins"], r[1]["del"]) == (2, 0)


def test_haplotypes(spark):
    seq = "GGCAAAAATTCACACAGTTTTGGGGCCCC"
    truth = alleles(spark, [(4, "A", ""), (20, "T", "C")]).withColumn("gt", F.lit("homalt"))
    query = alleles(spark, [(8, "A", ""), (20, "T", "C")]).withColumn("gt", F.lit("homalt"))
    ref = reference(spark, seq)
    assert haplotypes.compared(truth, query, ref).first()["outcome"] == "match"
    assert haplotypes.compared(truth, query.withColumn("gt", F.lit("het")), ref).first()["outcome"] == "mismatch"
    t = [(3, "C", "A", "het"), (5, "A", "T", "het")]
    assert len(haplotypes.pairs(seq, 1, t)) == 2 and haplotypes.pairs(seq, 1, t * 20) is None
    assert haplotypes.sequence("ACGT", 1, [(1, "AC", ""), (2, "C", "G")]) is None


def test_a_call_of_both_samples_is_put_into_blocks_once(spark, monkeypatch):
    seen, whole = [], haplotypes.superloci
    monkeypatch.setattr(haplotypes, "superloci", lambda rows, window: seen.append(rows.count()) or whole(rows, window))
    of = lambda rows: alleles(spark, rows).withColumn("gt", F.lit("homalt"))
    both = [(12, "T", "G")]
    got = haplotypes.compared(of([(4, "A", ""), *both, *both]), of([(8, "A", ""), *both]), reference(spark, "GGCAAAAATTCACACAGTTTTGGGGCCCC"))
    assert [tuple(r)[2:] for r in got.collect()] == [(12, 2, 2, "match")] and seen == [3]


def test_haplotype_pairs_against_brute_force():
    rng = random.Random(1)
    seq = "".join(rng.choice("ACGT") for _ in range(30))
    for _ in range(30):
        calls = [(p, seq[p - 1], rng.choice("ACGT"), rng.choice(["het", "homalt"])) for p in sorted(rng.sample(range(1, 30), 4))]
        want = set()
        for mask in range(16):
            h = [list(seq), list(seq)]
            for k, (p, _, a, g) in enumerate(calls):
                for side in (0, 1):
                    if g == "homalt" or mask >> k & 1 == side:
                        h[side][p - 1] = a
            want.add(tuple(sorted("".join(x) for x in h)))
        assert haplotypes.pairs(seq, 1, calls) == want


def test_scalars(spark):
    df = spark.createDataFrame([("chr1:1,000-2000",), ("chr2",), ("X:5",)], "t string").select(C.location(F.col("t")).alias("x")).select("x.*")
    assert [tuple(r) for r in df.collect()] == [("chr1", 1000, 2000), ("chr2", None, None), ("X", 5, None)]
    gts = [([0, 1], "het"), ([1, 1], "homalt"), ([1, 2], "hetalt"), ([0, 0], "homref"), ([-1, 1], "halfcall"), ([], "nocall"), ([1], "haploid"), ([-1, -1], "nocall")]
    rows = spark.createDataFrame(gts, "g array<int>, want string").withColumn("got", C.genotype_class(F.col("g")))
    assert all(r["got"] == r["want"] for r in rows.collect())


def test_queries_look_as_far_as_the_operators(spark, monkeypatch):
    from callmark.plans import catalogue

    given = lambda df: lambda spark, sf: df
    monkeypatch.setattr(catalogue, "reference", given(reference(spark, "GGCAAAAATTCACACAGTTTTGGGGCCCC")))
    monkeypatch.setattr(catalogue, "truth", given(alleles(spark, [(4, "A", "")]).withColumn("gt", F.lit("homalt"))))
    monkeypatch.setattr(catalogue, "query", given(alleles(spark, [(8, "A", "")]).withColumn("gt", F.lit("homalt"))))
    assert [tuple(r) for r in catalogue.haplotype_outcomes(spark, "").collect()] == [("match", 1, 1, 1)]
    monkeypatch.setattr(catalogue, "reference", given(reference(spark, "GG" + "A" * 1500 + "CGT" + "CA" * 20)))
    monkeypatch.setattr(catalogue, "query", given(alleles(spark, [(1502, "A", ""), (300, "A", ""), (258, "", "A"), (1546, "", "CA"), (1505, "TC", "C")])))
    assert sorted(tuple(r)[1:] for r in catalogue.left_shift_alleles(spark, "").collect()) == [(258, 3, "", "A"), (300, 3, "A", ""), (1502, 3, "A", ""), (1505, 1505, "T", ""), (1546, 1506, "", "CA")]

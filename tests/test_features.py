"""Caller features on literal records."""

import pytest

from callmark.operators import features, somatic
from callmark.sources import files

STRELKA = """##fileformat=VCFv4.1
##snv_scoring_features=one,two
##maxDepth_chr1=50.0
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tNORMAL\tTUMOR
chr1\t5\t.\tA\tT\t.\tPASS\tNT=ref;QSS_NT=40;SomaticEVS=12.5;MQ=60;EVSF=1.5,2\tDP:FDP:SDP:AU:CU:GU:TU\t20:2:5:18,19:0,0:0,0:2,2\t40:0:0:30,31:0,0:0,0:10,11
chr1\t9\t.\tC\tG\t.\tLowEVS;X\tNT=het\tDP:FDP:SDP:AU:CU:GU:TU\t0:0:0:0,0:0,0:0,0:0,0\t10:0:0:0,0:5,5:5,5:0,0
"""


@pytest.fixture
def strelka(spark, tmp_path):
    (tmp_path / "s.vcf").write_text(STRELKA)
    return str(tmp_path / "s.vcf")


def test_strelka(spark, strelka):
    depth, names = features.depths(spark, strelka), features.scoring_features(spark, strelka)
    assert depth == {"chr1": 50.0} and names == ["one", "two"]
    a, b = features.strelka_snv(files.read_calls(spark, strelka), depth, names).orderBy("pos").collect()
    assert (a["NT_REF"], a["QSS_NT"], a["EVS"], a["VQSR"], a["MQ"], a["MQ0"]) == (1, 40, 12.5, -1.0, 60.0, None)
    assert (a["N_FDP_RATE"], a["N_SDP_RATE"], a["N_AF"], a["T_AF"], a["T_DP_RATE"]) == (0.1, 0.2, 0.1, 0.25, 0.8)
    assert (a["E.one"], a["E.two"], b["E.one"], b["T_AF"], b["N_AF"]) == (1.5, 2.0, 0.0, 0.5, 0.0)


def test_curve(spark):
    rows = [("ref", 5, "PASS", "TP"), ("ref", 3, "QSS_ref", "TP"), ("ref", 9, "Other", "FP"), ("het", 8, "PASS", "FP"), (None, None, "", "FN")]
    table = spark.createDataFrame(rows, "NT string, QSS_NT int, filter string, tag string")
    got = {r["QSS_NT"]: (r["tp"], r["fp"], r["fn"]) for r in features.curve(table, "strelka.snv.qss").collect()}
    assert got[5.0] == (1, 0, 2) and got[3.0] == (2, 0, 1) and got[0.0] == (2, 2, 1)


def test_other_callers(spark, tmp_path):
    (tmp_path / "m.vcf").write_text(
        '##GATKCommandLine.MuTect=<ID=MuTect2,CommandLineOptions="tumor_sample_name=B normal_sample_name=A">\n'
        "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB\nchr1\t1\t.\tA\tAT\t.\tPASS\tTLOD=7.5;SSC=3\tDP:AD:RD:VF:GQX:TIR:TAR\t9:8,2:8:0.2:3:0,0:5,5\t4:1,3:1:0.7:9:6,6:2,2\n"
    )
    path = str(tmp_path / "m.vcf")
    calls = files.read_calls(spark, path)
    assert features.mutect_samples(spark, path, ["A", "B"]) == (0, 1)
    m = features.mutect(calls, 0, 1).first()
    assert (m["TLOD"], m["N_AF"], m["T_AF"]) == (7.5, 0.2, 0.75)
    assert features.varscan2(calls).first()["SSC"] == 3.0 and features.pisces(calls).first()["T_AF"] == 0.2
    i = features.strelka_indel(calls).first()
    assert (i["LENGTH"], i["INDELTYPE"], i["T_AF"]) == (1, 1, 0.75)
    assert set(features.EXTRACTORS) >= {c[0] for c in features.CURVES.values()}


def test_intervals_of_confidence():
    """Published rows: 15573 of 16235 recalled."""
    share, low, high = somatic.jeffreys(15573, 16235)
    assert abs(share - 0.959223898984) < 1e-9 and low < share < high and high - low < 0.01
    assert somatic.jeffreys(0, 0) == (0.0, 0.0, 1.0) and somatic.jeffreys(5, 5)[1] == 0.025 ** (1 / 5)
    assert abs(somatic.beta_quantile(0.5, 2, 2) - 0.5) < 1e-9 and abs(somatic.beta_quantile(0.3, 1, 1) - 0.3) < 1e-9
    assert somatic.af_bins([0.5]) == [(0.0, 0.5), (0.5, 1.00000001)]

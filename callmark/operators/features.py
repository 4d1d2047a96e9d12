"""Features of somatic calls by caller, and the ROC curves that go with them.

Each extractor is a select over rows as read_calls() gives them: the info map and the calls' format maps, of
which those of the normal and the tumour sample are taken.  Missing numbers count as 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callmark.operators.strata import TINY, simple_roc
from callmark.sources.files import header


def _number(text: Column, default: float | None = 0.0) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(default).cast("double"))


def _sample(i: int, key: str) -> Column:
    return F.get("calls", F.lit(i))["formats"][key]


def _listed(text: Column, k: int) -> Column:
    return _number(F.get(F.split(text, ","), F.lit(k)))


def _share(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def _common() -> list[Column]:
    return ["chrom", "pos", "ref", F.array_join("alts", ",").alias("alt"), F.array_join("filters", ",").alias("filter")]


def depths(spark: SparkSession, path: str) -> dict[str, float]:
    """Depth per contig from the header's depth lines (##maxdepth_chr1=..., ##meandepth_..., ##depth_...)."""
    rows = header(spark, path).where("lower(kind) rlike '^(max|mean)?depth_'").select(F.regexp_extract("text", r"(?i)depth_([^=]+)=", 1).alias("c"), F.regexp_extract("text", "=(.*)$", 1).try_cast("double").alias("d"))
    return {r["c"]: r["d"] for r in rows.collect() if r["d"] is not None}  # a line per contig


def scoring_features(spark: SparkSession, path: str, kind: str = "snv") -> list[str]:
    row = header(spark, path).where(f"kind = '{kind}_scoring_features'").select(F.regexp_extract("text", "=(.*)$", 1)).first()
    return row[0].split(",") if row else []


def _depth_rate(depth: Column, known: dict[str, float]) -> Column:
    rate = F.lit(0.0)
    for c, d in known.items():
        rate = F.when(F.col("chrom") == c, depth / d).otherwise(rate) if d else rate
    return rate


def _scores(names: list[str]) -> list[Column]:
    return [_number(F.get(F.split(F.col("info")["EVSF"], ","), F.lit(i))).alias(f"E.{n}") for i, n in enumerate(names)]


def _evs() -> Column:
    return _number(F.coalesce(F.col("info")["SomaticEVS"], F.col("info")["EVS"]), -1.0)


def _base_count(i: int) -> Callable[[Column], Column]:
    """Tier-1 count of a base in a sample."""
    return lambda base: _listed(F.get("calls", F.lit(i))["formats"][F.concat(base, F.lit("U"))], 0)


def _summed(count: Callable[[Column], Column]) -> Column:
    return F.aggregate("alts", F.lit(0.0), lambda total, base: total + count(base))


def strelka_snv(calls: DataFrame, depth: dict[str, float] | None = None, names: list[str] | None = None) -> DataFrame:
    """Tier-1 allele frequencies from the counts by base, filtered and spanning-deletion rates, depth rates, scores."""
    known, info = depth or {}, F.col("info")
    out = [*_common(), info["NT"].alias("NT"), (info["NT"] == "ref").cast("int").alias("NT_REF"), _number(info["QSS_NT"]).cast("int").alias("QSS_NT"), _number(info["VQSR"], -1.0).alias("VQSR"), _evs().alias("EVS")]
    for i, who in enumerate("NT"):
        dp, fdp, sdp = (_number(_sample(i, k)) for k in ("DP", "FDP", "SDP"))
        ref, alt = _base_count(i)(F.col("ref")), _summed(_base_count(i))
        out += [_share(fdp, dp).alias(f"{who}_FDP_RATE"), _share(sdp, dp + sdp).alias(f"{who}_SDP_RATE"), dp.alias(f"{who}_DP"), _depth_rate(dp, known).alias(f"{who}_DP_RATE"), _share(alt, alt + ref).alias(f"{who}_AF")]
    rest = [_number(info[k], None).alias(k) for k in ("MQ", "MQ0")] + [_number(info[k]).alias(k) for k in ("SNVSB", "ReadPosRankSum")]
    return calls.select(*out, *rest, *_scores(names or []))


def strelka_indel(calls: DataFrame, depth: dict[str, float] | None = None, names: list[str] | None = None) -> DataFrame:
    """Indel length and direction (1 insertion, 2 deletion, 3 both), allele frequencies from TIR and TAR, repeat context."""
    known, info = depth or {}, F.col("info")
    n = F.length("ref")
    sizes = F.transform("alts", lambda a: F.length(a))
    kind = F.when(F.exists(sizes, lambda x: x > n), 1).otherwise(0) + F.when(F.exists(sizes, lambda x: x <= n), 2).otherwise(0)
    length = F.greatest(n, F.array_max(sizes)) - F.least(n, F.array_min(sizes))
    out = [*_common(), length.alias("LENGTH"), kind.alias("INDELTYPE"), info["NT"].alias("NT"), (info["NT"] == "ref").cast("int").alias("NT_REF"), _number(info["QSI_NT"]).cast("int").alias("QSI_NT"), _evs().alias("EVS")]
    for i, who in enumerate("NT"):
        dp, tir, tar = _number(_sample(i, "DP")), _listed(_sample(i, "TIR"), 0), _listed(_sample(i, "TAR"), 0)
        out += [dp.alias(f"{who}_DP"), _depth_rate(dp, known).alias(f"{who}_DP_RATE"), _number(_sample(i, "BCN50")).alias(f"{who}_BCN"), _number(_sample(i, "FDP50")).alias(f"{who}_FDP"), _share(tir, tir + tar).alias(f"{who}_AF")]
    rest = [info["SGT"].alias("SGT"), _number(info["RC"]).alias("RC"), info["RU"].alias("RU"), F.coalesce(F.length(info["RU"]), F.lit(0)).alias("RU_LEN"), _number(info["IC"]).alias("IC"), _number(info["IHP"]).alias("IHP")]
    return calls.select(*out, *rest, *[_number(info[k], None).alias(k) for k in ("MQ", "MQ0")], *_scores(names or []))


def mutect(calls: DataFrame, normal: int = 1, tumour: int = 0, depth: dict[str, float] | None = None) -> DataFrame:
    """Log-odds and allele frequencies from AD; which sample is which comes from mutect_samples()."""
    known, info = depth or {}, F.col("info")
    out = [*_common(), *[_number(info[k]).alias(k) for k in ("TLOD", "NLOD", "ECNT", "HCNT", "MAX_ED", "MIN_ED")], info["DB"].isNotNull().cast("int").alias("DB")]
    for i, who in ((normal, "N"), (tumour, "T")):
        dp = _number(_sample(i, "DP"))
        counts = F.transform(F.split(F.coalesce(_sample(i, "AD"), F.lit("0")), ","), lambda x: _number(x))
        whole = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
        out += [dp.alias(f"{who}_DP"), _depth_rate(dp, known).alias(f"{who}_DP_RATE"), _share(whole - F.get(counts, F.lit(0)), whole).alias(f"{who}_AF")]
    return calls.select(*out)


def mutect_samples(spark: SparkSession, path: str, samples: list[str]) -> tuple[int, int]:
    """Places of the normal and the tumour sample by the caller's command line; (1, 0) where it names none."""
    row = header(spark, path).where("kind like 'GATKCommandLine%' and lower(id) like 'mutect%'").first()
    text = row["text"] if row else ""

    def place(key: str, default: int) -> int:
        name = text.partition(f"{key}_sample_name=")[2].split(" ")[0].strip('">')
        return samples.index(name) if name in samples else default

    return place("normal", 1), place("tumor", 0)


def varscan2(calls: DataFrame, depth: dict[str, float] | None = None) -> DataFrame:
    """Somatic scores and p-values, allele frequencies from reference and alternative depth."""
    known, info = depth or {}, F.col("info")
    out = [*_common(), *[_number(info[k]).alias(k) for k in ("SSC", "GPV", "SPV")]]
    for i, who in enumerate("NT"):
        dp, rd, ad = (_number(_sample(i, k)) for k in ("DP", "RD", "AD"))
        out += [dp.alias(f"{who}_DP"), _depth_rate(dp, known).alias(f"{who}_DP_RATE"), _share(ad, rd + ad).alias(f"{who}_AF")]
    return calls.select(*out)


def pisces(calls: DataFrame, depth: dict[str, float] | None = None, names: list[str] | None = None) -> DataFrame:
    known = depth or {}
    dp = _number(_sample(0, "DP"))
    return calls.select(*_common(), _number(_sample(0, "GQX")).alias("GQX"), _evs().alias("EVS"), dp.alias("T_DP"), _depth_rate(dp, known).alias("T_DP_RATE"), _number(_sample(0, "VF")).alias("T_AF"), *_scores(names or []))


def generic(calls: DataFrame) -> DataFrame:
    return calls.select(*_common(), "qual")


#: Extractors by the name under which a caller's table is asked for.
EXTRACTORS: dict[str, Callable[..., DataFrame]] = {
    "generic": generic, "hcc.strelka.snv": strelka_snv, "hcc.strelka.indel": strelka_indel, "admix.strelka.snv": strelka_snv, "admix.strelka.indel": strelka_indel,
    "hcc.mutect.snv": mutect, "hcc.mutect.indel": mutect, "hcc.varscan2.snv": varscan2, "hcc.varscan2.indel": varscan2, "hcc.pisces.snv": pisces, "hcc.pisces.indel": pisces,
}

#: Per curve the extractor, the score, the filter that it replaces, and whether only NT = ref counts.
CURVES = {
    "strelka.snv.qss": ("hcc.strelka.snv", "QSS_NT", "QSS_ref", True),
    "strelka.snv.vqsr": ("hcc.strelka.snv", "VQSR", "LowQscore", True),
    "strelka.snv": ("hcc.strelka.snv", "EVS", "LowEVS", True),
    "strelka.indel": ("hcc.strelka.indel", "QSI_NT", "QSI_ref", True),
    "strelka.indel.evs": ("hcc.strelka.indel", "EVS", "LowEVS", False),
    "varscan2.snv": ("hcc.varscan2.snv", "SSC", None, False),
    "varscan2.indel": ("hcc.varscan2.indel", "SSC", None, False),
    "mutect.snv": ("hcc.mutect.snv", "TLOD", "t_lod_fstar", False),
    "mutect.indel": ("hcc.mutect.indel", "TLOD", "t_lod_fstar", False),
}


def curve(table: DataFrame, name: str) -> DataFrame:
    """table: features with tag (TP, FP, FN).  Calls that another filter rejects get the least score."""
    _, score, ignored, only_ref = CURVES[name]
    value = F.col(score).cast("double")
    if only_ref:
        value = F.when(F.col("NT") == "ref", value).otherwise(0.0)
    left = F.array_except(F.split("filter", "[,;]"), F.array(*[F.lit(x) for x in ("PASS", ".", "", *([ignored] if ignored else []))]))
    if ignored:
        value = F.when(F.size(left) > 0, F.lit(TINY)).otherwise(value)
    return simple_roc(table.withColumn("_v", value), "_v", "tag").withColumnRenamed("_v", score)

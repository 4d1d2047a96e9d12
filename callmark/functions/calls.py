"""Scalar expressions on alleles, genotypes, filters and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_transition(ref: Column, alt: Column) -> Column:
    return F.concat(F.upper(ref), F.upper(alt)).isin("AG", "GA", "CT", "TC")


def allele_type(ref: Column, alt: Column) -> Column:
    """SNP if both alleles are one base, else INDEL."""
    return F.when((F.length(ref) == 1) & (F.length(alt) == 1), "SNP").otherwise("INDEL")


def subtype(ref: Column, alt: Column) -> Column:
    """ti, tv; i or d with 1_5, 6_15, 16_plus for pure insertions and deletions; c with the same for both at once."""
    size = F.abs(F.length(ref) - F.length(alt))
    shared = F.least(F.length(ref), F.length(alt))
    pure = F.substring(ref, F.lit(1), shared) == F.substring(alt, F.lit(1), shared)
    reach = lambda n: F.when(n <= 5, "1_5").when(n <= 15, "6_15").otherwise("16_plus")
    snp = F.when(is_transition(ref, alt), "ti").otherwise("tv")
    kind = F.when(~pure, "c").when(F.length(alt) > F.length(ref), "i").otherwise("d")
    return F.when((F.length(ref) == 1) & (F.length(alt) == 1), snp).otherwise(F.concat(kind, reach(F.greatest(size, F.lit(1)))))


def genotype_class(gt: Column) -> Column:
    """gt: allele numbers, -1 for missing.  homref, haploid, het, homalt, hetalt, halfcall, nocall or unknown."""
    n, low, high = F.size(gt), F.array_min(gt), F.array_max(gt)
    return (
        F.when(n == 0, "nocall")
        .when(high < 0, "nocall")
        .when(low < 0, "halfcall")
        .when((n == 1) & (high > 0), "haploid")
        .when(high == 0, "homref")
        .when(n > 2, "unknown")
        .when(low == 0, "het")
        .when(low == high, "homalt")
        .otherwise("hetalt")
    )


def passes(filters: Column) -> Column:
    return F.forall(filters, lambda f: f.isin("PASS", ".", ""))


def passes_named(filters: Column, names: list[str]) -> Column:
    """True where none of the named filters is set."""
    return ~F.arrays_overlap(filters, F.array(*[F.lit(n) for n in names]))


def with_chr(chrom: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(chrom, r"^([0-9XYM])", "chr$1"), "^chrMT$", "chrM")


def has_nonref(gts: Column, alts: Column) -> Column:
    return (F.element_at(alts, -1) == "<NON_REF>") & F.exists(gts, lambda g: g == F.size(alts))


def import_failed(ref: Column, alts: Column) -> Column:
    iupac = r"^[ACGTURYKMSWBDHVNacgturykmswbdhvn]+$"
    return ref.rlike(r"[.\-*]") | F.exists(alts, lambda a: ~a.rlike(iupac) & ~a.isin(".", "*", "<DEL>", "<NON_REF>") & ~a.rlike(r"^<.*>$"))


def decision(t: Column, q: Column, t_alleles: Column, q_alleles: Column, t_class: Column, q_class: Column, ambiguous: Column) -> Column:
    """Struct (type, kind) of the simple comparison; alleles are arrays of strings that include the reference if it is called."""
    no_ref = lambda a: F.filter(a, lambda x: x != "ref")
    same = (F.size(F.array_except(t_alleles, q_alleles)) == 0) & (F.size(F.array_except(q_alleles, t_alleles)) == 0)
    t1, q1 = no_ref(t_alleles), no_ref(q_alleles)
    same1 = (F.size(F.array_except(t1, q1)) == 0) & (F.size(F.array_except(q1, t1)) == 0)
    out = lambda a, b: F.struct(F.lit(a).alias("type"), F.lit(b).alias("kind"))
    return (
        F.when(ambiguous, out("N", "ambiguous"))
        .when(t & ~q, out("FN", "missing"))
        .when(~t & q, out("FP", "missing"))
        .when(t & q & same & (t_class == q_class), out("TP", "match"))
        .when(t & q & (same | same1), out("FP", "gtmismatch"))
        .when(t & q & F.arrays_overlap(t1, q1), out("FP", "alpartial"))
        .when(t & q, out("FP", "almismatch"))
        .otherwise(out("N", "match"))
    )


def sub_kind(type_: Column, kind: Column) -> Column:
    """gm for a match, am where only the genotype differs, lm where alleles differ at one place."""
    return F.when(type_ == "TP", "gm").when(kind == "gtmismatch", "am").when(kind.isin("almismatch", "alpartial"), "lm").otherwise(".")


def filtered_decision(d: Column) -> Column:
    """What a decision becomes once its call fails the filters."""
    return F.when(d.isin("TP", "FN"), "FN").otherwise("N")


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def recall(tp: Column, fn: Column) -> Column:
    return ratio(tp, tp + fn)


def precision(tp: Column, fp: Column) -> Column:
    return ratio(tp, tp + fp)


def f1(r: Column, p: Column) -> Column:
    return F.when(r + p > 0, 2 * r * p / (r + p))


def _first_of_each(entries: Column) -> Column:
    """A map of (key, value) entries in which the first of a repeated key stands."""
    once = F.aggregate(entries, F.slice(entries, 1, 0), lambda a, e: F.when(F.exists(a, lambda x: x["key"] == e["key"]), a).otherwise(F.concat(a, F.array(e))))
    keys = F.transform(entries, lambda e: e["key"])
    return F.map_from_entries(F.when(F.size(F.array_distinct(keys)) == F.size(keys), entries).otherwise(once))


def info_map(info: Column) -> Column:
    """INFO text as a map; flags have the value true, of a repeated key the first entry stands."""
    pairs = F.filter(F.split(info, ";"), lambda x: (x != "") & (x != "."))
    return _first_of_each(F.transform(pairs, lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.when(x.contains("="), F.substr(x, F.instr(x, F.lit("=")) + 1)).otherwise("true").alias("value"))))


def format_map(keys: Column, values: Column) -> Column:
    """FORMAT keys with a sample's values; trailing values may be missing, of a repeated key the first stands."""
    pairs = lambda v: F.transform(F.split(keys, ":"), lambda x, i: F.struct(x.alias("key"), F.coalesce(F.get(v, i), F.lit(".")).alias("value")))
    return _first_of_each(F.get(F.transform(F.array(F.split(values, ":")), pairs), F.lit(0)))  # split once, not for each key


def location(text: Column) -> Column:
    """chrom:start-stop with commas allowed, as a struct; missing ends are null."""
    part = lambda i: F.regexp_replace(F.regexp_extract(text, r"^([^:]+)(?::([0-9,]+))?(?:-([0-9,]+))?$", i), ",", "")
    number = lambda i: F.expr("cast(null as long)") if i is None else F.when(part(i) != "", part(i).cast("long"))
    return F.struct(F.regexp_extract(text, r"^([^:]+)", 1).alias("chrom"), number(2).alias("start"), number(3).alias("stop"))

"""Queries by name over the adapter views, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callmark.functions import calls as C
from callmark.operators import blocks, haplotypes, intervals, matching, normalise, somatic, strata
from callmark.plans import germline, matching as block_matching
from callmark.sources.adapter import VIEWS, calls, conf, query, read, reference, truth
from callmark.sources.scratch import written
from callmark.streaming.sessions import sessions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
ALLELE = matching.ALLELE
KEYS = "chrom, pos, ref, alt"


def query_of(sql: str):
    """Registers a function under its name, with its SQL; `sql` may use the views and go on with a comma after them."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = VIEWS + sql if "VIEWS" not in sql else sql.replace("VIEWS", "")
        return f

    return add


# ---- matching


@query_of(f"""
, t AS (SELECT DISTINCT {KEYS} FROM truth), q AS (SELECT DISTINCT {KEYS} FROM query)
SELECT 'TP' AS decision, count(*) AS n FROM t SEMI JOIN q USING ({KEYS})
UNION ALL SELECT 'FN', count(*) FROM t ANTI JOIN q USING ({KEYS})
UNION ALL SELECT 'FP', count(*) FROM q ANTI JOIN t USING ({KEYS})""")
def allele_match_counts(spark, sf):
    t, q = F.col("in_truth"), F.col("in_query")
    n = matching.allele_presence(truth(spark, sf), query(spark, sf)).agg(F.count_if(t & q).alias("TP"), F.count_if(t & ~q).alias("FN"), F.count_if(~t & q).alias("FP"))
    return n.select(F.inline(F.array(*[F.struct(F.lit(d).alias("decision"), F.col(d).alias("n")) for d in ("TP", "FN", "FP")])))


@query_of(f"SELECT DISTINCT {KEYS} FROM truth ANTI JOIN query USING ({KEYS})")
def fn_anti(spark, sf):
    return matching.intersection(truth(spark, sf), query(spark, sf))[1]


@query_of(f"SELECT DISTINCT {KEYS} FROM query ANTI JOIN truth USING ({KEYS})")
def fp_anti(spark, sf):
    return matching.intersection(truth(spark, sf), query(spark, sf))[2]


@query_of(f"SELECT {KEYS} FROM truth INTERSECT SELECT {KEYS} FROM query")
def tp_intersect(spark, sf):
    return matching.intersection(truth(spark, sf), query(spark, sf))[0]


ONE = f"""
, t AS (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY rid, qq) AS k FROM truth)
, q AS (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY rid, qq) AS k FROM query)
, m AS (
  SELECT coalesce(t.chrom, q.chrom) AS chrom, coalesce(t.pos, q.pos) AS pos, coalesce(t.ref, q.ref) AS ref, coalesce(t.alt, q.alt) AS alt,
    t.gt AS gt_truth, q.gt AS gt_query, t.qq AS qq_truth0, q.qq AS qq_query, coalesce(q.filt, 'PASS') AS filt, q.gt IS NULL AS no_query,
    CASE WHEN t.gt IS NOT NULL THEN CASE WHEN t.gt = q.gt THEN 'TP' ELSE 'FN' END END AS bd_truth,
    CASE WHEN q.gt IS NOT NULL THEN CASE WHEN t.gt = q.gt THEN 'TP' ELSE 'FP' END END AS bd_query
  FROM t FULL OUTER JOIN q ON t.chrom = q.chrom AND t.pos = q.pos AND t.ref = q.ref AND t.alt = q.alt AND t.k = q.k)
"""
COUNTS = """count(*) FILTER (bd_truth IN ('TP','FN')) AS truth_total, count(*) FILTER (bd_truth = 'TP') AS truth_tp, count(*) FILTER (bd_truth = 'FN') AS truth_fn,
  count(*) FILTER (bd_query IN ('TP','FP','UNK')) AS query_total, count(*) FILTER (bd_query = 'TP') AS query_tp, count(*) FILTER (bd_query = 'FP') AS query_fp, count(*) FILTER (bd_query = 'UNK') AS query_unk"""
TYPE = "CASE WHEN length(ref) = 1 AND length(alt) = 1 THEN 'SNP' ELSE 'INDEL' END"


def metrics_sql(keys: str, source: str) -> str:
    return f"""
, counted AS (SELECT {keys}, {COUNTS} FROM {source} GROUP BY {keys})
, shares AS (SELECT *, CASE WHEN truth_total = 0 THEN 0.0 WHEN truth_tp + truth_fn > 0 THEN truth_tp / (truth_tp + truth_fn) END AS r,
  CASE WHEN query_total = 0 THEN 0.0 WHEN query_tp + query_fp > 0 THEN query_tp / (query_tp + query_fp) END AS p FROM counted)
SELECT {keys}, truth_total, truth_tp, truth_fn, query_total, query_tp, query_fp, query_unk, round(r, 6) AS recall, round(p, 6) AS precision,
  round(CASE WHEN query_total > 0 THEN query_unk / query_total END, 6) AS frac_na, round(CASE WHEN r + p > 0 THEN 2 * r * p / (r + p) END, 6) AS f1 FROM shares"""


def matched(spark, sf) -> DataFrame:
    rows = strata.labelled(matching.one_to_one(truth(spark, sf), query(spark, sf)))
    return rows.withColumn("filt", F.coalesce("filt_query", F.lit("PASS"))).withColumn("type", C.allele_type(F.col("ref"), F.col("alt")))


@query_of(ONE + f"SELECT {TYPE} AS type, bd_truth, bd_query, count(*) AS n FROM m GROUP BY ALL")
def one_to_one_match(spark, sf):
    return matched(spark, sf).groupBy("type", "bd_truth", "bd_query").agg(F.count("*").alias("n"))


STRATA = f"""
, s AS (SELECT {TYPE} AS type, 'ALL' AS filter, bd_truth, bd_query FROM m UNION ALL
  SELECT {TYPE}, 'PASS', CASE WHEN filt <> 'PASS' AND bd_truth = 'TP' THEN 'FN' ELSE bd_truth END, CASE WHEN filt = 'PASS' THEN bd_query END FROM m)"""


@query_of(ONE + STRATA + metrics_sql("type, filter", "s"))
def summary_by_type_filter(spark, sf):
    return strata.with_metrics(strata.decision_counts(strata.filter_strata(matched(spark, sf)), ["type", "filter"]))


IN_CONF = "EXISTS (SELECT 1 FROM conf c WHERE c.chrom = m.chrom AND c.start <= m.pos + length(m.ref) - 1 AND c.stop >= m.pos)"
UNK = f"""
, u AS (SELECT * EXCLUDE (bd_truth, bd_query), CASE WHEN bd_truth IS NOT NULL AND NOT inside THEN 'UNK' ELSE bd_truth END AS bd_truth,
  CASE WHEN bd_query IS NOT NULL AND NOT inside THEN 'UNK' ELSE bd_query END AS bd_query FROM (SELECT *, {IN_CONF} AS inside FROM m))"""


def assessed(spark, sf) -> DataFrame:
    """Matched calls with the confident regions applied."""
    rows = matched(spark, sf).withColumn("start", F.col("pos")).withColumn("stop", F.col("pos") + F.length("ref") - 1)
    sites = rows.select("chrom", "start", "stop").distinct()
    inside = intervals.overlapping(sites, conf(spark, sf)).select("chrom", "start", "stop").distinct().withColumn("inside", F.lit(True))
    joined = rows.join(inside, ["chrom", "start", "stop"], "left")
    return strata.unknown_outside(joined, F.coalesce("inside", F.lit(False)))


@query_of(ONE + UNK + STRATA.replace("FROM m", "FROM u") + metrics_sql("type, filter", "s"))
def summary_conf_unk(spark, sf):
    return strata.with_metrics(strata.decision_counts(strata.filter_strata(assessed(spark, sf)), ["type", "filter"]))


flagship = summary_conf_unk

SUBTYPE = """CASE WHEN length(ref) = 1 AND length(alt) = 1 THEN CASE WHEN ref || alt IN ('AG','GA','CT','TC') THEN 'ti' ELSE 'tv' END
  ELSE CASE WHEN substr(ref, 1, least(length(ref), length(alt))) <> substr(alt, 1, least(length(ref), length(alt))) THEN 'c' WHEN length(alt) > length(ref) THEN 'i' ELSE 'd' END ||
  CASE WHEN greatest(abs(length(ref) - length(alt)), 1) <= 5 THEN '1_5' WHEN abs(length(ref) - length(alt)) <= 15 THEN '6_15' ELSE '16_plus' END END"""


@query_of(f"SELECT {SUBTYPE} AS subtype, filt, count(*) AS n, count(DISTINCT pos) AS n_pos FROM calls GROUP BY ALL")
def subtype_counts(spark, sf):
    df = calls(spark, sf).withColumn("subtype", C.subtype(F.col("ref"), F.col("alt")))
    return df.groupBy("subtype", "filt").agg(F.count("*").alias("n"), F.countDistinct("pos").alias("n_pos"))


EXTENDED = f"""
, base AS (SELECT {TYPE} AS type, {SUBTYPE} AS subtype, coalesce(gt_truth, gt_query) AS genotype, bd_truth, bd_query FROM u)
, s AS (SELECT type, subtype, '*' AS genotype, bd_truth, bd_query FROM base UNION ALL SELECT type, '*', genotype, bd_truth, bd_query FROM base
  UNION ALL SELECT * FROM base UNION ALL SELECT type, '*', '*', bd_truth, bd_query FROM base)"""


@query_of(ONE + UNK + EXTENDED + metrics_sql("type, subtype, genotype", "s"))
def extended_strata(spark, sf):
    rows = assessed(spark, sf).withColumn("subtype", C.subtype(F.col("ref"), F.col("alt"))).withColumn("genotype", F.coalesce("gt_truth", "gt_query"))
    stratified = strata.subtype_strata(rows.select("type", "subtype", "genotype", "bd_truth", "bd_query"))
    return strata.with_metrics(strata.decision_counts(stratified, ["type", "subtype", "genotype"]))


@query_of(ONE + UNK + STRATA.replace("FROM m", "FROM u").replace(f"SELECT {TYPE} AS type,", f"SELECT inside, {TYPE} AS type,").replace(f"SELECT {TYPE}, 'PASS'", f"SELECT inside, {TYPE}, 'PASS'")
  + ", x AS (SELECT '*' AS subset, * FROM s UNION ALL SELECT CASE WHEN inside THEN 'confident' ELSE 'elsewhere' END, * FROM s)" + metrics_sql("subset, type, filter", "x"))
def subset_strata(spark, sf):
    """The summary for all calls, for those in confident regions and for those elsewhere."""
    rows = strata.filter_strata(assessed(spark, sf))
    place = F.array(F.when(F.coalesce("inside", F.lit(False)), "confident").otherwise("elsewhere"))
    return strata.with_metrics(strata.decision_counts(strata.subset_strata(rows, place), ["subset", "type", "filter"]))


@query_of(ONE + f"""
, here AS (SELECT DISTINCT chrom, pos FROM truth)
SELECT {TYPE} AS type, filt, count(*) AS fp, count(*) FILTER (m.gt_truth IS NOT NULL) AS fp_gt, count(*) FILTER (m.gt_truth IS NULL AND here.pos IS NOT NULL) AS fp_al
FROM m LEFT JOIN here ON m.chrom = here.chrom AND m.pos = here.pos WHERE bd_query = 'FP' GROUP BY ALL""")
def fp_gt_al_split(spark, sf):
    """False positives whose allele is true with another genotype, and those where a true call with other alleles stands."""
    rows = strata.false_positive_split(matched(spark, sf), truth(spark, sf))
    return rows.groupBy("type", "filt").agg(F.count("*").alias("fp"), F.count_if(F.col("fp_kind") == "gt").alias("fp_gt"), F.count_if(F.col("fp_kind") == "al").alias("fp_al"))


PIVOT = {f"{side}_{what}": (side, what) for side in ("truth", "query") for what in ("ti", "tv", "het", "homalt")}


@query_of(ONE + STRATA.replace("AS type,", "AS type, ref, alt, gt_truth, gt_query,", 1).replace(f"SELECT {TYPE}, 'PASS'", f"SELECT {TYPE}, ref, alt, gt_truth, gt_query, 'PASS'") + """
, c AS (SELECT type, filter, """ + ", ".join(f"count(*) FILTER (bd_{s} IN ('TP','FN','FP','UNK') AND " + (f"type = 'SNP' AND ref || alt {'IN' if w == 'ti' else 'NOT IN'} ('AG','GA','CT','TC')" if w in ("ti", "tv") else f"gt_{s} = '{w}'") + f") AS {n}" for n, (s, w) in PIVOT.items()) + """ FROM s GROUP BY ALL)
SELECT *, """ + ", ".join(f"round({s}_{a} / nullif({s}_{b}, 0), 6) AS {s}_{a}_{b}_ratio" for s in ("truth", "query") for a, b in (("ti", "tv"), ("het", "homalt"))) + " FROM c")
def titv_pivot(spark, sf):
    """Per type and filter: transitions, transversions, het and homalt calls of each sample, side by side, and their ratios."""
    rows = strata.filter_strata(matched(spark, sf))
    ti = C.is_transition(F.col("ref"), F.col("alt"))
    of = lambda side, what: F.col(f"bd_{side}").isNotNull() & (((F.col("type") == "SNP") & (ti if what == "ti" else ~ti)) if what in ("ti", "tv") else F.col(f"gt_{side}") == what)
    counted = rows.groupBy("type", "filter").agg(*[F.count_if(of(side, what)).alias(name) for name, (side, what) in PIVOT.items()])
    share = lambda s, a, b: F.round(C.ratio(F.col(f"{s}_{a}"), F.col(f"{s}_{b}")), 6).alias(f"{s}_{a}_{b}_ratio")
    return counted.select("*", *[share(s, a, b) for s in ("truth", "query") for a, b in (("ti", "tv"), ("het", "homalt"))])


@query_of(f"""SELECT chrom, {SUBTYPE} AS subtype, gt, count(*) AS locations, CAST(sum(CASE gt WHEN 'homalt' THEN 2 ELSE 1 END) AS BIGINT) AS alleles,
  CAST(sum(CASE WHEN length(alt) > length(ref) THEN length(alt) - length(ref) ELSE 0 END) AS BIGINT) AS bases_inserted, CAST(sum(CASE WHEN length(ref) > length(alt) THEN length(ref) - length(alt) ELSE 0 END) AS BIGINT) AS bases_deleted
FROM calls GROUP BY ALL""")
def variant_statistics(spark, sf):
    """Counts per allele class and genotype class: locations, alleles that are called, bases inserted and deleted."""
    df, grown = calls(spark, sf).withColumn("subtype", C.subtype(F.col("ref"), F.col("alt"))), F.length("alt") - F.length("ref")
    return df.groupBy("chrom", "subtype", "gt").agg(
        F.count("*").alias("locations"),
        F.sum(F.when(F.col("gt") == "homalt", 2).otherwise(1)).alias("alleles"),
        F.sum(F.greatest(grown, F.lit(0))).cast("long").alias("bases_inserted"),
        F.sum(F.greatest(-grown, F.lit(0))).cast("long").alias("bases_deleted"),
    )


@query_of(f"""SELECT filt, count(*) FILTER (ref || alt IN ('AG','GA','CT','TC')) AS ti, count(*) FILTER (ref || alt NOT IN ('AG','GA','CT','TC')) AS tv,
  round(count(*) FILTER (ref || alt IN ('AG','GA','CT','TC')) / nullif(count(*) FILTER (ref || alt NOT IN ('AG','GA','CT','TC')), 0), 6) AS titv
  FROM query WHERE length(ref) = 1 AND length(alt) = 1 GROUP BY filt""")
def titv_by_filter(spark, sf):
    df = query(spark, sf).where((F.length("ref") == 1) & (F.length("alt") == 1))
    ti = C.is_transition(F.col("ref"), F.col("alt"))
    out = df.groupBy("filt").agg(F.count(F.when(ti, 1)).alias("ti"), F.count(F.when(~ti, 1)).alias("tv"))
    return out.withColumn("titv", F.round(C.ratio(F.col("ti"), F.col("tv")), 6))


@query_of("SELECT chrom, count(*) FILTER (gt = 'het') AS het, count(*) FILTER (gt = 'homalt') AS homalt, round(count(*) FILTER (gt = 'het') / nullif(count(*) FILTER (gt = 'homalt'), 0), 6) AS het_hom FROM query GROUP BY chrom")
def het_hom_ratio(spark, sf):
    out = query(spark, sf).groupBy("chrom").agg(F.count(F.when(F.col("gt") == "het", 1)).alias("het"), F.count(F.when(F.col("gt") == "homalt", 1)).alias("homalt"))
    return out.withColumn("het_hom", F.round(C.ratio(F.col("het"), F.col("homalt")), 6))


@query_of("SELECT rid, chrom, pos, ref, alt, gt, qq FROM truth t WHERE EXISTS (SELECT 1 FROM query q WHERE q.chrom = t.chrom AND abs(q.pos - t.pos) <= 30)")
def distance_match_semi(spark, sf):
    return matching.near(truth(spark, sf), query(spark, sf), 30).select("rid", "chrom", "pos", "ref", "alt", "gt", "qq")


@query_of("SELECT rid, chrom, pos, ref, alt, gt, qq FROM truth t WHERE NOT EXISTS (SELECT 1 FROM query q WHERE q.chrom = t.chrom AND abs(q.pos - t.pos) <= 30)")
def distance_nomatch_anti(spark, sf):
    return matching.near(truth(spark, sf), query(spark, sf), 30, found=False).select("rid", "chrom", "pos", "ref", "alt", "gt", "qq")


@query_of("""
, t AS (SELECT *, row_number() OVER (PARTITION BY chrom, pos ORDER BY ref, alt, rid) AS k FROM truth), q AS (SELECT *, row_number() OVER (PARTITION BY chrom, pos ORDER BY ref, alt, rid) AS k FROM query)
SELECT t.chrom, t.pos, t.k, t.ref, t.alt, t.rid, q.ref AS b_ref, q.alt AS b_alt, q.rid AS b_rid FROM t JOIN q USING (chrom, pos, k)""")
def position_zip_join(spark, sf):
    zipped = matching.position_zip(truth(spark, sf), query(spark, sf), ("ref", "alt", "rid"))
    return zipped.select("chrom", "pos", F.col("k").cast("long").alias("k"), "ref", "alt", "rid", "b_ref", "b_alt", "b_rid")


# ---- intervals

MERGED = """
, marked AS (SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY chrom, label ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS new FROM conf)
, runs AS (SELECT *, sum(new) OVER (PARTITION BY chrom, label ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS run FROM marked)
, merged AS (SELECT chrom, label, min(start) AS start, max(stop) AS stop FROM runs GROUP BY chrom, label, run)
"""


@query_of(MERGED + "SELECT chrom, label, start, stop FROM merged")
def merged_intervals(spark, sf):
    return intervals.merged(conf(spark, sf), ["chrom", "label"]).select("chrom", "label", "start", "stop")


@query_of("SELECT c.label, count(*) AS n, count(DISTINCT q.pos) AS n_pos FROM query q JOIN conf c ON q.chrom = c.chrom AND c.start <= q.pos + length(q.ref) - 1 AND c.stop >= q.pos GROUP BY c.label")
def region_overlap_counts(spark, sf):
    sites = query(spark, sf).select("chrom", F.col("pos").alias("start"), (F.col("pos") + F.length("ref") - 1).alias("stop"))
    return intervals.overlapping(sites, conf(spark, sf)).groupBy(F.col("b_label").alias("label")).agg(F.count("*").alias("n"), F.countDistinct("start").alias("n_pos"))


@query_of(MERGED + "SELECT c.label, count(*) AS n FROM query q JOIN merged c ON q.chrom = c.chrom AND c.start <= q.pos AND c.stop >= q.pos + length(q.ref) - 1 GROUP BY c.label")
def region_covered_counts(spark, sf):
    sites = query(spark, sf).select("chrom", F.col("pos").alias("start"), (F.col("pos") + F.length("ref") - 1).alias("stop"))
    return intervals.covered(sites, conf(spark, sf)).groupBy(F.col("b_label").alias("label")).agg(F.count("*").alias("n"))


@query_of(MERGED + """SELECT a.label, b.label AS b_label, CAST(sum(least(a.stop, b.stop) - greatest(a.start, b.start) + 1) AS BIGINT) AS bases
FROM merged a JOIN merged b ON a.chrom = b.chrom AND a.start <= b.stop AND b.start <= a.stop GROUP BY 1, 2""")
def interval_intersection_size(spark, sf):
    return intervals.intersection_size(conf(spark, sf), conf(spark, sf))


@query_of("SELECT label, CAST(sum(stop - start + 1) AS BIGINT) AS bases FROM conf GROUP BY label")
def region_sizes(spark, sf):
    return intervals.region_sizes(conf(spark, sf))


@query_of("""
, seen AS (SELECT *, max(stop) OVER (PARTITION BY chrom ORDER BY start, stop, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM conf)
SELECT chrom, start, stop, label FROM seen WHERE before >= start""")
def bed_overlap_check(spark, sf):
    return intervals.disorder(conf(spark, sf))


@query_of("""SELECT q.rid, q.chrom, q.pos, q.ref, q.alt, q.gt, coalesce(array_to_string(list_sort(list(DISTINCT c.label) FILTER (c.label IS NOT NULL)), ','), '') AS labels
FROM query q LEFT JOIN conf c ON q.chrom = c.chrom AND c.start <= q.pos + length(q.ref) - 1 AND c.stop >= q.pos GROUP BY ALL""")
def region_labels(spark, sf):
    sites = query(spark, sf).select("rid", "chrom", "pos", "ref", "alt", "gt").distinct()
    sites = sites.withColumn("start", F.col("pos")).withColumn("stop", F.col("pos") + F.length("ref") - 1)
    labelled = intervals.with_labels(sites, conf(spark, sf), ["rid", "chrom", "pos", "ref", "alt", "gt"])
    return labelled.select("rid", "chrom", "pos", "ref", "alt", "gt", F.array_join("labels", ",").alias("labels"))


# ---- superloci

BLOCKS = """
, b1 AS (SELECT *, CASE WHEN pos <= max(pos + length(ref) - 1) OVER (PARTITION BY chrom ORDER BY pos, length(ref) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 50 THEN NULL ELSE pos END AS new FROM SOURCE)
, blocked AS (SELECT *, max(new) OVER (PARTITION BY chrom ORDER BY pos, length(ref) ROWS UNBOUNDED PRECEDING) AS bs FROM b1)
"""


@query_of(BLOCKS.replace("SOURCE", "query") + "SELECT chrom, bs, count(*) AS n, max(pos + length(ref) - 1) AS be FROM blocked GROUP BY chrom, bs")
def superlocus_segments(spark, sf):
    return blocks.block_table(blocks.superloci(query(spark, sf)))


@query_of(BLOCKS.replace("SOURCE", "query") + """
, t AS (SELECT chrom, bs, count(*) AS n FROM blocked GROUP BY chrom, bs)
SELECT chrom, bs, n, CAST(floor(coalesce(sum(n) OVER (PARTITION BY chrom ORDER BY bs ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 4 / sum(n) OVER (PARTITION BY chrom)) AS BIGINT) AS chunk FROM t""")
def balanced_chunks(spark, sf):
    return blocks.chunks(blocks.superloci(query(spark, sf)), 4)


@query_of(ONE + BLOCKS.replace("SOURCE", "m") + """
, f AS (SELECT chrom, bs, EXISTS (SELECT 1 FROM conf c WHERE c.chrom = blocked.chrom AND c.start <= pos + length(ref) - 1 AND c.stop >= pos) AS inside FROM blocked)
SELECT chrom, bs, bool_or(inside) AND NOT bool_and(inside) AS ts_boundary, bool_and(inside) AS ts_contained FROM f GROUP BY chrom, bs""")
def superlocus_flags(spark, sf):
    """Blocks of the calls of both samples; how often a site is called and what matches there changes no flag."""
    site = ["chrom", "pos", "ref"]
    both = truth(spark, sf).select(*site).unionByName(query(spark, sf).select(*site))
    both = both.withColumn("start", F.col("pos")).withColumn("stop", F.col("pos") + F.length("ref") - 1)
    return blocks.confidence_flags(blocks.superloci(intervals.touched(both, conf(spark, sf), site, "conf")))


@query_of(ONE + BLOCKS.replace("SOURCE", "m") + """
, p AS (SELECT *, min(CASE WHEN bd_query = 'TP' THEN qq_query END) OVER (PARTITION BY chrom, bs) AS least FROM blocked)
SELECT chrom, bs, bd_truth, CASE WHEN bd_truth IS NOT NULL THEN coalesce(CASE WHEN bd_query = 'TP' THEN qq_query END, least) END AS qq_truth, count(*) AS n FROM p GROUP BY ALL""")
def truth_qq_propagation(spark, sf):
    rows = blocks.superloci(matched(spark, sf)).drop("qq_truth")
    return blocks.propagated_qq(rows).groupBy("chrom", "bs", "bd_truth", "qq_truth").agg(F.count("*").alias("n"))


@query_of(ONE + BLOCKS.replace("SOURCE", "m") + """
, a AS (SELECT chrom, bs, array_to_string(list_sort(list(DISTINCT filt) FILTER (NOT no_query)), ',') AS fs FROM blocked GROUP BY chrom, bs)
SELECT b.chrom, b.bs, CASE WHEN b.bd_truth = 'FN' AND b.no_query THEN coalesce(a.fs, '') WHEN b.no_query THEN '' ELSE b.filt END AS filters, count(*) AS n FROM blocked b JOIN a USING (chrom, bs) GROUP BY ALL""")
def filter_propagation(spark, sf):
    """Here truth calls without a query call stand for those that a haplotype match would make TP."""
    rows = blocks.superloci(matched(spark, sf)).withColumn("filters", F.when(F.col("filt_query").isNull(), F.array().cast("array<string>")).otherwise(F.array("filt_query")))
    rows = rows.withColumn("bd_truth", F.when((F.col("bd_truth") == "FN") & F.col("bd_query").isNull(), "TP").otherwise("-"))
    return blocks.propagated_filters(rows).groupBy("chrom", "bs", F.array_join("filters", ",").alias("filters")).agg(F.count("*").alias("n"))


# ---- genotypes and decisions


@query_of("""SELECT CASE WHEN g1 < 0 AND g2 < 0 THEN 'nocall' WHEN least(g1, g2) < 0 THEN 'halfcall' WHEN greatest(g1, g2) = 0 THEN 'homref' WHEN least(g1, g2) = 0 THEN 'het' WHEN g1 = g2 THEN 'homalt' ELSE 'hetalt' END AS gt_class, count(*) AS n
FROM (SELECT CAST(l_linenumber % 4 - 1 AS INTEGER) AS g1, CAST(l_partkey % 4 - 1 AS INTEGER) AS g2 FROM lineitem) GROUP BY 1""")
def gt_class_counts(spark, sf):
    li = read(spark, sf, "lineitem")
    gt = F.array((F.col("l_linenumber") % 4 - 1).cast("int"), (F.col("l_partkey") % 4 - 1).cast("int"))
    return li.groupBy(C.genotype_class(gt).alias("gt_class")).agg(F.count("*").alias("n"))


@query_of("""
, one AS (SELECT chrom, pos, 1 AS side, list_sort(list(DISTINCT alt)) AS alts, max(gt) AS gt, min(ref) AS ref FROM truth GROUP BY chrom, pos
  UNION ALL SELECT chrom, pos, 2, list_sort(list(DISTINCT alt)), max(gt), min(ref) FROM query GROUP BY chrom, pos)
, both_ AS (SELECT coalesce(t.chrom, q.chrom) AS chrom, coalesce(t.pos, q.pos) AS pos, t.alts AS ta, q.alts AS qa, t.gt AS tg, q.gt AS qg FROM (SELECT * FROM one WHERE side = 1) t FULL OUTER JOIN (SELECT * FROM one WHERE side = 2) q ON t.chrom = q.chrom AND t.pos = q.pos)
, d AS (SELECT CASE WHEN qa IS NULL THEN 'FN:missing' WHEN ta IS NULL THEN 'FP:missing' WHEN ta = qa AND tg = qg THEN 'TP:match' WHEN ta = qa THEN 'FP:gtmismatch' WHEN list_has_any(ta, qa) THEN 'FP:alpartial' ELSE 'FP:almismatch' END AS d FROM both_)
SELECT split_part(d, ':', 1) AS type, split_part(d, ':', 2) AS kind, CASE WHEN d = 'TP:match' THEN 'gm' WHEN d = 'FP:gtmismatch' THEN 'am' WHEN d IN ('FP:alpartial', 'FP:almismatch') THEN 'lm' ELSE '.' END AS bk, count(*) AS n FROM d GROUP BY d""")
def simple_compare_decisions(spark, sf):
    side = lambda df, p: df.groupBy("chrom", "pos").agg(F.array_sort(F.collect_set("alt")).alias(f"{p}_alts"), F.max("gt").alias(f"{p}_gt"))
    rows = side(truth(spark, sf), "t").join(side(query(spark, sf), "q"), ["chrom", "pos"], "full_outer")
    alleles = lambda p: F.when(F.col(f"{p}_gt") == "het", F.concat(F.array(F.lit("ref")), F.col(f"{p}_alts"))).otherwise(F.coalesce(f"{p}_alts", F.array().cast("array<string>")))
    d = C.decision(F.col("t_gt").isNotNull(), F.col("q_gt").isNotNull(), alleles("t"), alleles("q"), F.col("t_gt"), F.col("q_gt"), F.lit(False))
    rows = rows.select(d.alias("d")).select("d.type", "d.kind")
    return rows.withColumn("bk", C.sub_kind(F.col("type"), F.col("kind"))).groupBy("type", "kind", "bk").agg(F.count("*").alias("n"))


# ---- ROC

OBS = ONE + """
, obs AS (SELECT 'TP' AS decision, qq_query AS level, bd_truth, bd_query FROM m WHERE bd_truth = 'TP' UNION ALL SELECT 'FN', coalesce(qq_query, 0), bd_truth, bd_query FROM m WHERE bd_truth = 'FN'
  UNION ALL SELECT CASE WHEN bd_query = 'TP' THEN 'TP2' ELSE 'FP' END, qq_query, bd_truth, bd_query FROM m WHERE bd_query IS NOT NULL)
"""


def observations(spark, sf) -> DataFrame:
    """What a call pair says of truth and of query, as rows: the pairs are matched once."""
    of_truth = F.struct(F.col("bd_truth").alias("decision"), F.when(F.col("bd_truth") == "TP", F.col("qq_query")).otherwise(F.coalesce("qq_query", F.lit(0.0))).alias("level"))
    of_query = F.struct(F.when(F.col("bd_query") == "TP", "TP2").otherwise("FP").alias("decision"), F.col("qq_query").alias("level"))
    both = F.array_compact(F.array(F.when(F.col("bd_truth").isNotNull(), of_truth), F.when(F.col("bd_query").isNotNull(), of_query)))
    return matched(spark, sf).select(F.inline(both)).withColumn("n", F.lit(1)).withColumn("filter", F.lit("ALL"))


ROC = OBS + """
, per AS (SELECT level, count(*) FILTER (decision = 'TP') AS a, count(*) FILTER (decision = 'FN') AS b, count(*) FILTER (decision = 'TP2') AS c, count(*) FILTER (decision = 'FP') AS d FROM obs GROUP BY level)
, curve AS (SELECT 'ALL' AS filter, level, CAST(sum(a) OVER () - sum(a) OVER w AS BIGINT) AS tp, CAST(sum(b) OVER () + sum(a) OVER w AS BIGINT) AS fn, CAST(sum(c) OVER () - sum(c) OVER w AS BIGINT) AS tp2,
  CAST(sum(d) OVER () - sum(d) OVER w AS BIGINT) AS fp, CAST(0 AS BIGINT) AS unk, CAST(sum(d) OVER w AS BIGINT) AS n FROM per WINDOW w AS (ORDER BY level ROWS UNBOUNDED PRECEDING))
"""


@query_of(ROC + "SELECT * FROM curve")
def roc_cumulative(spark, sf):
    return strata.cumulative(observations(spark, sf), ["filter"])


@query_of(ROC.replace("WITH calls", "WITH RECURSIVE calls") + """
, kept(level) AS (SELECT min(level) FROM curve UNION ALL SELECT (SELECT min(level) FROM curve WHERE abs(level - kept.level) > 2.5 AND level > kept.level) FROM kept WHERE kept.level IS NOT NULL)
SELECT * FROM curve WHERE level IN (SELECT level FROM kept)""")
def roc_thinned(spark, sf):
    curve = written(strata.cumulative(observations(spark, sf), ["filter"]), "curve")  # a row per level, read twice
    return strata.thinned(curve, ["filter"], 2.5)


ORACLE["roc_thinned"] = ORACLE["roc_thinned"].replace("WITH calls", "WITH RECURSIVE calls", 1)


@query_of("""VIEWS WITH r AS (SELECT n_chars AS v, CASE WHEN toxic = 1 THEN 'TP' WHEN quality = 1 THEN 'FP' ELSE 'FN' END AS tag FROM documents JOIN labels USING (doc_id))
, per AS (SELECT v, count(*) FILTER (tag = 'TP') AS a, count(*) FILTER (tag = 'FP') AS b, count(*) FILTER (tag = 'FN') AS c FROM r GROUP BY v)
SELECT v, CAST(sum(a) OVER w AS BIGINT) AS tp, CAST(sum(b) OVER w AS BIGINT) AS fp, CAST(sum(c) OVER () + sum(a) OVER () - sum(a) OVER w AS BIGINT) AS fn FROM per WINDOW w AS (ORDER BY v ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""")
def roc_curve_simple(spark, sf):
    rows = read(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("v")).join(read(spark, sf, "labels"), "doc_id")
    tag = F.when(F.col("toxic") == 1, "TP").when(F.col("quality") == 1, "FP").otherwise("FN")
    return strata.simple_roc(rows.withColumn("tag", tag), "v", "tag")


# ---- somatic

TAGGED = """
, marked AS (SELECT q.*, (SELECT max(CASE WHEN c.label LIKE '%1' THEN 1 ELSE 0 END) FROM conf c WHERE c.chrom = q.chrom AND c.start <= q.pos + length(q.ref) - 1 AND c.stop >= q.pos) AS hit
  FROM (SELECT DISTINCT chrom, pos, ref, alt FROM query ANTI JOIN truth USING (chrom, pos, ref, alt)) q)
, tagged AS (SELECT *, CASE WHEN hit = 1 THEN 'FP' WHEN hit = 0 THEN 'AMBI' ELSE 'UNK' END AS tag FROM marked)
"""


def tagged(spark, sf) -> DataFrame:
    regions = conf(spark, sf).withColumn("label", F.when(F.col("label").endswith("1"), "FP").otherwise("other"))
    return somatic.classified(matching.intersection(truth(spark, sf), query(spark, sf))[2], regions, ALLELE, count_unknown=True)


@query_of(TAGGED + f"SELECT {TYPE} AS type, tag, count(*) AS n FROM tagged GROUP BY ALL")
def somatic_tags(spark, sf):
    return tagged(spark, sf).groupBy(C.allele_type(F.col("ref"), F.col("alt")).alias("type"), "tag").agg(F.count("*").alias("n"))


@query_of(TAGGED + f", size AS (SELECT sum(stop - start + 1) AS bases FROM conf WHERE label LIKE '%1'), fp AS (SELECT {TYPE} AS type, count(*) FILTER (tag = 'FP') AS fp FROM tagged GROUP BY 1) SELECT type, fp, CAST(bases AS BIGINT) AS bases, round(1e6 * fp / bases, 4) AS fp_rate FROM fp, size")
def somatic_fp_rate(spark, sf):
    bases = conf(spark, sf).where(F.col("label").endswith("1")).agg(F.sum(F.col("stop") - F.col("start") + 1).alias("bases"))  # one row
    counts = tagged(spark, sf).groupBy(C.allele_type(F.col("ref"), F.col("alt")).alias("type")).agg(F.count(F.when(F.col("tag") == "FP", 1)).alias("fp"))
    return counts.join(F.broadcast(bases)).select("type", "fp", "bases", F.round(somatic.fp_rate(F.col("fp"), F.col("bases")), 4).alias("fp_rate"))


@query_of(ONE + """
, v AS (SELECT coalesce(qq_query, qq_truth0) / 50.0 AS af, CASE WHEN bd_truth = 'TP' THEN 'TP' WHEN bd_truth = 'FN' THEN 'FN' ELSE 'FP' END AS tag FROM m)
, bins AS (SELECT * FROM (VALUES (0, 0.0, 0.2), (1, 0.2, 0.5), (2, 0.5, 0.7), (3, 0.7, 1.00000001)) AS b(bin, lo, hi))
SELECT CAST(bin AS INTEGER) AS bin, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi, count(*) FILTER (tag = 'TP') AS tp, count(*) FILTER (tag = 'FN') AS fn, count(*) FILTER (tag = 'FP') AS fp FROM v JOIN bins ON af >= lo AND af < hi GROUP BY ALL""")
def af_bins(spark, sf):
    rows = matched(spark, sf)
    tag = F.when(F.col("bd_truth") == "TP", "TP").when(F.col("bd_truth") == "FN", "FN").otherwise("FP")
    return somatic.af_bin_counts(rows, F.coalesce("qq_query", "qq_truth") / 50.0, tag, [0.2, 0.3])


@query_of(f"""
, t AS (SELECT DISTINCT {KEYS} FROM truth), q AS (SELECT DISTINCT {KEYS} FROM query)
, f AS (SELECT 'TP' AS tag, *, length(alt) - length(ref) AS indel, NULL AS qbase FROM t SEMI JOIN q USING ({KEYS})
  UNION ALL SELECT 'FN', *, length(alt) - length(ref), NULL FROM t ANTI JOIN q USING ({KEYS}) UNION ALL SELECT 'FP', *, NULL, ref FROM q ANTI JOIN t USING ({KEYS}))
SELECT tag, count(*) AS n, count(indel) AS n_indel, count(qbase) AS n_qbase, CAST(sum(indel) AS BIGINT) AS indels FROM f GROUP BY tag""")
def union_feature_table(spark, sf):
    tp, fn, fp = matching.intersection(truth(spark, sf), query(spark, sf))
    with_size = lambda df: df.withColumn("indel", F.length("alt") - F.length("ref"))
    rows = somatic.feature_table(TP=with_size(tp), FN=with_size(fn), FP=fp.withColumn("qbase", F.col("ref")))
    return rows.groupBy("tag").agg(F.count("*").alias("n"), F.count("indel").alias("n_indel"), F.count("qbase").alias("n_qbase"), F.sum("indel").alias("indels"))


def recall_intervals(spark, sf):
    """No SQL: the interval needs a quantile of the beta distribution."""
    counts = strata.decision_counts(matched(spark, sf), ["type"]).select("type", "truth_total", "truth_tp")
    return somatic.with_interval(counts, "truth_tp", "truth_total", "recall")


QUERIES["recall_intervals"] = recall_intervals


# ---- scalar work


@query_of("SELECT regexp_replace(regexp_replace(CAST(l_suppkey % 30 AS VARCHAR), '^([0-9XYM])', 'chr\\1'), '^chrMT$', 'chrM') AS chrom, count(*) AS n FROM lineitem GROUP BY 1".join(["VIEWS ", ""]))
def chr_prefix_fix(spark, sf):
    li = read(spark, sf, "lineitem")
    return li.groupBy(C.with_chr((F.col("l_suppkey") % 30).cast("string")).alias("chrom")).agg(F.count("*").alias("n"))


@query_of("SELECT chrom, count(*) AS n FROM calls WHERE filt IN ('PASS', '.') GROUP BY chrom")
def filter_pass_only(spark, sf):
    return calls(spark, sf).where(C.passes(F.array("filt"))).groupBy("chrom").agg(F.count("*").alias("n"))


@query_of("SELECT chrom, count(*) AS n FROM calls WHERE NOT list_has_any([filt, 'q' || CAST(pos % 3 AS VARCHAR)], ['LowQual', 'q1']) GROUP BY chrom")
def filter_named(spark, sf):
    filters = F.array("filt", F.concat(F.lit("q"), (F.col("pos") % 3).cast("string")))
    return calls(spark, sf).where(C.passes_named(filters, ["LowQual", "q1"])).groupBy("chrom").agg(F.count("*").alias("n"))


@query_of("SELECT pos % 7 AS k, count(*) AS n, CAST(sum(CAST(pos % 100 AS BIGINT)) AS BIGINT) AS dp, count(*) FILTER (filt = 'LowQual') AS low FROM calls GROUP BY 1")
def info_map_parse(spark, sf):
    info = F.concat(F.lit("DP="), (F.col("pos") % 100).cast("string"), F.when(F.col("filt") == "LowQual", ";LOW").otherwise(""), F.lit(";K="), (F.col("pos") % 7).cast("string"))
    m = calls(spark, sf).select(C.info_map(info).alias("m"))
    return m.groupBy(F.col("m")["K"].cast("long").alias("k")).agg(F.count("*").alias("n"), F.sum(F.expr("try_cast(m['DP'] as bigint)")).alias("dp"), F.count(F.when(F.col("m")["LOW"] == "true", 1)).alias("low"))


@query_of("SELECT gt, CAST(sum(pos % 50) AS BIGINT) AS dp, count(*) AS n, count(*) FILTER (filt = 'PASS') AS with_gq FROM calls GROUP BY gt")
def format_map_parse(spark, sf):
    """Sample values by FORMAT key; the last value is missing in calls that fail."""
    values = F.concat_ws(":", "gt", (F.col("pos") % 50).cast("string"), F.when(F.col("filt") == "PASS", "99"))
    m = calls(spark, sf).select(C.format_map(F.lit("GT:DP:GQ"), values).alias("m"))
    return m.groupBy(F.col("m")["GT"].alias("gt")).agg(F.sum(F.col("m")["DP"].cast("long")).alias("dp"), F.count("*").alias("n"), F.count(F.when(F.col("m")["GQ"] != ".", 1)).alias("with_gq"))


@query_of("SELECT filt AS caller_filter, gt, count(*) AS n, round(avg(qq), 6) AS mean_qq, min(qq) AS min_qq, max(qq) AS max_qq FROM query GROUP BY ALL")
def caller_filter_strata(spark, sf):
    return query(spark, sf).groupBy(F.col("filt").alias("caller_filter"), "gt").agg(F.count("*").alias("n"), F.round(F.avg("qq"), 6).alias("mean_qq"), F.min("qq").alias("min_qq"), F.max("qq").alias("max_qq"))


@query_of("SELECT chrom, count(*) AS n, count(*) FILTER (length(ref) = 1 AND length(alt) = 1) AS snps, count(*) FILTER (gt = 'het') AS het, count(*) FILTER (before >= pos) AS overlaps FROM (SELECT *, lag(pos + length(ref) - 1) OVER (PARTITION BY chrom ORDER BY pos, ref, alt, rid) AS before FROM calls) GROUP BY chrom")
def sanity_counts(spark, sf):
    """Overlaps with the call before, which is looked up within bins of positions; a bin's first call meets the last one of the bins before."""
    rows = calls(spark, sf).select("chrom", "pos", "ref", "alt", "rid", "gt", (F.col("pos") + F.length("ref") - 1).alias("end"), F.floor(F.col("pos") / (1 << 20)).alias("bin"))
    order = F.struct("pos", "ref", "alt", "rid")
    last = rows.groupBy("chrom", "bin").agg(F.max_by("end", order).alias("end"))
    carried = last.select("chrom", "bin", F.lag("end").over(Window.partitionBy("chrom").orderBy("bin")).alias("carried"))
    before = F.coalesce(F.lag("end").over(Window.partitionBy("chrom", "bin").orderBy("pos", "ref", "alt", "rid")), "carried")
    rows = rows.join(carried, ["chrom", "bin"]).withColumn("before", before)
    return rows.groupBy("chrom").agg(F.count("*").alias("n"), F.count(F.when((F.length("ref") == 1) & (F.length("alt") == 1), 1)).alias("snps"), F.count(F.when(F.col("gt") == "het", 1)).alias("het"), F.count(F.when(F.col("before") >= F.col("pos"), 1)).alias("overlaps"))


@query_of("""VIEWS WITH e AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM events)
, s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS start_ts, max(ts) AS last_ts, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k""")
def session_superlocus(spark, sf):
    return sessions(read(spark, sf, "events"))


# ---- normalisation and haplotypes


@query_of("""
, r AS (SELECT DISTINCT chrom, pos, ref, alt, substr(ref, 1, 1) AS b FROM calls)
SELECT chrom, ref AS ref0, alt AS alt0, pos AS pos0, CASE WHEN length(ref) = length(alt) THEN pos WHEN length(alt) > length(ref) AND b = 'G' THEN pos WHEN length(ref) > length(alt) AND b = 'T' THEN pos ELSE pos + 1 END AS pos,
  CASE WHEN length(ref) = length(alt) THEN ref WHEN length(ref) > length(alt) THEN repeat('T', length(ref) - 1) ELSE '' END AS ref,
  CASE WHEN length(ref) = length(alt) THEN alt WHEN length(alt) > length(ref) THEN repeat('G', length(alt) - 1) ELSE '' END AS alt FROM r""")
def trim_alleles(spark, sf):
    alleles = calls(spark, sf).select("chrom", "pos", "ref", "alt").distinct().withColumns({"pos0": F.col("pos"), "ref0": F.col("ref"), "alt0": F.col("alt")})
    return normalise.trimmed(alleles).select("chrom", "pos0", "ref0", "alt0", "pos", "ref", "alt")


@query_of(f"""
, r AS (SELECT chrom, pos, {TYPE} AS type, coalesce(string_agg(DISTINCT alt, ',' ORDER BY alt), '') AS alts, count(DISTINCT alt) AS n FROM calls GROUP BY ALL)
SELECT type, n AS n_alleles, count(*) AS sites, count(DISTINCT alts) AS kinds FROM r GROUP BY ALL""")
def alleles_by_location(spark, sf):
    sites = calls(spark, sf).groupBy("chrom", "pos", C.allele_type(F.col("ref"), F.col("alt")).alias("type")).agg(F.array_sort(F.collect_set("alt")).alias("a"))
    return sites.groupBy("type", F.size("a").cast("long").alias("n_alleles")).agg(F.count("*").alias("sites"), F.countDistinct(F.array_join("a", ",")).alias("kinds"))


@query_of(ONE + f"""
, k AS (SELECT {TYPE} AS type, filt, bd_query FROM m WHERE bd_query IS NOT NULL)
, s AS (SELECT 'a:' || type || ':ALL' AS key, bd_query FROM k UNION ALL SELECT 'a:' || type || ':PASS', bd_query FROM k WHERE filt = 'PASS' UNION ALL SELECT 'f:' || type || ':' || filt, bd_query FROM k WHERE filt <> 'PASS')
SELECT key, count(*) FILTER (bd_query = 'TP') AS tp2, count(*) FILTER (bd_query = 'FP') AS fp FROM s GROUP BY key""")
def roc_filter_keys(spark, sf):
    failed = F.col("filt") != "PASS"
    key = lambda kind, what: F.concat(F.lit(kind), "type", F.lit(":"), what)
    keys = F.filter(F.array(key("a:", F.lit("ALL")), F.when(~failed, key("a:", F.lit("PASS"))), F.when(failed, key("f:", F.col("filt")))), lambda x: x.isNotNull())
    rows = matched(spark, sf).where("bd_query is not null").select(F.explode(keys).alias("key"), "bd_query")
    return rows.groupBy("key").agg(F.count(F.when(F.col("bd_query") == "TP", 1)).alias("tp2"), F.count(F.when(F.col("bd_query") == "FP", 1)).alias("fp"))


def haplotype_outcomes(spark, sf):
    """No SQL: haplotypes are enumerated."""
    return haplotypes.compared(truth(spark, sf), query(spark, sf), reference(spark, sf)).groupBy("outcome").agg(F.count("*").alias("blocks"), F.sum("n_truth").alias("truth_calls"), F.sum("n_query").alias("query_calls"))


def left_shift_alleles(spark, sf):
    """Insertions and deletions of the query as far left as the reference allows."""
    alleles = query(spark, sf).where(F.length("ref") != F.length("alt")).select("chrom", "pos", "ref", "alt").distinct().withColumn("pos0", F.col("pos"))
    return normalise.fully_left_shifted(alleles, reference(spark, sf)).select("chrom", "pos0", "pos", "ref", "alt")


QUERIES |= {"haplotype_outcomes": haplotype_outcomes, "left_shift_alleles": left_shift_alleles}
QUERIES |= germline.QUERIES | block_matching.QUERIES
ORACLE |= germline.ORACLE | block_matching.ORACLE | {"left_shift_alleles": germline.LEFT_SHIFT_SQL}

"""Operator 5: secret scans with character Markov models, by DataFrame functions only.

Three patterns give base spans (assignments, access keys, long hexadecimal runs).  The method adds spans:
runs of 16 or more key-like characters whose mean log-likelihood ratio per character pair, random strings
against ordinary identifiers, exceeds a threshold.  Both models count character pairs over the labelled
samples of the whole table: runs that a pattern names as a secret are random, runs without a digit and runs of
digits alone ordinary; the ratio alone decides.  The counts (at most 80 x 80 x 2) are all that reaches the driver.

Nulls count as empty texts and have no spans.  Positions are code points, ends exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callmark.llm.common import let, own_name, table

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"  # runs that are too short have no longer part that matches
RUN = r"[A-Za-z0-9+/_=-]{16,}"
KEYWORD = r"^(?i:(password|passwd|secret|token|api_?key))=+"
KINDS = ("assign", "access", "hex", "markov")
#: Codes of the run's characters lie from FIRST on, within a span of WIDTH.
FIRST, WIDTH = 43, 80
#: Nats per pair of characters above which a run is a secret.
THRESHOLD = 0.9
#: Pseudo-count per pair of characters in ordinary identifiers; share of the even distribution over KEYS characters in random strings.
SMOOTH, EVEN, KEYS = 0.05, 0.5, 64

SPAN = "array<struct<start:int,kind:int,stop:int>>"


def _code(run: Column, at: Column) -> Column:
    return F.ascii(F.substr(run, at, F.lit(1))) - FIRST


def _pairs(run: Column) -> Column:
    """Index of each pair of neighbouring characters."""
    return F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: _code(run, i) * WIDTH + _code(run, i + 1))


def samples(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Labelled samples of the whole table: value, random (boolean)."""
    runs = docs.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0))).alias("run"))
    value = F.regexp_replace("run", KEYWORD, "")
    secret = F.col("run").rlike(KEYWORD) | F.col("run").rlike(f"^(?:{ACCESS}|{HEX})$")
    return runs.select(value.alias("value"), secret.alias("random")).where((F.length("value") > 1) & (F.col("random") | ~F.col("value").rlike("[0-9]") | F.col("value").rlike("^[0-9]+$")))


def train(labelled: DataFrame) -> list[float]:
    """log P(b | a, random) - log P(b | a, ordinary) at a * WIDTH + b, from value and random."""
    pairs = labelled.select("random", F.explode(_pairs(F.col("value"))).alias("pair"))
    counted = pairs.groupBy("random", "pair").agg(F.count("*").alias("n")).collect()  # at most 2 x WIDTH x WIDTH rows
    size = WIDTH * WIDTH
    n = {True: [0.0] * size, False: [SMOOTH] * size}
    for r in counted:
        if r["random"] is not None and 0 <= r["pair"] < size:
            n[r["random"]][r["pair"]] += r["n"]
    rows = {k: [sum(v[a * WIDTH : (a + 1) * WIDTH]) or 1.0 for a in range(WIDTH)] for k, v in n.items()}
    share = lambda k, i: n[k][i] / rows[k][i // WIDTH]
    return [math.log((1 - EVEN) * share(True, i) + EVEN / KEYS) - math.log(share(False, i)) for i in range(size)]


def _table(model: list[float]) -> Column:
    """The model as one constant array, of a size that does not grow with the data."""
    return F.expr(f"cast(split('{' '.join(f'{x:.3f}' for x in model)}', ' ') as array<double>)")


def ratio(run: Column, model: Column) -> Column:
    """Mean log-likelihood ratio of a run."""
    total = F.aggregate(_pairs(run), F.lit(0.0), lambda a, i: a + F.element_at(model, i + 1))
    return total / (F.length(run) - 1)


def _spans(text: Column, pattern: str, kind: int, keep, group: int = 0) -> Column:
    """Spans of the pattern's matches for whose group `keep` holds; only rows that match do the work."""
    nothing = F.array().cast(SPAN)
    start = F.struct(F.lit(0).alias("at"), nothing.alias("found"))
    hits = F.struct(
        F.split(text, pattern, -1).alias("between"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("groups"),
    )

    def walk(m: Column) -> Column:
        def step(a: Column, i: Column) -> Column:
            first = a["at"] + F.length(F.get(m["between"], i))
            stop = first + F.length(F.get(m["hits"], i))
            span = F.array(F.struct(first.alias("start"), F.lit(kind).alias("kind"), stop.alias("stop")))
            return F.struct(stop.alias("at"), F.when(keep(F.get(m["groups"], i)), F.concat(a["found"], span)).otherwise(a["found"]).alias("found"))

        return F.aggregate(F.sequence(F.lit(0), F.size(m["hits"]) - 1), start, step, lambda a: a["found"])

    return F.when(text.rlike(pattern), let(hits, walk)).otherwise(nothing)


def find_secrets(docs: DataFrame, model: list[float], threshold: float = THRESHOLD, text_col: str = "text", names: tuple[str, str] = ("base_spans", "added_spans")) -> DataFrame:
    """docs with base_spans and added_spans (or other names): arrays of (start, kind, stop) in order; kind is a place in KINDS.

    An added span may overlap base spans; one that a base span covers is left out.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.concat(
        _spans(text, ASSIGN, 0, lambda value: F.length(value) >= 6, 2),
        _spans(text, ACCESS, 1, lambda run: F.lit(True)),
        _spans(text, HEX, 2, lambda run: F.lit(True)),
    )
    runs = F.regexp_extract_all(text, F.lit(RUN), F.lit(0))
    weights = _table(model)

    def secret(run: Column) -> Column:
        return ratio(run, weights) > threshold

    # a single pass decides which rows have such runs at all; their places are then found in those rows alone
    base_spans, added_spans = names
    some = own_name(docs, "_some")
    suspect = docs.withColumn(base_spans, F.array_sort(base)).withColumn(some, F.exists(runs, secret))
    found = F.when(F.col(some), _spans(text, RUN, 3, secret)).otherwise(F.array().cast(SPAN))
    covered = lambda s: F.exists(base_spans, lambda b: (b["start"] <= s["start"]) & (s["stop"] <= b["stop"]))
    return suspect.withColumn(added_spans, F.filter(found, lambda s: ~covered(s))).drop(some)


def _written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "[secret]", text_col: str = "text", names: tuple[str, str] = ("base_spans", "added_spans")) -> DataFrame:
    """docs with base_spans and added_spans, without those columns; each span of the text (spans that overlap as one) replaced by a mark."""
    text = F.col(text_col)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        kept = F.when(s["start"] >= a["at"], F.concat(F.substr(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(a["at"], s["stop"]).alias("at"), F.concat(a["out"], kept).alias("out"))

    spans = F.array_sort(F.concat(*names))
    clean = F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1, F.length(text))))
    return docs.withColumn(text_col, F.when(F.size(spans) > 0, clean).otherwise(text)).drop(*names)


def without_secrets(docs: DataFrame, model: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """docs with every secret replaced by a mark; other columns as they are, whatever their names."""
    names = own_name(docs, "base_spans"), own_name(docs, "added_spans")
    return redact(find_secrets(docs, model, threshold, names=names), names=names)


def op5_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = find_secrets(docs, train(samples(docs)))
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_written(F.col("base_spans")), 256).alias("base_sha256"),
        _written(F.array_sort(F.concat("base_spans", "added_spans"))).alias("spans"),
        F.size("added_spans").cast("long").alias("n_markov"),
    )

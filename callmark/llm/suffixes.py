"""Operator 2: suffix-array deduplication with a sparse suffix array.

Of the suffixes of a document (one per word) only those are kept whose first K words have the least hash of
some window of WINDOW neighbouring suffixes.  Each passage of K + WINDOW - 1 = 50 words has one such suffix,
which its words alone decide, and the passages of one suffix follow each other: they make a span.  Spans whose
suffix shares its first K words with one of another document are compared: equal spans are counted as one,
different ones of the same K words passage by passage.  Nothing depends on how often a key stands in the table.

Passages that stand in two documents are repeats, joined where they overlap or touch.  The occurrence in the
least doc_id is the first one, decided for each passage of 50 words.  White space parts words and is otherwise
ignored; letters count as they are.  Nulls, empty texts and rows without a doc_id have no repeats; passages
that repeat only within one document are none; rows with the same doc_id count as one document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callmark.llm.common import materialise, own_name, table
from callmark.llm.words import mixed, sequences, word_hashes

K, WINDOW, LEAST = 24, 27, 50
#: A key with more than one in so many rows is dealt over several tasks.
FREQUENT = 2000
RUNS = "array<struct<lo:int,hi:int,least:bigint>>"


def selected(keys: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the least key (the leftmost of equal ones) of some window."""
    if len(keys) <= window:
        return np.array([int(keys.argmin())]) if len(keys) else np.zeros(0, int)
    return np.unique(np.lib.stride_tricks.sliding_window_view(keys, window).argmin(axis=1) + np.arange(len(keys) - window + 1))


def owned(keys: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the least key (the leftmost of equal ones) of some window; the first window of each, and how many there are."""
    if len(keys) < window:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, int)
    least = np.lib.stride_tricks.sliding_window_view(keys, window).argmin(axis=1) + np.arange(len(keys) - window + 1)
    return np.unique(least, return_index=True, return_counts=True)


def span_hashes(passages: np.ndarray, lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Hashes of the words of spans: their first and last passages overlap and so hold all of them."""
    ends = mixed(passages[lo] * np.uint64(0x9E3779B97F4A7C15) + n.astype(np.uint64)) + passages[lo + n - 1]
    return mixed(ends).view(np.int64)


def joined_by(left: DataFrame, groups: DataFrame, on: list[str]) -> DataFrame:
    """left joined with groups (one row per key of columns `on`, and n, how many rows of left have it); the rows of very frequent keys are dealt over many tasks.

    A key is very frequent if it has more than one in FREQUENT of all rows, so that there are fewer than FREQUENT.
    """
    total = groups.agg(F.sum("n")).first()[0] or 0
    share = max(1, total // FREQUENT)
    often = groups.where(F.col("n") > share).select(*on, F.ceil(F.col("n") / share).cast("int").alias("_parts"))
    part = F.coalesce(F.pmod(F.xxhash64(*left.columns), F.col("_parts")), F.lit(0).cast("long"))
    dealt = left.join(F.broadcast(often), on, "left").withColumn("_part", part).drop("_parts")
    spread = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_parts") - 1, F.lit(0)).cast("long")))
    right = groups.join(F.broadcast(often), on, "left").withColumn("_part", spread).drop("_parts")
    return dealt.join(right.drop("n"), [*on, "_part"]).drop("_part")


def runs_of(found: Column) -> Column:
    """Runs (lo, hi exclusive, least) of an array of (i, least) in order."""

    def step(runs: Column, p: Column) -> Column:
        last = F.try_element_at(runs, F.lit(-1))
        longer = F.struct(last["lo"].alias("lo"), (p["i"] + 1).alias("hi"), last["least"].alias("least"))
        new = F.struct(p["i"].alias("lo"), (p["i"] + 1).alias("hi"), p["least"].alias("least"))
        goes_on = (F.size(runs) > 0) & (last["hi"] == p["i"]) & (last["least"] == p["least"])
        return F.when(goes_on, F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(longer))).otherwise(F.concat(runs, F.array(new)))

    return F.aggregate(found, F.array().cast(RUNS), step)


def repeats(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, first (boolean: the occurrence in the least doc_id), start and stop (words, stop exclusive) of every repeat.

    Passages of a document that are first ones and those that are not are joined apart, and may overlap.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs = b.column("doc_id").to_numpy()
            for row, h, bounds in word_hashes(b.column("text")):
                keys, passages = sequences(h, K), sequences(h, least)
                doc, place, first, count = [], [], [], []
                for i, (start, stop) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
                    at, lo, n = owned(keys[start : max(start, stop - K + 1)], least - K + 1)
                    doc.append(np.full(len(at), docs[row + i], np.int64))
                    place.append(at + start)
                    first.append(lo + start)
                    count.append(n)
                doc, place, first, count = (np.concatenate(x) for x in (doc, place, first, count))
                lo = first - bounds[np.searchsorted(bounds, first, "right") - 1]
                span = span_hashes(passages, first, count) if len(first) else np.zeros(0, np.int64)
                columns = [doc, keys[place].view(np.int64) if len(place) else np.zeros(0, np.int64), lo.astype(np.int32), count.astype(np.int32), span]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc_id", "key", "lo", "passages", "span"])

    suffixes = rows.mapInArrow(keep, "doc_id long, key long, lo int, passages int, span long")
    groups = suffixes.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("_least"), F.max("doc_id").alias("_most"), (F.min("span") != F.max("span")).alias("several"))
    groups = materialise(groups.where("_least <> _most").select("key", "n", "several"), "shared-suffixes")
    met = materialise(joined_by(suffixes, groups, ["key"]), "met-suffixes")
    one = F.min(F.struct("doc_id", "lo", "passages")).alias("one")
    spans = met.groupBy("key", "span").agg(F.count("*").alias("n"), one, F.max("doc_id").alias("most"), F.first("several").alias("several"))
    spans = materialise(spans.select("key", "span", "n", "one.*", "most", "several"), "spans")

    # spans of a key that differ are compared by their passages, taken from the document that stands for the span
    of_doc = spans.where("several").groupBy("doc_id").agg(F.collect_list(F.struct("key", "span", "n", "lo", "passages", "most")).alias("found"))  # no more than a document has words

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "span", "n", "doc_id", "most", "ahead"]
        for b in batches:
            docs, found_of = b.column("doc_id").to_pylist(), b.column("found")
            for row, h, bounds in word_hashes(b.column("text")):
                out: dict[str, list] = {c: [] for c in names}
                for i, (start, stop) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
                    ahead = sequences(h[start:stop], least)
                    found = [f for f in found_of[row + i].as_py() if f["lo"] + f["passages"] <= len(ahead)]
                    if not found:
                        continue
                    spans = span_hashes(ahead, np.array([f["lo"] for f in found], int), np.array([f["passages"] for f in found], int))
                    for f, span in zip(found, spans.tolist()):
                        if span != f["span"]:  # a repeated row with another text
                            continue
                        out["doc_id"].append(docs[row + i])
                        for c in ("key", "span", "n", "most"):
                            out[c].append(f[c])
                        out["ahead"].append(ahead[f["lo"] : f["lo"] + f["passages"]].view(np.int64))
                if out["key"]:
                    yield pa.RecordBatch.from_arrays([pa.array(out[c], pa.list_(pa.int64()) if c == "ahead" else pa.int64()) for c in names], names=names)

    compared = rows.join(of_doc, "doc_id").mapInArrow(passages, "key long, span long, n long, doc_id long, most long, ahead array<long>")
    compared = materialise(compared, "compared-spans")
    each = compared.select("key", "span", F.col("n").alias("rows"), "doc_id", "most", F.posexplode("ahead").alias("i", "ahead"))
    shared = each.groupBy("key", "ahead").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.max("most").alias("_most"))
    shared = materialise(shared.where("least <> _most").drop("_most"), "shared-passages")
    found = joined_by(each.select("key", "ahead", "span", "rows", "i"), shared, ["key", "ahead"])
    found = found.groupBy("key", "span").agg(F.max("rows").alias("n"), F.array_sort(F.collect_set(F.struct("i", "least"))).alias("_found"))
    alone = F.array(F.struct(F.lit(0).alias("lo"), F.col("passages").alias("hi"), F.col("doc_id").alias("least")))
    told = spans.where("not several").select("key", "span", "n", alone.cast(RUNS).alias("runs")).unionByName(found.select("key", "span", "n", runs_of(F.col("_found")).alias("runs")))
    told = joined_by(met.select("key", "span", "doc_id", "lo"), materialise(told, "told-spans"), ["key", "span"])
    matches = told.select("doc_id", "lo", F.explode("runs").alias("run"))
    matches = matches.select("doc_id", (F.col("doc_id") == F.col("run.least")).alias("first"), (F.col("lo") + F.col("run.lo")).alias("start"), (F.col("lo") + F.col("run.hi") - 1 + least).alias("stop"))
    # matches of a document that overlap or touch become one
    before = Window.partitionBy("doc_id", "first").orderBy("start", "stop")
    reach = F.max("stop").over(before.rowsBetween(Window.unboundedPreceding, -1))
    opened = matches.distinct().withColumn("_new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1)))
    island = opened.withColumn("_island", F.sum("_new").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    joined = island.groupBy("doc_id", "first", "_island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return joined.select("doc_id", "first", "start", "stop")


def without_repeats(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs without the words of later occurrences, also where a first one overlaps them; other columns as they are.  found: as repeats() gives."""
    cuts, columns = own_name(docs, "_cuts"), docs.columns
    spans = found.where("not first").groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias(cuts))
    joined = docs.join(spans, "doc_id", "left").select(*columns, cuts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans, place = b.column(cuts), b.schema.get_field_index("text")
            if spans.null_count < len(spans):
                texts = b.column("text").to_pylist()
                for i, own in enumerate(spans):
                    if texts[i] is None or not own.is_valid:
                        continue
                    starts = [m.start() for m in re.finditer(r"[^\x09-\x0d\x20]+", texts[i])]
                    starts.append(len(texts[i]))
                    kept, at = [], 0
                    for start, stop in sorted((c["start"], c["stop"]) for c in own.as_py()):
                        kept.append(texts[i][at : starts[min(start, len(starts) - 1)]])
                        at = max(at, starts[min(stop, len(starts) - 1)])
                    texts[i] = "".join([*kept, texts[i][at:]])
                b = b.set_column(place, "text", pa.array(texts, b.schema.field(place).type))
            yield b.select(columns)

    return joined.mapInArrow(cut, docs.schema)


def op2_sparse_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(repeats(table(spark, sf_dir, "documents")), "repeats").withColumn("words", F.col("stop") - F.col("start"))

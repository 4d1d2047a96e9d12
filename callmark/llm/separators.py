"""Operator 9: token counts by a separator scan over flat token files.

A flat file is ids one after the other, unsigned 16-bit big-endian, with an end-of-document id after each
document and no index.  Files are cut into blocks; each block is searched for the separator at once; what a
block can't know (the number of documents before it, and where the one it begins in started) is a prefix scan
over one small row per block.

A trailing odd byte is ignored; tokens after the last separator are a document that is not complete.  Empty
files have no documents, empty documents 0 tokens.  write_flat() writes the texts of a table (null: empty) as
such files; the separator is not an id of the vocabulary, so that no text can hold it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callmark.llm.common import fresh_path, in_small_batches, materialise, table
from callmark.llm.packing import Ids

#: 0xD080: its two bytes are a letter of UTF-8, which Spark's text sink takes as the end of a line.
EOD, EOD_TEXT = 0xD080, "\u0400"
#: Bytes of a block; blocks of a flat file that is written here; blocks that a task of a large table reads, one by one.
BLOCK, PER_FILE, BLOCKS_PER_TASK = 1 << 21, 8, 64
END = EOD.to_bytes(2, "big")


@in_small_batches
def write_flat(docs: DataFrame, tokenizer: str, path: str, text_col: str = "text", block: int = BLOCK) -> None:
    """Flat files of about PER_FILE blocks of `block` bytes each; a document is never cut.

    Ids from EOD on don't fit (the separator would be found within texts, or the number would be another): they
    are refused.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, size = Ids.of(tokenizer), [], 0
        for b in batches:
            for _, found in ids.of_column(b.column("text")):
                numbers = np.frombuffer(found, "<u4")
                if len(numbers) and numbers.max() >= EOD:
                    raise ValueError(f"ids of {EOD} and more don't fit into 16 bits with a separator")
                held.append(numbers.astype(">u2").tobytes())
                size += len(held[-1]) + 2
                if size >= block:
                    yield pa.RecordBatch.from_arrays([pa.array([END.join(held)], pa.binary())], names=["ids"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([END.join(held)], pa.binary())], names=["ids"])

    # a row is a stretch of documents, with separators between; the sink ends it with one more
    flat = docs.select(F.col(text_col).alias("text")).mapInArrow(encode, "ids binary")
    writer = flat.select(F.col("ids").cast("string").alias("value")).write
    writer.option("lineSep", EOD_TEXT).option("maxRecordsPerFile", PER_FILE).text(path)


def token_counts(spark: SparkSession, path: str, eod: int = EOD, block: int = BLOCK, pattern: str = "part-*") -> DataFrame:
    """file, doc_no (in the file, from 0), start (tokens before it, separators included), n_tokens, complete.

    Each task reads one block of `block` bytes by path and place, so files may be of any size; they lie where
    pyarrow's file systems reach (a shared mount, HDFS, S3, GCS, Azure).
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length")
    starts = F.when(F.col("length") > 0, F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(block).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    total = files.agg(F.sum("length")).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, total // (BLOCKS_PER_TASK * block))
    blocks = files.select("path", F.explode(starts).alias("at")).repartition(tasks, "path", "at")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for name, at in zip(b.column("path").to_pylist(), b.column("at").to_pylist()):
                system, place = fs.FileSystem.from_uri(name) if not name.startswith("file:") else (fs.LocalFileSystem(), "/" + name[5:].lstrip("/"))
                with system.open_input_file(place) as file:
                    x = file.read_at(block, at)
                ids = np.frombuffer(x, dtype=">u2", count=len(x) // 2)
                columns = [[name.rsplit("/", 1)[1]], [at // 2], [len(ids)], pa.array([np.flatnonzero(ids == eod)], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, list) else c for c in columns], names=["file", "first", "tokens", "ends"])

    found = materialise(blocks.mapInArrow(search, "file string, first long, tokens long, ends array<long>"), "blocks")
    before = Window.partitionBy("file").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    last = F.when(F.size("ends") > 0, F.col("first") + F.element_at("ends", -1))
    summary = found.select("file", "first", F.size("ends").alias("_n"), last.alias("_last"), (F.col("first") + F.col("tokens")).alias("_stop"))
    scanned = summary.select(
        "file",
        "first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("docs_before"),
        (F.coalesce(F.max("_last").over(before), F.lit(-1)) + 1).alias("open_since"),
    )
    ends = found.join(scanned, ["file", "first"]).select("file", "docs_before", "open_since", "first", "ends", F.posexplode("ends").alias("k", "end"))
    stop = F.col("first") + F.col("end")
    start = F.when(F.col("k") == 0, F.col("open_since")).otherwise(F.col("first") + F.get("ends", F.col("k") - 1) + 1)
    whole = ends.select("file", (F.col("docs_before") + F.col("k")).alias("doc_no"), start.alias("start"), (stop - start).alias("n_tokens"), F.lit(True).alias("complete"))
    per_file = summary.groupBy("file").agg(F.sum("_n").alias("doc_no"), (F.coalesce(F.max("_last"), F.lit(-1)) + 1).alias("start"), F.max("_stop").alias("_stop"))
    cut_off = per_file.where("_stop > start").select("file", "doc_no", "start", (F.col("_stop") - F.col("start")).alias("n_tokens"), F.lit(False).alias("complete"))
    return whole.unionByName(cut_off)


def op9_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as flat files in the shared folder, then the counts that the scan finds there."""
    import public_tokenizers

    path = fresh_path(spark, "flat")
    write_flat(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    counts = token_counts(spark, path)
    return counts.withColumn("file", F.regexp_replace("file", r"^part-(\d+).*-c(\d+).*$", "$1-$2"))

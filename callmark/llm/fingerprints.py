"""Operator 7: document fingerprints by order MinHash, by DataFrame functions only.

A text is cut into pieces: words of up to WORD code points, and the last WORD ones of a longer run; before, single letters of scripts without
blanks, and stretches that end with vowels, digits or signs, so that where a piece ends depends on the letters
around it only.  K neighbouring pieces are a k-mer.  Equal k-mers are numbered by occurrence.  A signature has
one value for each of 2^HASHES_LOG2 hash functions, the hash of a numbered k-mer XOR a constant that differs
from function to function in the leading bits: the TUPLE numbered k-mers of least hash in the whole text are put
back into the order in which they stand there and hashed together.  So a value changes with a k-mer and also
with the order of k-mers.  The likeness of two signatures is the share of functions whose values are equal.

Nulls count as empty texts; these have no value, and two of them are alike by 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callmark.llm.common import let, table

WORD, K, HASHES_LOG2, TUPLE = 16, 3, 6, 2
#: Scripts that put no blanks between words; letters after which a piece of a long run ends; the pieces.
UNSPACED, ENDS = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}\p{IsThai}", r"aeiouAEIOUаеиоуыэюяαεηιουω0-9!-/:-@\[-`{-~"
PIECES = rf"\S{{1,{WORD}}}+(?!\S)|[{UNSPACED}]|[^\s{ENDS}{UNSPACED}]{{0,7}}+[{ENDS}]++|[^\s{ENDS}{UNSPACED}]{{1,8}}+"
#: Positions take 24 bits; k-mers from 2^24 on count as standing at the same place.
PLACE = 24
#: Rows in one range of doc_id, within which each row finds the next.
ROWS_PER_RANGE = 20_000
LEAST_RANGES = 512


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def with_signature(docs: DataFrame, text_col: str, out: str) -> DataFrame:
    """docs with the column `out`: the signature, an array of function << 32 | value.  Each step is a column, computed once.

    Sorted by hash, the least ones under a function are those that share its leading bits, if there are TUPLE of them.
    """
    place = _long((1 << PLACE) - 1)
    at = lambda a, i: F.coalesce(F.get(a, i), _long(0))
    places = lambda a: F.when(F.size(a) > 0, F.sequence(F.lit(0), F.size(a) - 1)).otherwise(F.array().cast("array<int>"))
    high = lambda x, bits: F.shiftright(x, bits)
    first_of_run = lambda a, bits: F.filter(places(a), lambda i: (i == 0) | (high(at(a, i), bits) != high(at(a, i - 1), bits)))
    p, v, s, w, b, f = (f"_{out}_{x}" for x in "pvswbf")

    df = docs.withColumn(p, F.regexp_extract_all(F.col(text_col), F.lit(PIECES), F.lit(0)))
    kmers = F.when(F.size(p) > 0, F.sequence(F.lit(0), F.greatest(F.size(p) - K, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    kmer = lambda i: F.xxhash64(*[F.get(F.col(p), i + j) for j in range(K)])
    df = df.withColumn(v, F.sort_array(F.transform(kmers, lambda i: kmer(i).bitwiseAND(_long(-1 << PLACE)).bitwiseOR(F.least(i.cast("long"), place)))))
    df = df.withColumn(s, first_of_run(F.col(v), PLACE))

    def numbered(start: Column, j: Column) -> Column:
        """The occurrences of one k-mer: bin, rank and place of each."""
        after = F.coalesce(F.get(F.col(s), j + 1), F.size(v))

        def one(i: Column) -> Column:
            h = F.xxhash64(high(at(F.col(v), i), PLACE), i - start)
            bin_ = F.shiftleft(h.bitwiseAND(_long((1 << HASHES_LOG2) - 1)), 63 - HASHES_LOG2)
            rank = F.shiftleft(F.shiftrightunsigned(h, 64 - (63 - HASHES_LOG2 - PLACE)), PLACE)
            return bin_.bitwiseOR(rank).bitwiseOR(at(F.col(v), i).bitwiseAND(place))

        return F.transform(F.sequence(start, after - 1), one)

    df = df.withColumn(w, F.sort_array(F.flatten(F.transform(F.col(s), numbered))))
    df = df.withColumn(b, first_of_run(F.col(w), 63 - HASHES_LOG2))

    bits = 63 - HASHES_LOG2

    def value(own: Column) -> Column:
        in_text = F.array_sort(F.transform(own, lambda x: F.struct(x.bitwiseAND(place).alias("place"), high(x, PLACE).alias("kmer"))))
        return F.xxhash64(F.transform(in_text, lambda x: x["kmer"])).bitwiseAND(_long(0xFFFFFFFF))

    def leading(i: Column) -> Column:
        """The least of those that share the leading bits, which begin at i."""
        same = lambda x: high(x, bits) == high(at(F.col(w), i), bits)
        return F.struct(high(at(F.col(w), i), bits).cast("int").alias("function"), F.filter(F.slice(F.col(w), i + 1, TUPLE), same).alias("least"))

    # under function j come first the k-mers with its leading bits, then those whose last of these bits differs, then
    # those whose last but one differs, and so on; each as the function with the other bit orders them
    functions = F.sequence(F.lit(0), F.lit((1 << HASHES_LOG2) - 1))
    nothing = F.array().cast("array<bigint>")
    found = let(F.map_from_entries(F.transform(F.col(b), leading)), lambda m: F.transform(functions, lambda j: F.coalesce(F.try_element_at(m, j), nothing)))
    df = df.withColumn(f, found)
    for bit in range(HASHES_LOG2):
        other = lambda j: F.get(F.col(f), j.bitwiseXOR(F.lit(1 << bit)))  # noqa: B023, E731
        filled = F.transform(f, lambda own, j: F.when(F.size(own) >= TUPLE, own).otherwise(F.slice(F.concat(own, other(j)), 1, TUPLE)))
        df = df.withColumn(f, filled)
    values = F.transform(f, lambda own, j: F.shiftleft(j.cast("long"), 32).bitwiseOR(value(own)))
    return df.withColumn(out, F.when(F.size(w) > 0, values).otherwise(nothing)).drop(p, v, s, w, b, f)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1; 1 for two empty signatures."""
    n = F.greatest(F.size(a), F.size(b))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / n)


def written(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.hex(x), 10, "0")), "")


def ranges(docs: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """docs with the column _range, that grows with doc_id; null ids have -1."""
    from pyspark.ml.feature import Bucketizer

    n = max(LEAST_RANGES, docs.count() // rows_per_range)
    marks = docs.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n)
    splits = [float("-inf"), *(sorted(set(marks)) or [0.0]), float("inf")]
    keyed = docs.withColumn("_key", F.col("doc_id").cast("double"))
    return Bucketizer(splits=splits, inputCol="_key", outputCol="_range", handleInvalid="keep").transform(keyed).withColumn(
        "_range", F.when(F.col("_key").isNull(), F.lit(-1)).otherwise(F.col("_range").cast("int"))
    ).drop("_key")


def with_next(docs: DataFrame, enriched=lambda df: df) -> DataFrame:
    """enriched(docs (doc_id, text, ...)) with next_<column> of the next row by descending doc_id; after the last comes the first.

    The rows of a range find their next there.  The last of them needs the first row of the range below, of
    which a copy is put at the end: as many copies as ranges.
    """
    ranged = ranges(docs)
    tops = sorted((r for r in ranged.groupBy("_range").agg(F.max("doc_id").alias("doc_id")).collect()), key=lambda r: r[0])  # a row per range
    if not tops:
        whole = enriched(docs)
        return whole.select("*", *[F.col(c).alias(f"next_{c}") for c in whole.columns])
    follows = [(tops[i - 1]["doc_id"], tops[i]["_range"]) for i in range(len(tops))]  # the first row below; of the lowest range the topmost
    spark = docs.sparkSession
    heads = ranged.drop("_range").join(F.broadcast(spark.createDataFrame(follows, "_id long, _range int")), F.col("doc_id").eqNullSafe(F.col("_id"))).drop("_id")
    first = Window.partitionBy("_range").orderBy("text")
    heads = heads.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n").withColumn("_copy", F.lit(1))
    both = enriched(ranged.withColumn("_copy", F.lit(0)).unionByName(heads))
    columns = [c for c in both.columns if c not in ("_range", "_copy")]
    order = Window.partitionBy("_range").orderBy("_copy", F.desc_nulls_last("doc_id"), "text")
    out = both.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return out.where("_copy = 0").drop("_copy", "_range")


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    paired = with_next(docs, lambda df: with_signature(df, "text", "signature"))
    n = F.length("text")
    q = F.floor(n / 3).cast("int")
    paired = paired.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.left("text", n - q), F.left("next_text", q)))
    paired = paired.withColumn("edited_sha256", F.sha2("edited", 256)).drop("text", "next_text")
    done = with_signature(paired, "edited", "edited_signature")
    return done.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        written(F.col("signature")).alias("fingerprint"),
        written(F.col("edited_signature")).alias("edited_fingerprint"),
        likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
        likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
    )

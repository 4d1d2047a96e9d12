"""Call files, interval files and reference sequences as DataFrames, and the writers for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callmark.functions import calls as C
from callmark.sources.scratch import discard, written

FIXED = ["CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO"]
#: Bases per row of a reference table: a site's bases are cut out of a chunk, which is read from its beginning.
CHUNK = 1 << 12
#: Chunks that a row stands for where a contig recurs.
WIDE = 16


def header(spark: SparkSession, path: str) -> DataFrame:
    """kind, id, text of every ## line; id is the ID of structured ones.  The first definition of a (kind, id) stands."""
    lines = spark.read.text(path).where(F.col("value").startswith("##"))
    kind = F.regexp_extract("value", r"^##([^=]+)=", 1)
    id_ = F.regexp_extract("value", r"<ID=([^,>]+)", 1)
    return lines.select(kind.alias("kind"), F.when(id_ != "", id_).alias("id"), F.col("value").alias("text"))


def header_json(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per structured header line."""
    fields = F.regexp_extract_all("text", F.lit(r'([A-Za-z]+)=("[^"]*"|[^,<>]*)'), F.lit(0))
    pairs = F.map_from_entries(F.transform(F.filter(fields, lambda x: ~x.contains("<")), lambda x: F.struct(F.substring_index(x, "=", 1), F.regexp_replace(F.substr(x, F.instr(x, F.lit("=")) + 1), '^"|"$', ""))))
    return header(spark, path).where("id is not null").dropDuplicates(["kind", "id"]).select("kind", "id", F.to_json(pairs).alias("json"))


def provenance(spark: SparkSession, path: str) -> DataFrame:
    """Callers and versions that the header names: name, version, parameters."""
    h = header(spark, path)
    source = h.where("kind = 'source'").select(F.regexp_extract("text", r"^##source=([^ ]+)", 1).alias("name"), F.regexp_extract("text", r"^##source=[^ ]+ +(.*)$", 1).alias("version"), F.lit("").alias("parameters"))
    command = h.where("kind rlike '^(GATKCommandLine|SentieonCommandLine)'")
    part = lambda k: F.regexp_extract("text", rf'{k}="?([^",>]*)', 1)
    return source.unionByName(command.select(F.coalesce("id", "kind").alias("name"), part("Version").alias("version"), part("CommandLineOptions").alias("parameters")))


def sample_names(spark: SparkSession, path: str) -> list[str]:
    line = spark.read.text(path).where(F.col("value").startswith("#CHROM")).first()  # one line of the header
    return line["value"].split("\t")[9:] if line else []


def computed(df: DataFrame) -> DataFrame:
    """df with its columns computed once a row, here: where an optimiser may put an expression in the place of a column, each use computes it
    again, and each element of a list within it."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def read_calls(spark: SparkSession, path: str, apply_filters: bool = False) -> DataFrame:
    """chrom, pos, id, ref, alts, qual, filters, info (map), calls (array of sample, gt, phased, formats), failed.

    Alleles are upper-cased; `failed` marks records that can't be imported (REF or ALT is not a sequence, a
    genotype names an allele that is not there).  With apply_filters calls of failing records, or with a failing
    FT of their own, become no-calls.
    """
    names = sample_names(spark, path)
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.col("value") != ""))
    lines = computed(lines.select(F.split("value", "\t").alias("cells")))
    f = [F.get("cells", F.lit(i)) for i in range(9 + len(names))]  # a filter above may be asked of any line
    absent = lambda c: F.when(c.isin(".", ""), F.array().cast("array<string>"))
    filters = absent(f[6]).otherwise(F.split(f[6], ";"))

    lines = computed(lines.select("cells", *[C.format_map(F.coalesce(f[8], F.lit("GT")), F.coalesce(f[9 + i], F.lit("."))).alias(f"formats_{i}") for i in range(len(names))]))

    def call(i: int) -> Column:
        formats = F.col(f"formats_{i}")
        gt = F.coalesce(formats["GT"], F.lit("."))
        own = F.transform(F.split(gt, r"[/|]"), lambda a: F.coalesce(a.try_cast("int"), F.lit(-1)))
        ok = C.passes(filters) & F.coalesce(formats["FT"], F.lit("PASS")).isin("PASS", ".")
        called = F.when(ok, own).otherwise(F.array().cast("array<int>")) if apply_filters else own
        return F.struct(F.lit(names[i]).alias("sample"), called.alias("gt"), gt.contains("|").alias("phased"), formats.alias("formats"))

    alts = F.transform(absent(f[4]).otherwise(F.split(f[4], ",")), lambda a: F.upper(a))
    calls = F.array(*[call(i) for i in range(len(names))]) if names else F.array().cast("array<struct<sample:string,gt:array<int>,phased:boolean,formats:map<string,string>>>")
    rows = lines.select(
        f[0].alias("chrom"), f[1].try_cast("long").alias("pos"), f[2].alias("id"), F.upper(f[3]).alias("ref"), alts.alias("alts"),
        f[5].try_cast("float").alias("qual"), filters.alias("filters"), C.info_map(f[7]).alias("info"), calls.alias("calls"),
    )
    rows = computed(rows)
    beyond = F.exists("calls", lambda c: F.exists(c["gt"], lambda g: g > F.size("alts")))
    return rows.withColumn("failed", C.import_failed(F.col("ref"), F.col("alts")) | beyond)


def merged_calls(files: list[DataFrame]) -> DataFrame:
    """Several files on (chrom, pos, occurrence): one row with the calls of all, alleles joined and genotypes renumbered."""
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("chrom", "pos").orderBy("ref", F.array_join("alts", ",")))
    out = None
    for df in files:
        part = df.select("chrom", "pos", "ref", number.alias("k"), "alts", "calls")
        if out is None:
            out = part
            continue
        right = part.select("chrom", "pos", "ref", "k", F.col("alts").alias("_alts"), F.col("calls").alias("_calls"))
        no_alts, no_calls = F.array().cast("array<string>"), F.array().cast(dict(part.dtypes)["calls"])
        both = out.join(right, ["chrom", "pos", "ref", "k"], "full_outer")
        whole = F.array_union(F.coalesce("alts", no_alts), F.coalesce("_alts", no_alts))
        both = both.withColumn("_whole", whole)
        renumbered = F.transform(F.coalesce("_calls", no_calls), lambda c: c.withField("gt", F.transform(c["gt"], lambda g: F.when(g > 0, F.array_position("_whole", F.get(F.col("_alts"), g - 1)).cast("int")).otherwise(g))))
        out = both.select("chrom", "pos", "ref", "k", F.col("_whole").alias("alts"), F.concat(F.coalesce("calls", no_calls), renumbered).alias("calls"))
    return out


def read_intervals(spark: SparkSession, path: str, label: str | None = None, fix_chr: bool = False) -> DataFrame:
    """chrom, start, stop (1-based, inclusive), label; lines that are no interval are left out."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").rlike("^(#|track|browser)"))
    own = F.lit(label) if label else F.coalesce(F.get(f, F.lit(3)), F.lit(""))
    chrom = C.with_chr(f[0]) if fix_chr else f[0]
    out = rows.select(chrom.alias("chrom"), (F.get(f, F.lit(1)).try_cast("long") + 1).alias("start"), F.get(f, F.lit(2)).try_cast("long").alias("stop"), own.alias("label"))
    return out.where("start <= stop")


def read_stratification(spark: SparkSession, manifest: str) -> DataFrame:
    """All intervals of a manifest of name<TAB>file, relative to the manifest; names must differ."""
    rows = [r["value"].split("\t") for r in spark.read.text(manifest).where("value <> ''").collect()]  # one line per region set
    if len({r[0] for r in rows}) < len(rows):
        raise ValueError("a stratification region is named twice")
    folder, out = manifest.rpartition("/")[0], None
    for name, file in (r[:2] for r in rows):
        part = read_intervals(spark, file if file.startswith("/") or "://" in file else f"{folder}/{file}", name)
        out = part if out is None else out.unionByName(part)
    return out


def read_reference(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """chrom, at (0-based start of the chunk), seq (upper case): a contig is one record between '>' signs, cut into rows."""
    records = spark.read.option("lineSep", ">").text(path).where("length(value) > 0")
    lines = F.split("value", r"\r?\n")
    seq = F.upper(F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), ""))
    whole = records.select(F.substring_index(F.substring_index(lines[0], " ", 1), "\t", 1).alias("chrom"), seq.alias("seq"))
    # chunks are cut out of bytes, since a string is read from its beginning for each
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.length("_whole") - 1, F.lit(0)), F.lit(chunk)))
    cut = whole.select("chrom", F.col("seq").cast("binary").alias("_whole")).withColumn("at", at)
    return cut.select("chrom", F.col("at").cast("long").alias("at"), F.substr("_whole", F.col("at") + 1, F.lit(chunk)).cast("string").alias("seq"))


def contig_lengths(reference: DataFrame) -> DataFrame:
    """Per contig: length, and length without the N at both ends."""
    left, right = F.length(F.regexp_extract("seq", "^N*", 0)), F.length(F.regexp_extract("seq", "N*$", 0))
    size = F.length("seq")
    real = F.when(left < size, F.col("at") + left)
    stop = F.when(left < size, F.col("at") + size - right)
    out = reference.groupBy("chrom").agg(F.sum(size).alias("length"), F.min(real).alias("_a"), F.max(stop).alias("_b"))
    return out.select("chrom", "length", F.coalesce(F.col("_b") - F.col("_a"), F.lit(0)).alias("trimmed_length"))


def fetched(sites: DataFrame, reference: DataFrame, start: str, stop: str, out: str = "bases", chunk: int = CHUNK) -> DataFrame:
    """sites with the reference bases from start to stop (0-based, inclusive); beyond a contig's end there are none.

    An equi-join on (contig, chunk): neither side is broadcast, and each site meets only the chunks it touches.  The join is named
    since Spark takes a computed sequence for a few bytes and would send the whole reference to the driver.  Of contigs that recur
    (columns unit and length) what is joined is one period to WIDE chunks, not their letters, which take a thousand times the room in
    memory that shuffle files show.  Where start and stop are one column, a site has one chunk and its rows need no grouping.
    """
    recurs = "unit" in reference.columns
    width = WIDE * chunk if recurs else chunk
    floor = lambda c: F.floor(F.greatest(c, F.lit(0)) / width) * width
    first = F.greatest(F.col(start) - F.col("_at"), F.lit(0))
    if recurs:
        chunks = reference.where(F.col("at") % width == 0).select("chrom", F.col("at").alias("_at"), F.col("unit").alias("_seq"), F.col("length").alias("_length"))
        size = F.greatest(F.least(F.col(stop) + 1, F.col("_at") + width, F.col("_length")) - F.col("_at") - first, F.lit(0))
        turn, period = (F.col("_at") + first) % F.length("_seq"), F.length("_seq")
        piece = F.substr(F.repeat("_seq", F.ceil((turn + size) / period).cast("int")), (turn + 1).cast("int"), size.cast("int"))
    else:
        chunks = reference.select("chrom", F.col("at").alias("_at"), F.col("seq").alias("_seq"))
        piece = F.substr("_seq", (first + 1).cast("int"), F.greatest(F.col(stop) - F.col("_at") - first + 1, F.lit(0)).cast("int"))
    if start == stop:
        part = sites.withColumn("_at", floor(F.col(start))).join(chunks.hint("merge"), ["chrom", "_at"], "left")
        return part.select(*sites.columns, F.coalesce(F.when(F.col(start) >= 0, piece), F.lit("")).alias(out))
    keyed = sites.withColumn("_site", F.monotonically_increasing_id()).withColumn("_at", F.explode(F.sequence(floor(F.col(start)), floor(F.greatest(F.col(stop), F.col(start))), F.lit(width).cast("long"))))
    part = keyed.join(chunks.hint("merge"), ["chrom", "_at"], "left")
    rows = part.groupBy(*sites.columns, "_site").agg(F.array_sort(F.collect_list(F.struct("_at", piece.alias("p")))).alias("_p"))
    return rows.select(*sites.columns, F.array_join(F.transform("_p", lambda x: F.coalesce(x["p"], F.lit(""))), "").alias(out))


def write_calls(calls: DataFrame, path: str, header_lines: list[str], samples: list[str], contigs: list[str] | None = None) -> None:
    """Sorted text in one folder: its files, in the order of their names, are one valid file whose first lines are the header.

    Every FORMAT key that a sample of the record has is written, GT first.  contigs: the order of chromosomes (those that
    it does not name come last, in the order of their names).
    """
    spark = calls.sparkSession
    top = [*header_lines, "\t".join(["#" + FIXED[0], *FIXED[1:], "FORMAT", *samples])]
    empty = lambda c: F.when(F.size(c) == 0, ".")
    info = F.array_join(F.transform(F.map_entries("info"), lambda e: F.when(e["value"] == "true", e["key"]).otherwise(F.concat_ws("=", e["key"], e["value"]))), ";")
    calls = computed(calls).withColumn("_keys", F.filter(F.array_distinct(F.flatten(F.transform("calls", lambda c: F.map_keys(c["formats"])))), lambda k: k != "GT"))
    mark = lambda c: F.when(c["phased"], "|").otherwise("/")

    def sample(i: int) -> Column:
        call = F.get("calls", F.lit(i))
        numbers = F.transform(call["gt"], lambda g: F.when(g < 0, ".").otherwise(g.cast("string")))
        gt = F.when(F.size(numbers) <= 0, ".").otherwise(F.aggregate(F.slice(numbers, 2, F.greatest(F.size(numbers) - 1, F.lit(0))), F.get(numbers, F.lit(0)), lambda a, x: F.concat(a, mark(call), x)))
        return F.array_join(F.concat(F.array(F.coalesce(gt, F.lit("."))), F.transform("_keys", lambda k: F.coalesce(call["formats"][k], F.lit(".")))), ":")

    line = F.concat_ws(
        "\t", "chrom", F.col("pos").cast("string"), F.coalesce("id", F.lit(".")), "ref", empty("alts").otherwise(F.array_join("alts", ",")),
        F.coalesce(F.regexp_replace(F.col("qual").cast("string"), r"\.0$", ""), F.lit(".")), empty("filters").otherwise(F.array_join("filters", ";")), F.when(info == "", ".").otherwise(info),
        F.array_join(F.concat(F.array(F.lit("GT")), "_keys"), ":"), *[sample(i) for i in range(len(samples))],
    )
    place = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(c) for c in contigs]), F.col("chrom")), F.lit(0)), F.lit(1 << 30)) if contigs else F.lit(0)
    calls = computed(calls)
    body = calls.select(F.lit(1).alias("part"), place.cast("long").alias("place"), "chrom", "pos", "ref", line.alias("value"))
    body = written(body, "lines")  # the sort reads its input twice
    head = spark.createDataFrame([(0, i, "", 0, "", x) for i, x in enumerate(top)], "part int, place long, chrom string, pos long, ref string, value string")
    head.unionByName(body).orderBy("part", "place", "chrom", "pos", "ref", "value").select("value").write.mode("overwrite").text(path)
    discard(body, "lines")


def write_intervals(regions: DataFrame, path: str) -> None:
    regions.orderBy("chrom", "start").select("chrom", (F.col("start") - 1).alias("start"), "stop", "label").write.mode("overwrite").csv(path, sep="\t")


def write_table(df: DataFrame, path: str, sort: list[str]) -> None:
    df.orderBy(*sort).write.mode("overwrite").csv(path, header=True, nullValue="", compression="gzip")


def write_metrics(df: DataFrame, path: str) -> None:
    """One JSON object per row; NaN and infinities become null."""
    clean = [F.when(F.isnan(c) | F.col(c).isin(float("inf"), float("-inf")), None).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*clean).write.mode("overwrite").json(path)

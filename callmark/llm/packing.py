"""Operator 8: packing by non-negative least squares over a histogram of lengths.

Documents become pieces of at most one window: full windows, and what is left.  Combinations of up to three
lengths (in steps of a grid) that fill a window are enumerated; repeat counts are solved against the
histogram by non-negative least squares and rounded down to what there is; the pieces that remain are packed
greedily, the longest length first and into each window the longest that still fits.  All of that works on
the histogram, at most one count for each length.  It yields intervals of ranks: the pieces of one length
with ranks from a to b go to sequences from s on.  Ranks are given in the cluster, so that no task and not
the driver sees all pieces.

Nulls and empty texts have only the end-of-document id.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callmark.llm.common import Remembered, in_small_batches, in_worker, materialise, table

WINDOW, GRID, EOD = 4096, 16, 2
#: Cells in which the pieces of one length are numbered apart.
CELLS = 256
#: Distinct words that one Python worker remembers in each of two generations; words that are encoded together; bytes of text per step.
REMEMBERED, TOGETHER, STEP = 150_000, 500, 2_000_000
#: Letters that are letters in every edition of Unicode, stay as they are in NFC and have one letter in lower case, and ASCII signs behind them.
WORD = r"^(?P<word>[A-Za-zÀ-ÖØ-öø-įı-ɏ]+)(?P<signs>[!-/:-@\[-`{-~]*)$"
#: The rules of a tokenizer file under which a run of letters in lower case is one word, and signs behind it are another.
NORMALIZERS, SPLITTERS = ["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]
PATTERN, SPECIAL, END = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", re.compile(r"<\|[a-z]+\|>"), "</w>"


def combinations(window: int, grid: int) -> list[tuple[int, ...]]:
    """All ways to fill a window with one, two or three lengths on the grid."""
    n = window // grid
    pairs = [(a, n - a) for a in range(1, n // 2 + 1)]
    triples = [(a, b, n - a - b) for a in range(1, n // 3 + 1) for b in range(a, (n - a) // 2 + 1)]
    return [(n,), *pairs, *triples]


def least_squares(counts: np.ndarray, ways: list[tuple[int, ...]], most: int = 2000) -> np.ndarray:
    """Repeat counts x >= 0 with A x near counts (A: how often each way uses each length), by an active set."""
    a = np.zeros((len(counts), len(ways)), dtype=np.float32)
    for j, way in enumerate(ways):
        for part in way:
            a[part - 1, j] += 1
    scale = max(counts.max(), 1.0)
    target = counts / scale
    x, active = np.zeros(len(ways)), []
    for _ in range(most):
        pull = a.T @ (target - a @ x).astype(np.float32)
        pull[active] = -1
        best = int(pull.argmax())
        if pull[best] < 1e-6:
            break
        active.append(best)
        while True:
            own = a[:, active].astype(float)
            solved = np.linalg.lstsq(own, target, rcond=None)[0]
            if solved.min() > 1e-12:
                x[:] = 0
                x[active] = solved
                break
            now, low = x[active], solved <= 1e-12
            step = np.min(now[low] / np.maximum(now[low] - solved[low], 1e-15))
            moved = now + step * (solved - now)
            x[:] = 0
            x[active] = np.maximum(moved, 0)
            active = [k for k, m, below in zip(active, moved, low) if not (below and m <= 1e-12)]
            if not active:
                break
    return x * scale


def plan(histogram: dict[int, int], window: int = WINDOW, grid: int = GRID) -> list[tuple[int, int, int, int, int]]:
    """Intervals (length, first rank, rank after the last, first sequence, pieces of it in each sequence)."""
    left = {n: c for n, c in histogram.items() if c > 0}
    used = dict.fromkeys(left, 0)
    out: list[tuple[int, int, int, int, int]] = []
    sequence = 0

    def take(length: int, count: int, first: int, each: int) -> None:
        out.append((length, used[length], used[length] + count, first, each))
        used[length] += count
        left[length] -= count

    if left.get(window):
        count = left[window]
        take(window, count, 0, 1)
        sequence = count
    bins: dict[int, list[int]] = {}
    for length in sorted(left, reverse=True):
        if length < window:
            bins.setdefault(-(-length // grid), []).append(length)
    counts = np.zeros(window // grid)
    for b, lengths in bins.items():
        counts[b - 1] = sum(left[n] for n in lengths)
    ways = combinations(window, grid)[1:]
    repeats = least_squares(counts, ways) if counts.any() else np.zeros(len(ways))
    there = counts.astype(np.int64)
    for j in np.argsort(-repeats, kind="stable"):
        times = int(repeats[j] + 0.5)
        need: dict[int, int] = {}
        for part in ways[j]:
            need[part] = need.get(part, 0) + 1
        times = min([times, *(int(there[b - 1]) // k for b, k in need.items())])
        if times <= 0:
            continue
        for b in ways[j]:
            there[b - 1] -= times
            at = 0
            while at < times:  # a bin's lengths, the longest first
                length = next(n for n in bins[b] if left[n])
                count = min(left[length], times - at)
                take(length, count, sequence + at, 1)
                at += count
        sequence += times
    rest = sorted(n for n in left if left[n])
    while rest:
        room, need = window, {}
        for length in reversed(rest):
            if length <= room:
                k = min(room // length, left[length])
                need[length] = k
                room -= k * length
        times = min(left[n] // k for n, k in need.items())
        for length, k in need.items():
            take(length, k * times, sequence, k)
        sequence += times
        rest = [n for n in rest if left[n]]
    return out


def pack(pieces: DataFrame, window: int = WINDOW, grid: int = GRID, length_col: str = "length", order: tuple[str, ...] = ("doc_id", "start")) -> DataFrame:
    """pieces, with the columns sequence_id and offset.  order: columns that tell pieces apart, for numbering."""
    spark = pieces.sparkSession
    keyed = pieces.withColumn("_cell", F.pmod(F.xxhash64(*order), F.lit(CELLS)).cast("int"))
    cells = keyed.groupBy(length_col, "_cell").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(length_col).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialise(cells.select(length_col, "_cell", "_n", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start")), "pack-cells")
    histogram = {r[0]: r[1] for r in starts.groupBy(length_col).agg(F.sum("_n")).collect()}  # at most `window` rows
    schema = "_length int, _from long, _to long, _sequence long, _each long"
    intervals = spark.createDataFrame(plan(histogram, window, grid), schema)  # bounded by the window, not by the pieces
    within = Window.partitionBy(length_col, "_cell").orderBy(*order)
    ranked = keyed.withColumn("_row", F.row_number().over(within)).join(starts.select(length_col, "_cell", "_start"), [length_col, "_cell"])
    ranked = ranked.withColumn("_rank", F.col("_start") + F.col("_row") - 1)
    rank = F.col("_rank")
    placed = ranked.join(F.broadcast(intervals), (F.col(length_col) == F.col("_length")) & (rank >= F.col("_from")) & (rank < F.col("_to")))
    placed = placed.withColumn("sequence_id", F.col("_sequence") + F.floor((rank - F.col("_from")) / F.col("_each")))
    before = Window.partitionBy("sequence_id").orderBy(F.desc(length_col), *order).rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum(length_col).over(before), F.lit(0)).cast("long"))
    return placed.select(*pieces.columns, "sequence_id", "offset")


def strung(ids: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of a list that lies flat in ids, with these sizes, one after the other, and where each of them ends."""
    counts, starts = sizes[which], (np.cumsum(sizes) - sizes)[which]
    ends = np.cumsum(counts)
    places = np.repeat(starts - ends + counts, counts)
    places += np.arange(len(places))
    return ids[places], ends


class Ids:
    """Ids of whole texts by the tokenizers library, remembered by words.

    White space parts words in this kind of vocabulary, so chunks between ASCII white space stand alone.  A chunk of
    Latin letters with or without signs behind it is the word in lower case and the signs.  Such words need neither
    the file's normalizer nor its splitter, which take most of the library's time.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library, self.known = Tokenizer.from_file(path), Remembered(REMEMBERED)
        self.library.no_padding()
        self.library.no_truncation()
        self.words = None
        if self.parts_words(json.loads(self.library.to_str())):
            self.words = Tokenizer(self.library.model)
            self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            vocab = self.words.get_vocab()
            self.last = np.zeros(max(vocab.values(), default=0) + 1, dtype=bool)
            self.last[[i for t, i in vocab.items() if t.endswith(END)]] = True

    @staticmethod
    def of(path: str) -> Ids:
        """One for all tasks of a Python worker."""
        return in_worker(Ids, path)

    @staticmethod
    def parts_words(spec: dict) -> bool:
        """Whether a tokenizer file has the rules above."""
        normalizers = (spec["normalizer"] or {}).get("normalizers", [])
        splitters = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        if [n["type"] for n in normalizers] != NORMALIZERS or [p["type"] for p in splitters] != SPLITTERS:
            return False
        replace, (split, level), model = normalizers[1], splitters, spec["model"]
        return (
            (replace["pattern"], replace["content"]) == ({"Regex": r"\s+"}, " ")
            and (split["pattern"], split["behavior"], split["invert"]) == ({"Regex": PATTERN}, "Removed", True)
            and not (level["add_prefix_space"] or level["use_regex"])
            and (model["type"], model.get("end_of_word_suffix"), model.get("dropout")) == ("BPE", END, None)
            and all(SPECIAL.fullmatch(t["content"]) for t in spec["added_tokens"])
        )

    def of_chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks, one after the other, and how many each has."""
        word, signs = pc.extract_regex(chunks, WORD).flatten() if self.words else [pa.nulls(len(chunks), chunks.type)] * 2
        coded = [pc.utf8_lower(word).dictionary_encode(), pc.coalesce(signs, chunks).dictionary_encode()]
        words, others = (c.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist() for c in coded)
        self.encode(self.known.missing(set(words)), self.by_last_tokens)
        self.encode(self.known.also_missing(set(others)), self.by_offsets)
        known = self.known.now.__getitem__
        ids = [*map(known, words), *map(known, others), b""]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first, then = (c.indices.fill_null(-1).to_numpy() for c in coded)  # the last one, without ids, where there is no word
        found, ends = strung(np.frombuffer(b"".join(ids), dtype="<u4"), sizes, np.column_stack([first, then + len(words)]).ravel())
        return found, np.diff(ends[1::2], prepend=0)

    def encode(self, chunks: list[bytes], cut) -> None:
        for at in range(0, len(chunks), 20 * TOGETHER):
            groups = [chunks[k : k + TOGETHER] for k in range(at, min(at + 20 * TOGETHER, len(chunks)), TOGETHER)]
            for group, (ids, cuts) in zip(groups, cut(groups)):
                ids = ids.tobytes()
                self.known.now.update(zip(group, [ids[4 * x : 4 * y] for x, y in zip(cuts, cuts[1:])]))

    def by_last_tokens(self, groups: list[list[bytes]]) -> Iterator[tuple[np.ndarray, list[int]]]:
        """Ids of a group's words, and where each word's begin; a word's last token, and no other, has the end of a word."""
        for group, found in zip(groups, self.words.encode_batch_fast([b" ".join(g).decode() for g in groups], add_special_tokens=False)):
            ids = np.array(found.ids, dtype="<u4")
            cuts = [0, *(np.flatnonzero(self.last[ids]) + 1).tolist()]
            if len(cuts) == len(group) + 1:
                yield ids, cuts
            else:  # the vocabulary lacks a byte, so that a word has no last token
                yield from self.by_offsets([group])

    def by_offsets(self, groups: list[list[bytes]]) -> Iterator[tuple[np.ndarray, list[int]]]:
        """The same for any chunks."""
        groups = [[c.decode() for c in g] for g in groups]
        for group, found in zip(groups, self.library.encode_batch([" ".join(g) for g in groups], add_special_tokens=False)):
            starts = [o[0] for o in found.offsets]
            yield np.array(found.ids, dtype="<u4"), np.searchsorted(starts, np.cumsum([0] + [len(c) + 1 for c in group])).tolist()

    def of_column(self, column: pa.Array) -> Iterator[tuple[int, bytes]]:
        """Row and ids, little-endian unsigned 32-bit, of every text of an Arrow column, in order; nulls are empty."""
        column = column.cast(pa.large_string()).fill_null("")
        ends, at = np.cumsum([0, *pc.binary_length(column).to_pylist()]), 0
        while at < len(column):  # steps bound what is held at once
            upto = max(at + 1, int(np.searchsorted(ends, ends[at] + STEP, "right")) - 1)
            chunks = pc.ascii_split_whitespace(column.slice(at, upto - at))
            distinct = chunks.values.dictionary_encode()
            found, till = strung(*self.of_chunks(distinct.dictionary), distinct.indices.to_numpy())
            borders = np.concatenate([[0], till])[chunks.offsets.to_numpy()].tolist()
            yield from ((row, found[x:y].tobytes()) for row, x, y in zip(range(at, upto), borders, borders[1:]))
            at = upto


def token_pieces(docs: DataFrame, tokenizer: str, eod: int = EOD, window: int = WINDOW, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most one window of each document's ids and the end-of-document id.

    doc_id, start, length, ids_crc32, doc_tokens; ids (binary, little-endian unsigned 32-bit) if with_ids.
    """
    names = ["start", "length", "ids_crc32", "doc_tokens"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = Ids.of(tokenizer), np.array([eod], dtype="<u4").tobytes()
        for b in batches:
            rows, numbers, pieces = [], [], []
            for row, ids in encode.of_column(b.column("text")):
                ids += end
                for start in range(0, len(ids), 4 * window):
                    piece = ids[start : start + 4 * window]
                    rows.append(row)
                    numbers.append((start // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4))
                    if with_ids:
                        pieces.append(piece)
            columns = [b.column("doc_id").take(pa.array(rows, pa.int64())), *[pa.array(c) for c in np.array(numbers, np.int64).reshape(-1, 4).T]]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(pieces, pa.binary())] * with_ids, names=["doc_id", *names, "ids"][: 5 + with_ids])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids)


@in_small_batches
def pack_texts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Pieces without ids, and where they lie in the packed sequences."""
    return pack(materialise(token_pieces(docs, tokenizer, with_ids=False), "pieces"))


def op8_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))

"""Operator 4: toxicity after noisy-channel deobfuscation.

A character trigram model is counted over all texts.  Words that look disguised (digits or signs among
letters, separators between letters, a letter three or more times, words in short pieces) become lattices: each
character may stand for itself, for the letters it is a substitute of, or for nothing (a separator, a
repetition); a blank between short pieces may be a border of words or nothing;
each choice has a channel cost, and Viterbi decoding finds the cheapest reading under the model.  Letters that the model
does not know stay as they are, repetitions of them are taken out; full-width letters count as plain ones, and
characters of no width are left out.
The restored words are scored by log-odds of words and word beginnings, learned from labelled rows, and a
logistic curve over their sum makes the score.

Learning uses at most TRAIN_ROWS labelled rows (those of the least hashes of doc_id) and keeps every feature that counts; the
character model covers all rows.  Nulls count as empty texts, which get a score like any text without a
toxic word.  Labels of a doc_id that has several are their maximum; rows without a doc_id are never held out.
"""

from __future__ import annotations

import math
import operator
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callmark.llm.common import in_small_batches, in_worker, materialise, own_name, table
from callmark.llm.words import BASE, mixed

#: The letters of the character model; everything else is a border of words.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿß"
SIZE = 64
#: Letters that a sign may stand for.
SUBSTITUTES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
SEPARATORS = set("-._*~/\\,'\"`:;^#")
#: What may surround a word, and what a disguised word may consist of.
AROUND = "-._*~/\\,'\"`:;^#!?()[]{}<>|"
EDGE = {*AROUND} - SEPARATORS
DISGUISE = {*LETTERS, *SUBSTITUTES, *SEPARATORS}
THRICE = re.compile(r"(.)\1\1", re.S)
REPEATED, WORD = re.compile(r"(.)\1\1+", re.S), re.compile(r"\S+")
#: Costs in nats: a substitute, a dropped separator, a dropped repetition in a run of three or of two, a sign that is no letter.
SWAP, SKIP, REPEAT, DOUBLE, FOREIGN = 0.5, 0.3, 0.2, 4.0, 9.0
TRAIN_ROWS = 200_000
#: A feature counts if so many toxic rows have it, whatever the size of the table.
LEAST_ROWS = 3
#: Word beginnings of these lengths are features; log-odds count from LEAST on.
BEGINNINGS, LEAST = range(3, 10), 2.0
THRESHOLD = 0.7
#: Neighbouring pieces of at most PIECE characters may be parts of one word; readings of at most LONG characters are remembered.
PIECE, LONG = 3, 40
#: Characters of no width.
WIDTHLESS = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]+")
#: A longer word that begins as a last piece with punctuation behind it.
LAST = re.compile(r"\S{1,%d}(?=[.,;:!?])" % PIECE)
#: Separators are borders or nothing, as blanks are.
BLANKS = str.maketrans(dict.fromkeys(SEPARATORS, " "))
#: Words that a Python worker remembers in each of its memories; beyond it a memory starts anew.
REMEMBERED = 20_000
#: Words that are hashed together, hashes that are merged together; features that are held before their counts are told, and names of features.
HASHED, MERGED, HELD, NAMED = 20_000, 500_000, 1_000_000, 200_000
#: Rows where this is 1 are held out.
FOLD_SQL = "crc32(cast(doc_id as string)) % 3"


def _code_table() -> np.ndarray:
    codes = np.zeros(0x250, dtype=np.int64)
    for i, c in enumerate(LETTERS):
        codes[ord(c)] = i + 1
    return codes


def character_counts(docs: DataFrame) -> np.ndarray:
    """Counts of letter trigrams (0: border) over every text; SIZE cubed numbers, whatever the data."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, total = _code_table(), np.zeros(SIZE**3, dtype=np.int64)
        for b in batches:
            for at in range(0, len(b), 200):
                text = "\n".join([t or "" for t in b["text"].iloc[at : at + 200]])
                points = np.frombuffer(("\n" + text.lower() + "\n").encode("utf-32-le", "replace"), dtype=np.uint32)
                c = codes[np.minimum(points, 0x24F)]
                c = c[(c > 0) | np.concatenate([[True], c[:-1] > 0])]  # one border in a row
                if len(c) > 2:
                    total += np.bincount((c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:], minlength=SIZE**3)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"k": at, "n": total[at]})

    rows = docs.select("text").mapInPandas(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(SIZE**3)
    for r in rows:
        out[r["k"]] = r["n"]
    return out


def character_model(counts: np.ndarray) -> np.ndarray:
    """-log P(c | a, b) at [a, b, c]: trigrams, mixed with bigrams and an even share."""
    tri = counts.reshape(SIZE, SIZE, SIZE)
    bi = tri.sum(axis=0)
    low = (bi + 0.1) / (bi + 0.1).sum(axis=1, keepdims=True)
    p = (tri + 5 * low[None]) / (tri.sum(axis=2, keepdims=True) + 5)
    return -np.log(p).astype(np.float32)


class Restorer:
    def __init__(self, model: np.ndarray):
        self.cost = model.tolist()  # plain numbers, which the loops below read faster
        self.codes = {c: i + 1 for i, c in enumerate(LETTERS)}
        self.known: dict[str, str] = {}
        self.known_runs: dict[str, list[str]] = {}

    def odd(self, word: str) -> bool:
        """Whether a word looks disguised: a sign or separator among letters, or a letter three times."""
        core = word.strip(AROUND)
        if core.isalpha():
            return THRICE.search(core) is not None
        return DISGUISE.issuperset(core) and sum([c in self.codes for c in core]) >= 2

    @staticmethod
    def edges(seen: str) -> list[bool]:
        """Which characters stand around a word: those may be signs of a sentence as well as letters."""
        out = [False] * len(seen)
        if EDGE.isdisjoint(seen):  # separators may be dropped anywhere
            return out
        for m in WORD.finditer(seen):
            core = m.group().strip(AROUND)
            lead = len(m.group()) - len(m.group().lstrip(AROUND))
            for k in [*range(m.start(), m.start() + lead), *range(m.start() + lead + len(core), m.end())]:
                out[k] = True
        return out

    def decode(self, seen: str) -> str:
        """Viterbi over the lattice; a state is the last two letters that were read."""
        best: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        cost, codes, edge = self.cost, self.codes, self.edges(seen)
        runs = [1] * len(seen)  # the length of the run that each character stands in
        for k in range(1, len(seen)):
            runs[k] = runs[k - 1] + 1 if seen[k] == seen[k - 1] else 1
        for k in range(len(seen) - 2, -1, -1):
            runs[k] = runs[k + 1] if seen[k] == seen[k + 1] else runs[k]
        for k, c in enumerate(seen):
            after: dict[tuple[int, int], tuple[float, str]] = {}
            own = [(c, 0.0)] if c in codes else [(x, SWAP) for x in SUBSTITUTES.get(c, "")]
            run = k > 0 and seen[k - 1] == c
            for (a, b), (so_far, text) in best.items():
                for x, price in own:
                    i = codes[x]
                    total = so_far + price + cost[a][b][i]
                    if total < after.get((b, i), (math.inf,))[0]:
                        after[b, i] = (total, text + x)
                drop = SKIP if edge[k] or c in SEPARATORS and not run else (REPEAT if runs[k] > 2 else DOUBLE) if run else FOREIGN
                if c not in codes or run:
                    total = so_far + drop
                    if total < after.get((a, b), (math.inf,))[0]:
                        after[a, b] = (total, text)
            best = after
        return min((so_far + cost[a][b][0], text) for (a, b), (so_far, text) in best.items())[1]

    def decode_plain(self, seen: str, pieces: list[str]) -> list[str]:
        """decode_run where every sign is a letter that differs from the one before, so that it can only stand for itself.

        At most two states remain after the first letter of a piece (the gap dropped, or a border) and one after its second.
        """
        cost, codes = self.cost, self.codes
        states: list[tuple[int, int, float, tuple | None]] = []
        for piece in pieces:
            i = codes[piece[0]]
            if not states:
                states = [(0, i, (0.0 if seen[0] in codes else SKIP) + cost[0][0][i], (None, piece))]
            else:
                drop = border = math.inf
                for a, b, so_far, read in states:
                    own = cost[a][b]
                    total = so_far + SKIP + own[i]
                    if total < drop:
                        drop, dropped = total, read
                    total = so_far + own[0]
                    if total < border:
                        border, ended = total, read
                states = [(b, i, drop, (dropped, piece)), (0, i, border + cost[b][0][i], (ended, " " + piece))]
            for c in piece[1:]:
                j = codes[c]
                a, b, best, read = states[0]
                best += cost[a][b][j]
                if len(states) > 1:
                    a, _, other, known = states[1]
                    other += cost[a][b][j]
                    if other < best:
                        best, read = other, known
                states = [(b, j, best, read)]
        out, read = [], min(((so_far + cost[a][b][0], n, read) for n, (a, b, so_far, read) in enumerate(states)), default=(0, 0, None))[2]
        while read is not None:
            read, x = read
            out.append(x)
        return "".join(reversed(out)).split()

    def decode_run(self, seen: str) -> list[str]:
        """The words of a text in pieces: as decode, but each blank or separator is dropped or a border of words.  Time and memory are linear."""
        pieces = seen.translate(BLANKS).split()
        letters = "".join(pieces)
        if self.codes.keys() >= set(letters) and not any(map(operator.eq, letters, letters[1:])):
            return self.decode_plain(seen, pieces)
        return self.decode_lattice(seen)

    def decode_lattice(self, seen: str) -> list[str]:
        """decode_run for any signs."""
        cost, codes = self.cost, self.codes
        signs, gaps, edge = [], [], []  # characters, how many blanks and separators stand before each, whether it stands around a word
        between = 0
        for c, around in zip(seen, self.edges(seen)):
            if c.isspace() or c in SEPARATORS:
                between += 1
            else:
                signs.append(c)
                gaps.append(between)
                edge.append(around)
                between = 0
        runs = [1] * len(signs)
        if any(map(operator.eq, signs, signs[1:])):
            for k in range(1, len(signs)):
                runs[k] = runs[k - 1] + 1 if signs[k] == signs[k - 1] else 1
            for k in range(len(signs) - 2, -1, -1):
                runs[k] = runs[k + 1] if signs[k] == signs[k + 1] else runs[k]
        # a state is the last two letters that were read, 0 for a border; a reading is a chain of letters from its end
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for k, c in enumerate(signs):
            if gaps[k]:
                apart: dict[tuple[int, int], tuple[float, tuple | None]] = {}
                for (a, b), (so_far, read) in best.items():
                    old = apart.get((a, b))
                    if old is None or so_far + SKIP < old[0]:
                        apart[a, b] = (so_far + SKIP, read)
                    if b:
                        total = so_far + cost[a][b][0]
                        old = apart.get((b, 0))
                        if old is None or total < old[0]:
                            apart[b, 0] = (total, (read, " "))
                best = apart
            run = k > 0 and signs[k - 1] == c
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            i = codes.get(c)
            if i and not run:  # a letter stands for itself
                for (a, b), (so_far, read) in best.items():
                    total = so_far + cost[a][b][i]
                    old = after.get((b, i))
                    if old is None or total < old[0]:
                        after[b, i] = (total, (read, c))
                best = after
                continue
            own = [(c, i, 0.0)] if i else [(x, codes[x], SWAP) for x in SUBSTITUTES.get(c, "")]
            drop = SKIP if edge[k] else (REPEAT if runs[k] > 2 else DOUBLE) if run else FOREIGN
            for (a, b), (so_far, read) in best.items():
                for x, i, price in own:
                    total = so_far + price + cost[a][b][i]
                    old = after.get((b, i))
                    if old is None or total < old[0]:
                        after[b, i] = (total, (read, x))
                old = after.get((a, b))
                if old is None or so_far + drop < old[0]:
                    after[a, b] = (so_far + drop, read)
            best = after
        read = min(((so_far + (cost[a][b][0] if b else 0.0), n, read) for n, ((a, b), (so_far, read)) in enumerate(best.items())))[2]
        out = []
        while read is not None:
            read, x = read
            out.append(x)
        return "".join(reversed(out)).split()

    def run(self, seen: str) -> list[str]:
        """decode_run, remembered for short ones."""
        out = self.known_runs.get(seen)
        if out is None:
            out = self.decode_run(seen)
            if len(seen) <= LONG:  # longer ones hardly come back
                if len(self.known_runs) > REMEMBERED:
                    self.known_runs.clear()
                self.known_runs[seen] = out
        return out

    def word(self, seen: str) -> str:
        """seen: lower case, without separators.  The word's letters, restored if it looks disguised; only such words are remembered."""
        out = self.known.get(seen)
        if out is None:
            if not self.odd(seen):
                return seen.strip(AROUND)
            if len(self.known) > REMEMBERED:
                self.known.clear()
            core = seen.strip(AROUND)
            unknown = core.isalpha() and not all([c in self.codes for c in core])
            out = self.known[seen] = REPEATED.sub(r"\1", core) if unknown else self.decode(seen)
        return out


def plain(text: str | None) -> str:
    """Lower case, with full-width and other forms of letters as the plain ones, without characters of no width."""
    low = (text or "").lower()
    if low.isascii():
        return low
    return unicodedata.normalize("NFKC", WIDTHLESS.sub("", low))


def thrice(low: str) -> bool:
    """Whether a letter stands three times in a row anywhere."""
    c = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    again = c[1:] == c[:-1]
    return any([low[at].isalpha() for at in np.flatnonzero(again[1:] & again[:-1]).tolist()])


def spaced(words: list[str]) -> Iterator[str]:
    """Runs of two or more pieces among the words of a text; the last may have punctuation behind it."""
    short = [i for i, w in enumerate(words) if len(w) <= PIECE]
    ends = [i for i, after in zip(short, [*short[1:], -2]) if after != i + 1]
    starts = [i for i, before in zip(short, [-2, *short]) if before != i - 1]
    for lo, hi in zip(starts, ends):
        hi += 1
        last = LAST.match(words[hi]) if hi < len(words) else None
        if last:
            yield " ".join([*words[lo:hi], last.group()])
        elif hi - lo > 1:
            yield " ".join(words[lo:hi])


def restored_words(text: str | None, restorer: Restorer) -> set[str]:
    """The distinct words of a whole text, disguised ones restored."""
    low = plain(text)
    all_words = low.split()
    seen, repeated = set(all_words), thrice(low)
    words = set() if repeated else {w for w in seen if w.isalpha()}
    for w in seen - words:
        core = w.strip(AROUND)
        if core.isalpha() and not (repeated and THRICE.search(core)):
            words.add(core)
        elif not core.isalpha() and not SEPARATORS.isdisjoint(core) and restorer.odd(w):
            words.update(restorer.run(w))  # one word, or several, with separators between
        else:
            words.add(restorer.word(w))
    for run in spaced(all_words):
        if sum([c in restorer.codes for c in run]) >= 2:
            words.update(restorer.run(run))
    words.discard("")
    return words


def features(word: str) -> list[str]:
    return ["=" + word, *[word[:n] for n in BEGINNINGS if n <= len(word)]]


def feature_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the features of words: of which word, how many letters of it (0: the whole word), hash."""
    c = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    whole = np.array([xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words], dtype=np.uint64)
    which, letters, found = [np.arange(len(words))], [np.zeros(len(words), dtype=np.int64)], [whole]
    at, h = np.arange(len(words)), np.zeros(len(words), dtype=np.uint64)
    for n in range(1, BEGINNINGS[-1] + 1):
        long = sizes[at] >= n
        at, h = at[long], h[long]
        h = mixed(h * np.uint64(BASE) + c[starts[at] + n - 1])
        if n in BEGINNINGS:
            which.append(at)
            letters.append(np.full(len(at), n))
            found.append(h)
    return np.concatenate(which), np.concatenate(letters), np.concatenate(found)


class FeatureCounts:
    """In how many rows of each label a feature is, by 64-bit hashes; those of toxic rows have their names with them."""

    def __init__(self):
        self.rows, self.names = [0, 0], {}
        self.values, self.n = [np.zeros(0, np.uint64)] * 2, [np.zeros(0, np.int64)] * 2
        self.seen, self.held = ([], []), 0
        self.words, self.sizes = ([], []), ([], [])

    def add(self, words: set[str], toxic: int) -> None:
        self.rows[toxic] += 1
        self.words[toxic].extend(words)
        self.sizes[toxic].append(len(words))
        if len(self.words[toxic]) >= HASHED:
            self.hash(toxic)
            if self.held >= MERGED:
                self.merge()

    def hash(self, toxic: int) -> None:
        words, sizes = self.words[toxic], self.sizes[toxic]
        which, letters, h = feature_hashes(words)
        row = np.repeat(np.arange(len(sizes)), sizes)[which]
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        once = np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, bool)  # a feature counts once a row
        if toxic:
            at = order[once]
            for x, i, n in zip(h[once].tolist(), which[at].tolist(), letters[at].tolist()):
                if x not in self.names:
                    self.names[x] = words[i][:n] if n else "=" + words[i]
        self.seen[toxic].append(h[once])
        self.held += len(self.seen[toxic][-1])
        words.clear()
        sizes.clear()

    def merge(self) -> None:
        for k in (0, 1):
            self.hash(k)
            both = np.concatenate([self.values[k], *self.seen[k]])
            order = np.argsort(both)
            both = both[order]
            starts = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
            n = np.concatenate([self.n[k], np.ones(len(both) - len(self.n[k]), np.int64)])[order]
            self.values[k], self.n[k] = both[starts], np.add.reduceat(n, starts) if len(both) else n
            self.seen[k].clear()
        self.held = 0

    def full(self) -> bool:
        return sum(map(len, self.values)) > HELD or len(self.names) > NAMED

    def told(self) -> Iterator[pd.DataFrame]:
        """What has been counted so far, in parts; counts start anew.  Without a feature: a number of rows (key null), or a feature of clean rows."""
        self.merge()
        yield pd.DataFrame({"key": pd.array([None, None], dtype="Int64"), "feature": pd.Series([None, None], dtype=object), "toxic": [0, 1], "n": self.rows})
        for k in (0, 1):
            for at in range(0, len(self.n[k]), 100_000):
                h = self.values[k][at : at + 100_000]
                names = [self.names[x] for x in h.tolist()] if k else [None] * len(h)
                yield pd.DataFrame({"key": pd.array(h.view(np.int64), dtype="Int64"), "feature": pd.Series(names, dtype=object), "toxic": k, "n": self.n[k][at : at + 100_000]})
        self.__init__()


class WordScores(dict):
    """The greatest log-odds among a word's features, 0 if none counts.  heads: how words with a feature that counts begin."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights
        self.heads = {x[:3] for f in weights for x in (f, f.removeprefix("="))}

    def __missing__(self, word: str) -> float:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = best = max([0.0, *(self.weights[f] for f in features(word) if f in self.weights)])
        return best


def document_values(words: set[str], scores: WordScores) -> tuple[float, float]:
    total = math.fsum([scores[w] for w in words if w[:3] in scores.heads])
    return math.log1p(total), math.log1p(100 * total / (len(words) + 20))


def _restorer(model: bytes) -> Restorer:
    return Restorer(np.frombuffer(model, dtype=np.float16).astype(np.float32).reshape(SIZE, SIZE, SIZE))


def restorer_of(model: bytes) -> Restorer:
    """One for all tasks of a Python worker that have the same model."""
    return in_worker(_restorer, model)


def learn(rows: DataFrame, labels: DataFrame, model: bytes, keep: list[str] | None = None, values: str = "_values") -> tuple[dict[str, float], DataFrame]:
    """rows: doc_id, text and others; labels: doc_id, toxic, a bounded number.  Weights of features, and the columns `keep` (or all) of rows with the document values, written."""
    known = with_labels(rows.select("doc_id", "text"), labels).select("text", "toxic")

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer, counted = restorer_of(model), FeatureCounts()
        for b in batches:
            for t, toxic in zip(b["text"], b["toxic"]):
                counted.add(restored_words(t, restorer), int(toxic == 1))
                if counted.full():
                    yield from counted.told()
        yield from counted.told()

    counted = known.mapInPandas(counts, "key long, feature string, toxic int, n long").groupBy("key")
    counted = counted.agg(F.max("feature").alias("feature"), F.coalesce(F.sum(F.when(F.col("toxic") == 1, F.col("n"))), F.lit(0)).alias("toxic"), F.coalesce(F.sum(F.when(F.col("toxic") == 0, F.col("n"))), F.lit(0)).alias("clean"))
    counted = materialise(counted.where(F.col("key").isNull() | (F.col("toxic") >= LEAST_ROWS)), "features")
    all_rows = counted.where("key is null").select("toxic", "clean").first() or (0, 0)
    share = lambda c, n: F.log((F.col(c) + 0.5) / (n + 1))
    odds = counted.where("key is not null").select("feature", (share("toxic", all_rows[0]) - share("clean", all_rows[1])).alias("odds"))
    weights = {r["feature"]: r["odds"] for r in odds.where(F.col("odds") >= LEAST).collect()}  # features of at most TRAIN_ROWS rows

    places = [i for i, name in enumerate(rows.schema.names) if keep is None or name in keep]
    kept = T.StructType([rows.schema.fields[i] for i in places])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, scores = restorer_of(model), WordScores(weights)
        for b in batches:
            out = np.array([document_values(restored_words(t.as_py(), restorer), scores) for t in b.column("text")]).reshape(-1, 2)
            own = pa.StructArray.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["x", "y"])
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in places], own], names=[*kept.names, values])

    schema = T.StructType([*kept.fields, T.StructField(values, T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))])
    return weights, materialise(rows.mapInArrow(measure, schema), "measured")


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that have a label, with it; labels are of a bounded number."""
    return rows.withColumn("doc_id", F.col("doc_id").cast("long")).join(F.broadcast(labels), "doc_id")


def logistic_curve(seen: pd.DataFrame) -> np.ndarray:
    """Weights of 1, x and y for toxic."""
    a, t = np.column_stack([np.ones(len(seen)), seen["x"], seen["y"]]), seen["toxic"].to_numpy(dtype=float)
    w = np.zeros(3)
    for _ in range(50):  # Newton, with a penalty that keeps separable data finite
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(3), a.T @ (t - p) - 1e-2 * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


@in_small_batches
def with_scores(rows: DataFrame, labels: DataFrame, score: str = "score", train_rows: int = TRAIN_ROWS, keep: list[str] | None = None) -> DataFrame:
    """rows (doc_id, text and others; of these the columns `keep`, or all) with their scores.  The character model covers all rows, the rest is learned from labelled ones outside the held-out fold."""
    model = character_model(character_counts(rows)).astype(np.float16).tobytes()
    given = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    given = given.where(F.expr(FOLD_SQL) != 1)
    n = given.count()
    if n > train_rows:
        given = given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    given = materialise(given, "labels")
    values = own_name(rows, "_values")
    _, measured = learn(rows, given, model, keep, values)
    x, y = F.col(values)["x"], F.col(values)["y"]
    known = measured.select("doc_id", x.alias("x"), y.alias("y"))
    c = logistic_curve(with_labels(known, given).select("x", "y", "toxic").toPandas())  # at most TRAIN_ROWS rows, two numbers each
    at = F.least(F.greatest(F.lit(float(c[0])) + x * float(c[1]) + y * float(c[2]), F.lit(-30.0)), F.lit(30.0))
    return measured.withColumn(score, 1 / (1 + F.exp(-at))).drop(values)


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row; labels: doc_id, toxic."""
    held = F.coalesce(F.expr(FOLD_SQL) == 1, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = with_scores(rows, labels, train_rows=train_rows, keep=["doc_id"])
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs (doc_id, text and others) whose score is below the threshold."""
    score = own_name(docs, "_score")
    return with_scores(docs, labels, score).where(F.col(score) < threshold).drop(score)


def op4_deobfuscated_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

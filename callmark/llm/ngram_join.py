"""Operator 6: n-gram Jaccard join with signature trees.

A document is its set of word shingles.  Documents with equal sets are one class, of which the least doc_id
stands for all.  Two sets with Jaccard similarity t must share one of the first |x| - ceil(t |x|) + 1 shingles
of an order (frequent ones last, then by hash), so that classes meet in groups, one per such shingle; groups
of one are gone at once.  Within a group the sets hang in a signature tree: nodes hold OR- and AND-combined
token bitmaps and size ranges, and a dual traversal drops node pairs whose greatest possible overlap is too
small.  What is left is verified on the whole sets.

No step emits the pairs of a group.  A first round brings each class to the least one that shares a pair of
MinHash values with it and verifies there.  The exact round looks only at what is not connected yet: each group
gives a spanning forest of the pairs that its tree can't rule out; what hangs together so is a family, which
is verified at one place, or in blocks for each pair of its parts if it is large.  The result is connectivity:
no link between different components is ever left out.

Shingles are 64-bit hashes.  Nulls and texts without words have empty sets and no links.  Rows without a
doc_id have no links and no component.  A doc_id with several texts is linked with what any of them is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callmark.llm.common import discard, in_small_batches, materialise, own_name, table
from callmark.llm.components import components
from callmark.llm.words import bytes_of, mixed, shingle_sets

WORDS, PERCENT = 5, 80
LEAST_BITS, MOST_BITS, LEAF, FAN = 256, 1 << 16, 32, 8
#: A shingle that so many prefixes of one task hold is frequent; the most frequent KEPT of them are put last (a broadcast of 8 bytes each).
FREQUENT, KEPT = 20, 100_000
#: Groups and families are dealt into parts of about so many classes, families also of so many shingles.
PART, PART_SHINGLES = 1000, 1_000_000
#: Bits of the bitmap of ids that is broadcast to keep texts nobody asks for out of shuffles.
FILTER_BITS = 1 << 26
#: Three pairs of MinHash values.
MASKS = mixed(np.arange(1, 7, dtype=np.uint64)).reshape(3, 2)
KEYS = ["home", "bi", "bj"]


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def prefix(own: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles by hash, as an array of its own: a view would keep the whole set in memory."""
    return own[: prefix_size(len(own), percent)].copy()


def narrow_width(n: int) -> int:
    """Bits of the bitmap that travels with a set of n shingles: a power of two, n at least up to 2^14."""
    return min(1 << 14, max(LEAST_BITS, 1 << int(n - 1).bit_length()))


def signature(own: np.ndarray, width: int, coarse: int | None = None) -> np.ndarray:
    """A bitmap of `width` bits.  Only the shingles whose `coarse` low bits are 0 take part; without it, as many as fill half of the bits.

    Of two sets the larger one must not be finer (`coarse` never falls with the size): what it shows and shares, the smaller one shows as well.
    """
    n, bits = len(own), np.zeros(width, dtype=np.uint8)
    if coarse is None:
        coarse = max(0, int(n - 1).bit_length() - (width // 2).bit_length() + 1) if n else 0
    part = own[(own & np.uint64((1 << coarse) - 1)) == 0] if coarse else own
    bits[(part >> np.uint64(40)) % np.uint64(width)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def narrow(own: np.ndarray) -> np.ndarray:
    """The bitmap that travels: of all shingles of sets up to 2^14, of fewer beyond."""
    return signature(own, narrow_width(len(own)), max(0, int(len(own) - 1).bit_length() - 14))


def folded(bits: np.ndarray) -> np.ndarray:
    """Bitmaps of half the width."""
    half = bits.shape[1] // 2
    return bits[:, :half] | bits[:, half:]


def jaccard_at_least(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


class Forest:
    """Connected members; label: the same for members that hang together."""

    def __init__(self, label: np.ndarray):
        self.label = label.copy()

    def open(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return self.label[x] != self.label[y]

    def join(self, i: int, j: int) -> None:
        a, b = self.label[i], self.label[j]
        self.label[self.label == max(a, b)] = min(a, b)


class SignatureTree:
    """sizes (ascending) and bitmaps of the members; nodes over LEAF members, then over FAN nodes each.

    forest: pairs that hang together are left out.  part, component: pairs within a part, or of one component, are left out.
    """

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, percent: int, forest: Forest, part: np.ndarray | None = None, component: np.ndarray | None = None):
        self.sizes, self.bits, self.percent, self.forest = sizes, bits, percent, forest
        self.apart = [x for x in (part, component) if x is not None]
        starts = np.arange(0, len(sizes), LEAF)
        level = (np.bitwise_or.reduceat(bits, starts), np.bitwise_and.reduceat(bits, starts), np.minimum.reduceat(sizes, starts), np.maximum.reduceat(sizes, starts))
        self.levels = [level]
        while len(level[0]) > 1:
            starts = np.arange(0, len(level[0]), FAN)
            level = tuple(f.reduceat(a, starts) for f, a in zip((np.bitwise_or, np.bitwise_and, np.minimum, np.maximum), level))
            self.levels.append(level)

    def too_far(self, level: tuple, a: int, b: int) -> bool:
        """Whether no member of node a can be near one of node b (a before b, so with the smaller sets)."""
        if level[3][a] * 100 < self.percent * level[2][b]:
            return True
        overlap = level[3][b] - int(np.bitwise_count(level[1][b] & ~level[0][a]).sum())
        return overlap * (100 + self.percent) < self.percent * (int(level[2][a]) + int(level[2][b]))

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Dual traversal: numbers of members (i before j) that may be near, leaf pair by leaf pair."""
        todo = [(len(self.levels) - 1, 0, 0)]
        while todo:
            k, a, b = todo.pop()
            if a != b and self.too_far(self.levels[k], a, b):
                continue
            if k:
                n = len(self.levels[k - 1][0])
                below = lambda x: range(x * FAN, min(n, (x + 1) * FAN))
                todo += [(k - 1, x, y) for x in below(a) for y in below(b) if x <= y]
                continue
            i, j = np.arange(a * LEAF, min(len(self.sizes), (a + 1) * LEAF)), np.arange(b * LEAF, min(len(self.sizes), (b + 1) * LEAF))
            x, y = (m.ravel() for m in np.meshgrid(i, j, indexing="ij"))
            keep = (x < y) & (100 * self.sizes[x] >= self.percent * self.sizes[y]) & self.forest.open(x, y)
            for label in self.apart:
                keep &= label[x] != label[y]
            x, y = x[keep], y[keep]
            if len(x):
                near = may_be_near(self.sizes, self.bits, x, y, self.percent)
                if near.any():
                    yield x[near], y[near]


def may_be_near(sizes: np.ndarray, bits: np.ndarray, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Of the larger set's (y) shingles, those whose bit the smaller one lacks are not shared."""
    overlap = sizes[y] - np.bitwise_count(bits[y] & ~bits[x]).sum(axis=1)
    return overlap * (100 + percent) >= percent * (sizes[x] + sizes[y])


def spanning(forest: Forest, found: Iterator[tuple[np.ndarray, np.ndarray]], near=lambda i, j: True) -> list[tuple[int, int]]:
    """The pairs that are near, as far as they connect anything new."""
    out = []
    for x, y in found:
        while True:
            still = forest.open(x, y)
            x, y = x[still], y[still]
            if not len(x):
                break
            i, j = int(x[0]), int(y[0])
            x, y = x[1:], y[1:]
            if near(i, j):
                forest.join(i, j)
                out.append((i, j))
    return out


def candidate_edges(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Groups of one shingle (rows sorted by token, bi, bj, n): a spanning forest of the pairs that may be near and are not connected.

    Only rows hang together by such pairs, not those of a component: one of its rows that may be near another component says
    nothing of the others, and each pair that may be near must get into one family.
    """

    def in_groups(token, bi, bj, part, sizes, place, component, bits, own: int) -> Iterator[tuple[int, int]]:
        """Pairs of rows whose smaller one has `own` bits; all bitmaps are of that width."""
        new = (token[1:] != token[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])
        starts = np.concatenate([[0], np.flatnonzero(new) + 1, [len(token)]])
        length = np.diff(starts)
        group = np.repeat(np.arange(len(length)), length)
        small = length[group] <= LEAF
        mine = np.frompyfunc(narrow_width, 1, 1)(sizes).astype(np.int64) == own
        found_x, found_y = [np.zeros(0, int)], [np.zeros(0, int)]
        for d in range(1, int(length[length <= LEAF].max(initial=1))):  # many small groups at once: rows at each distance
            x = np.flatnonzero(small[:-d] & mine[:-d] & (group[:-d] == group[d:]) & (component[:-d] != component[d:]) & (100 * sizes[:-d] >= percent * sizes[d:]))
            y = x + d
            overlap = np.minimum(place[x], place[y]) + np.minimum(sizes[x] - place[x], sizes[y] - place[y])  # shared before this shingle, and from it on
            fits = overlap * (100 + percent) >= percent * (sizes[x] + sizes[y])
            x, y = x[fits], y[fits]
            for at in range(0, len(x), 4096):
                i, j = x[at : at + 4096], y[at : at + 4096]
                near = may_be_near(sizes, bits, i, j, percent)
                found_x.append(i[near])
                found_y.append(j[near])
        x, y = np.concatenate(found_x), np.concatenate(found_y)
        order = np.argsort(group[x], kind="stable")
        x, y = x[order], y[order]
        cuts = np.flatnonzero(np.concatenate([[True], group[x][1:] != group[x][:-1], [True]])) if len(x) else []
        for lo, hi in zip(cuts, cuts[1:]):
            at, n = starts[group[x[lo]]], length[group[x[lo]]]
            yield from ((at + i, at + j) for i, j in spanning(Forest(np.arange(n)), [(x[lo:hi] - at, y[lo:hi] - at)]))
        for k in np.flatnonzero(length > LEAF):
            at, rows = starts[k], slice(starts[k], starts[k + 1])
            forest = Forest(np.arange(length[k]))
            tree = SignatureTree(sizes[rows], bits[rows], percent, forest, part[rows] if bi[at] != bj[at] else None, component[rows])
            yield from ((at + i, at + j) for i, j in spanning(forest, ((x[mine[rows][x]], y[mine[rows][x]]) for x, y in tree.pairs())))

    def edges(t: pa.Table) -> pa.RecordBatch:
        numbers = [t[c].to_numpy() for c in ("token", "bi", "bj", "part", "n", "place", "component")]
        ids, a, b = t["doc_id"].to_numpy(), [], []
        data, bounds = bytes_of(t["bits"].combine_chunks())
        width = np.diff(bounds)
        for own in np.unique(width):  # sets that may be near have bitmaps of one width, or of the next
            rows = np.flatnonzero((width == own) | (width == 2 * own))
            bits = np.empty((len(rows), own // 8), np.uint64)
            wide = width[rows] > own
            bits[~wide] = data[bounds[rows[~wide]][:, None] + np.arange(own)].view(np.uint64)
            if wide.any():
                bits[wide] = folded(data[bounds[rows[wide]][:, None] + np.arange(2 * own)].view(np.uint64))
            for i, j in in_groups(*[x[rows] for x in numbers], bits, int(own) * 8):
                a.append(ids[rows[i]])
                b.append(ids[rows[j]])
        return pa.RecordBatch.from_arrays([pa.array(np.array(a, np.int64)), pa.array(np.array(b, np.int64))], names=["a", "b"])

    held = None
    for b in batches:
        t = pa.Table.from_batches([b] if held is None else [*held.to_batches(), b])
        other = np.zeros(t.num_rows, bool)  # rows of another block than the last row's
        for c in ("token", "bi", "bj"):
            other |= t[c].to_numpy() != t[c][-1].as_py() if t.num_rows else False
        cut = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
        if cut:
            yield edges(t.slice(0, cut))
        held = t.slice(cut)
    if held is not None and held.num_rows:
        yield edges(held)


def links_in_blocks(batches: Iterator[pa.RecordBatch], percent: int, words: int) -> Iterator[pa.RecordBatch]:
    """Blocks (rows sorted by KEYS) of classes with their texts: verified links, as far as they connect anything new."""

    def links(ids: list, parts: list, components_: list, sets: list, across: bool) -> pa.RecordBatch:
        order = np.argsort([len(s) for s in sets], kind="stable")
        sets = [sets[o] for o in order]
        sizes = np.array([len(s) for s in sets])
        width = min(MOST_BITS, max(64, 1 << int(2 * sizes[-1]).bit_length()))
        forest = Forest(np.unique(np.array(components_)[order], return_inverse=True)[1])
        tree = SignatureTree(sizes, np.array([signature(s, width) for s in sets]), percent, forest, np.array(parts)[order] if across else None)
        kept = spanning(forest, tree.pairs(), lambda i, j: jaccard_at_least(sets[i], sets[j], percent))
        ids = np.array(ids, np.int64)[order]
        return pa.RecordBatch.from_arrays([pa.array(ids[[i for i, _ in kept]]), pa.array(ids[[j for _, j in kept]])], names=["a", "b"])

    now, held = None, ([], [], [], [])
    for b in batches:
        keys = list(zip(*(b.column(k).to_pylist() for k in KEYS)))
        own = [b.column(c).to_pylist() for c in ("doc_id", "part", "component")]
        for i, shingles in shingle_sets(b.column("text"), words):
            if keys[i] != now:
                if len(held[0]) > 1:
                    yield links(*held, now[1] != now[2])
                now, held = keys[i], ([], [], [], [])
            for values, column in zip(held, own):
                values.append(column[i])
            held[3].append(shingles.copy())
    if len(held[0]) > 1:
        yield links(*held, now[1] != now[2])


def frequent_shingles(rows: DataFrame, percent: int, words: int) -> np.ndarray:
    """At most KEPT shingles that many documents have; any set of them leaves the result as it is, a good one makes groups small."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = [], 0
        values, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for b in batches:
            for _, own in shingle_sets(b.column("text"), words):
                if len(own):
                    seen.append(prefix(own, percent))
                    held += len(seen[-1])
                if held > 2_000_000:  # those that have been met once go, so that what is held stays small
                    values, n = added(values, n, seen)
                    values, n, seen, held = values[n > 1], n[n > 1], [], 0
        values, n = added(values, n, seen)
        often = n >= FREQUENT
        yield pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(n[often])], names=["token", "n"])

    def added(values: np.ndarray, n: np.ndarray, seen: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        more, m = np.unique(np.concatenate([np.zeros(0, np.uint64), *seen]), return_counts=True)
        both, at = np.unique(np.concatenate([values, more]), return_inverse=True)
        return both, np.bincount(at, weights=np.concatenate([n, m]), minlength=len(both)).astype(np.int64)

    top = rows.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(KEPT)
    return np.sort(np.array([r["token"] for r in top.select("token").collect()], dtype=np.int64).view(np.uint64))


def sketches(rows: DataFrame, frequent: np.ndarray, percent: int, words: int) -> DataFrame:
    """doc_id, n, key (of the set), prefix, mins (three keys of two MinHash values each), bits."""
    import xxhash

    types = {"n": pa.int64(), "key": pa.string(), "prefix": pa.list_(pa.int64()), "mins": pa.list_(pa.int64()), "bits": pa.binary()}

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {c: [] for c in types}
            for _, own in shingle_sets(b.column("text"), words):
                n = len(own)
                out["n"].append(n)
                if not n:
                    for c in ("key", "prefix", "mins", "bits"):
                        out[c].append(None)
                    continue
                p = prefix_size(n, percent)
                often = frequent[np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)] == own if len(frequent) else np.zeros(n, bool)
                first = own[~often][:p]
                mins = [int(mixed(np.array([(own ^ m).min() for m in pair])).view(np.int64).sum()) for pair in MASKS]
                out["key"].append(xxhash.xxh3_128_hexdigest(own.tobytes()))
                out["prefix"].append(np.concatenate([first, own[often][: p - len(first)]]).view(np.int64))
                out["mins"].append(mins)
                out["bits"].append(narrow(own).tobytes())
            columns = {c: pa.array(v, types[c]) for c, v in out.items()}
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns.values()], names=["doc_id", *columns])

    return rows.mapInArrow(sketch, "doc_id long, n long, key string, prefix array<long>, mins array<long>, bits binary")


def parts_of(count: Column, shingles: Column | None = None) -> Column:
    by_count = F.ceil(count / PART)
    return (by_count if shingles is None else F.greatest(by_count, F.ceil(shingles / PART_SHINGLES))).cast("int")


def dealt(members: DataFrame, *ids: str) -> DataFrame:
    """Rows with _parts are dealt to the blocks of all pairs of parts: part, bi, bj."""
    own = members.withColumn("part", F.pmod(F.xxhash64(*ids), F.col("_parts")).cast("int"))
    other = own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return other.select("*", F.least("part", "_other").alias("bi"), F.greatest("part", "_other").alias("bj")).drop("_other", "_parts")


def possibly_among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id may be among ids, and few others, by a bitmap over hashes: at most FILTER_BITS / 64 rows, whatever the data."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    word, bit = F.shiftright(place, 6), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))
    bitmap = ids.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    kept = rows.withColumn("_word", word).join(F.broadcast(bitmap), "_word").where(F.col("_bits").bitwiseAND(bit) != 0)
    return kept.select(*rows.columns)


def verified_links(blocks: DataFrame, rows: DataFrame, percent: int, words: int) -> DataFrame:
    """blocks: KEYS, doc_id, part, component."""
    blocks = materialise(blocks, "blocks")
    met = blocks.join(possibly_among(rows, blocks), "doc_id").repartition(*KEYS).sortWithinPartitions(*KEYS)
    return met.mapInArrow(lambda b: links_in_blocks(b, percent, words), "a long, b long")


@in_small_batches
def ngram_components(docs: DataFrame, percent: int = PERCENT, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, class_id (least doc_id with the same set), component_id, of every row.  percent: from 50 on."""
    if not 50 <= percent <= 100:
        raise ValueError("percent must lie between 50 and 100")  # bitmaps of linked sets differ in width by no more than one step
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketched = materialise(sketches(rows, frequent_shingles(rows, percent, words), percent, words), "sketches")
    known = sketched.where("n > 0 and doc_id is not null")
    classes = materialise(known.groupBy("key").agg(F.min("doc_id").alias("class_id")), "classes")
    classed = known.join(classes, "key")
    first = materialise(classed.where("doc_id = class_id").dropDuplicates(["key"]).select("doc_id", "n", "prefix", "mins", "bits"), "class-sketches")
    keys = materialise(sketched.select("doc_id", "n", "key"), "keys")
    discard(sketched)  # from here on only the classes' own sketches are read
    classed = keys.where("n > 0 and doc_id is not null").join(classes, "key")
    postings = first.select("doc_id", F.posexplode("prefix").alias("place", "token"))
    shared = postings.groupBy("token").agg(F.count("*").alias("_n")).where("_n > 1").select("token")
    live = materialise(postings.join(shared, "token", "left_semi"), "postings")

    # an id with several texts
    several = classed.groupBy("doc_id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("_b")).where("a <> _b").select("doc_id", "a")
    same_id = classed.join(several, "doc_id").select("a", F.explode(F.array("class_id", "doc_id")).alias("b"))

    # first round: to the least class that shares a MinHash key
    mins = first.join(live.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "n", F.posexplode("mins").alias("k", "value"))
    least = mins.groupBy("k", "value").agg(F.min("doc_id").alias("home"), F.count("*").alias("_m")).where("_m > 1").drop("_m")
    met = materialise(mins.join(least, ["k", "value"]).where("doc_id <> home").groupBy("home", "doc_id").agg(F.max("n").alias("n")), "met")
    homes = met.groupBy("home").agg(parts_of(F.count("*"), F.sum("n")).alias("_parts"))
    block = F.pmod(F.xxhash64("doc_id"), F.col("_parts")).cast("int")
    members = met.join(homes, "home").select("home", "doc_id", block.alias("bi"))
    leaders = homes.select("home", F.col("home").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("bi"))
    stars = members.unionByName(leaders).select("*", F.col("bi").alias("bj"), F.lit(0).alias("part"), F.col("doc_id").alias("component"))
    links = materialise(verified_links(stars, rows, percent, words).unionByName(same_id), "links-1")
    joined = components(links)

    # exact round, over what is not connected yet
    placed = live.join(joined.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    open_ = placed.groupBy("token").agg(F.min("component").alias("_a"), F.max("component").alias("_b"), parts_of(F.count("*")).alias("_parts")).where("_a <> _b").drop("_a", "_b")
    tried = dealt(placed.join(open_, "token"), "doc_id").join(first.select("doc_id", "n", "bits"), "doc_id")
    tried = tried.repartition("token", "bi", "bj").sortWithinPartitions("token", "bi", "bj", "n")
    edges = tried.mapInArrow(lambda b: candidate_edges(b, percent), "a long, b long")
    edges = materialise(edges.distinct(), "candidate-edges")
    discard(live)
    family = components(edges).select(F.col("node").alias("doc_id"), F.col("component").alias("home"))
    family = family.join(first.groupBy("doc_id").agg(F.max("n").alias("n")), "doc_id")
    family = materialise(family, "families")
    discard(first)
    sizes = family.groupBy("home").agg(parts_of(F.count("*"), F.sum("n")).alias("_parts"))
    blocks = dealt(family.drop("n").join(sizes, "home"), "doc_id")
    blocks = blocks.join(joined.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    more = materialise(verified_links(blocks, rows, percent, words), "links-2")
    whole = components(links.unionByName(more))

    named = keys.join(classes, "key", "left")
    named = named.join(whole.withColumnsRenamed({"node": "class_id"}), "class_id", "left")
    known_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "class_id", "doc_id"))
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"), known_id.alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """The document with the least doc_id of each component, once (of several texts the least); rows without a doc_id all stay."""
    first = ngram_components(docs, percent, words).where("doc_id = component_id").select("doc_id").distinct()
    turn = own_name(docs, "_turn")
    kept = docs.join(materialise(first, "kept"), "doc_id", "left_semi").withColumn(turn, F.row_number().over(Window.partitionBy("doc_id").orderBy("text")))
    return kept.where(F.col(turn) == 1).drop(turn).unionByName(docs.where("doc_id is null"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"), percent=90, words=3)

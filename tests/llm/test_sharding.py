import zlib
from collections import Counter, defaultdict

import pytest

from callmark.llm import sharding
from callmark.llm.sharding import Segments, minimax_shards, op3_minimax_shards
from tests.llm.conftest import SF, documents


def least_capacity(sizes, shards):
    def fits(c):
        used, room = 1, c
        for s in sizes:
            if s > c:
                return False
            if s > room:
                used, room = used + 1, c
            room -= s
        return used <= shards

    c = max(sizes)
    while not fits(c):
        c += 1
    return c


@pytest.mark.parametrize("shards,sizes", [(3, [1, 2, 3, 4, 5, 6, 7, 8, 9]), (4, [5, 1, 1, 40, 1, 2, 9]), (5, [3] * 17), (2, [7])])
def test_capacity_against_brute_force(shards, sizes):
    seen = Segments([(i, 0, s, 1) for i, s in enumerate(sizes)])
    capacity = seen.capacity(shards, max(sizes))
    assert capacity == least_capacity(sizes, shards)
    cuts = seen.cuts(capacity, shards)
    borders = [0, *cuts, sum(sizes)]
    assert borders == sorted(borders) and max(b - a for a, b in zip(borders, borders[1:])) == capacity or capacity >= max(b - a for a, b in zip(borders, borders[1:]))


def checked(spark, folder, rows):
    docs = documents(spark, folder)
    size = lambda t: len((t or "").encode()) + 8
    assert len(rows) == len(docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in docs)
    slots, shard_of = defaultdict(list), {}
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert 0 <= r["shard"] < 24 and r["law"] == "bytes" and r["grown_shard"] is None
        assert shard_of.setdefault((r["text_crc32"], r["size"]), r["shard"]) == r["shard"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = Counter()
    for _, t in docs:
        groups[t or ""] += size(t)
    filled = Counter()
    for r in rows:
        filled[r["shard"]] += r["size"]
    total, largest = sum(groups.values()), max(groups.values())
    assert max(filled.values()) <= rows[0]["capacity"] <= max(-(-total // 24) + largest, largest)
    return filled


def test_odd_rows(spark, odd):
    checked(spark, odd, op3_minimax_shards(spark, odd).collect())


def test_near_equal_sizes(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SINGLE_GROUPS", 10)  # the search goes down step by step
    filled = checked(spark, SF, op3_minimax_shards(spark, SF).collect())
    assert max(filled.values()) < 1.5 * sum(filled.values()) / 24


def test_capacity_is_minimal_over_the_order(spark, odd):
    rows = minimax_shards(spark.read.parquet(f"{odd}/documents.parquet"), 3)
    from pyspark.sql import functions as F

    text = F.coalesce("text", F.lit(""))
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    sizes = [r[1] for r in sorted(docs.groupBy(F.shiftrightunsigned(F.xxhash64(text), 1)).agg(F.sum(F.octet_length(text) + 8)).collect())]
    assert rows.first()["capacity"] == least_capacity(sizes, 3)


def test_empty(spark, empty):
    assert op3_minimax_shards(spark, empty).collect() == []

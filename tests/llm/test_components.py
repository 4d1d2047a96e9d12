import random

from callmark.llm import components as C


def brute(links):
    root = {i: i for pair in links for i in pair if pair[0] != pair[1]}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        if a != b:
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {i: find(i) for i in root}


def test_links_shrink_by_rounds(spark, monkeypatch):
    """A long chain, stars, double and turned links, links of a node with itself: right, and the tables of all rounds hold few rows."""
    written, materialise = [], C.materialise

    def told(df, name):
        out = materialise(df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(C, "materialise", told)
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000 + i, 5000 if i % 2 else 900) for i in range(200)]
    links = [*chain, *star, (7, 6), (7, 7), (8000, 8000), (2**60, 2**60 + 1), (-3, 2**60)]
    links += [(b, a) for a, b in rng.sample(links, 50)]
    got = C.components(spark.createDataFrame(links, "a long, b long").repartition(3)).collect()
    assert len(got) == len(brute(links)) and {r["node"]: r["component"] for r in got} == brute(links)
    assert sum(written) < 8 * 503


def test_no_links(spark):
    assert C.components(spark.createDataFrame([(1, 1)], "a long, b long")).collect() == []

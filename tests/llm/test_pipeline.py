import re

import corpus_pipeline
from callmark.llm.common import table
from tests.llm.conftest import SF, documents
from tests.llm.test_ngram_join import brute_set
from tests.llm.test_secrets import brute as brute_secrets
from tests.llm.test_suffixes import brute as brute_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def stages(spark, folder):
    docs = table(spark, folder, "documents")
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.materialise(stage(spark, docs, folder), "stage")
        yield name, docs, after
        docs = after


def test_each_stage_on_its_own_input(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for name, before, after in stages(spark, SF):
        had, has = {r["doc_id"]: r for r in before.collect()}, {r["doc_id"]: r for r in after.collect()}
        if name == "packing":
            assert {r["doc_id"] for r in after.select("doc_id").collect()} == set(had)
            continue
        assert after.columns == COLUMNS and len(has) == after.count()
        if name == "toxicity":
            gone = set(had) - set(has)
            assert not any(labels.get(i) == 0 for i in gone) and sum(labels.get(i) == 1 for i in gone) > 35
            assert all(has[i] == had[i] for i in has)
        elif name == "near duplicates":
            sets = {i: frozenset(shingles(r["text"])) for i, r in had.items()}
            near = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
            kept = sorted(has)
            assert not any(near(a, b) for k, a in enumerate(kept) for b in kept[:k] if sets[a])
            assert all(has[i] == had[i] for i in has)
            for i in set(had) - set(has):
                assert any(j < i and near(i, j) for j in had)
        elif name == "repeated passages":
            assert set(has) == set(had)
            want = brute_repeats([(i, r["text"]) for i, r in had.items()])
            assert brute_repeats([(i, r["text"]) for i, r in has.items()]) == {}
            assert all(has[i]["text"] == had[i]["text"] for i in had if i not in want)
        elif name == "secrets":
            assert set(has) == set(had)
            assert not any(brute_secrets(r["text"]) for r in has.values())
            assert all(r["n_chars"] == len(r["text"]) for r in has.values())


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []


def test_odd_and_empty(spark, odd, empty):
    assert brute_set("a b") and len(documents(spark, odd)) > 0
    rows = corpus_pipeline.run(spark, odd).collect()
    assert rows and {"doc_id", "sequence_id", "offset", "length"} <= set(rows[0].asDict())
    assert corpus_pipeline.run(spark, empty).collect() == []

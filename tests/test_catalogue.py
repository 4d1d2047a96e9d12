"""Every query with SQL against DuckDB, and streams against batches."""

import duckdb
import pytest
from pyspark.sql import functions as F

from callmark.operators import intervals, strata
from callmark.plans.catalogue import ORACLE, QUERIES
from callmark.streaming.sessions import sessions

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    r = duck.execute(ORACLE[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    want = sorted(tuple(str(row[names.index(c)]) for c in cols) for row in r.fetchall())
    assert sorted(tuple(str(row[c]) for c in cols) for row in df.collect()) == want


def test_islands_across_bins(spark):
    """Runs that reach over many bins, against a plain scan."""
    import random

    rng = random.Random(8)
    rows = [("a", s := rng.randrange(4000), s + rng.choice([0, 1, 5, 300])) for _ in range(300)]
    df = spark.createDataFrame(rows, "chrom string, start long, stop long")
    got = sorted((r["start"], r["stop"], r["island_start"]) for r in intervals.islands(df, ["chrom"], "start", "stop", 3, bin_width=64).collect())
    want, reach, first = [], None, None
    for _, s, e in sorted(rows):
        if reach is None or reach + 3 < s:
            first = s
        reach = e if reach is None else max(reach, e)
        want.append((s, e, first))
    assert got == sorted(want)


def test_stream_of_sessions(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = sessions(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), late="1 hour")
    q = stream.writeStream.format("memory").queryName("seen").outputMode("append").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    cut = events.agg(F.max("ts") - F.expr("interval 3 hours")).first()[0]
    want = {tuple(r) for r in sessions(events).where(F.col("last_ts") < F.lit(cut)).collect()}
    assert want and want <= {tuple(r) for r in spark.table("seen").collect()}


def test_floor_and_strata(spark):
    rows = spark.createDataFrame([(0.0, "FN"), (0.0, "TP"), (2.0, "FN")], "level double, d string")
    assert [r[0] for r in rows.select(strata.floor_level(F.col("level"), F.col("d"))).collect()] == [strata.TINY, 0.0, 2.0]

"""Keyed tables: changes rewrite what they touch, and stored rows aren't shuffled."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from sievelight.operators import buckets, store

SCHEMA = "k long, v string, seq int"


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


@pytest.fixture
def table(spark, tmp_path):
    rows = spark.range(400).select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("v"), F.lit(1).alias("seq"))
    t = buckets.create(rows, f"t{uuid.uuid4().hex}", str(tmp_path / "t"), ["k"], parts=16, buckets=4)
    yield t, str(tmp_path / "t")
    spark.sql(f"DROP TABLE {t.name}")


def test_untouched_files_stay(spark, table):
    t, path = table
    before = files(path)
    new = spark.createDataFrame([(7, "new", 2), (1007, "more", 1)], SCHEMA)
    t.upsert(new)
    after = files(path)
    changed = {f.split("_part=")[1].split("/")[0] for f in set(before) ^ set(after)}
    assert len(changed) <= 2 and len(set(before) & set(after)) > 40
    assert all(before[f] == after[f] for f in set(before) & set(after))
    assert sorted(map(tuple, t.rows().filter("k in (6, 7, 1007)").collect())) == [(6, "v6", 1), (7, "new", 2), (1007, "more", 1)]
    assert t.rows().count() == 401


def test_stored_rows_are_not_shuffled(spark, table):
    t, _ = table
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = t.merged(spark.createDataFrame([(7, "new", 2)], SCHEMA), "seq")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    side = plan[plan.index("FullOuter") :]
    stored = side[: side.index("ObjectHashAggregate") if "ObjectHashAggregate" in side else side.index("SortAggregate")]
    assert "FileScan parquet" in stored and "Bucketed: true" in stored and "Exchange" not in stored.split("FileScan")[0]
    assert "PartitionFilters: [_part" in stored.replace("isnotnull(_part", "_part").replace("[(_part", "[_part")


@pytest.mark.parametrize("seq", [None, "seq"])
def test_changes_equal_the_plain_store(spark, table, seq):
    import random

    t, path = table
    r = random.Random(3)
    now = spark.createDataFrame(t.rows().collect(), SCHEMA)
    for n in range(3):
        keys = r.sample(range(500), 30)
        rows = spark.createDataFrame([(k, f"n{n}", r.choice([0, 1, 2, None])) for k in keys], SCHEMA)
        now = spark.createDataFrame(store.upsert_latest(now, rows, ["k"], seq).collect(), SCHEMA)
        t.upsert(rows, seq)
        gone = r.sample(range(500), 20)
        now = now.filter(~F.col("k").isin(*gone))
        t.remove(spark.createDataFrame([(k,) for k in gone], "k long"))
        assert sorted(map(repr, t.rows().collect())) == sorted(map(repr, now.collect()))
    again = buckets.attach(spark, f"a{uuid.uuid4().hex}", path, SCHEMA, ["k"], parts=16, buckets=4)
    assert sorted(map(repr, again.rows().select("k", "v", "seq").collect())) == sorted(map(repr, now.collect()))
    t.remove(t.rows().select("k"))
    assert t.rows().count() == 0 and files(path) == {}
    t.upsert(spark.createDataFrame([(1, "back", 1)], SCHEMA), seq)
    assert [tuple(x) for x in t.rows().collect()] == [(1, "back", 1)]
    t.upsert(spark.createDataFrame([], SCHEMA), seq)
    t.remove(spark.createDataFrame([], "k long"))
    assert t.rows().count() == 1


def test_null_keys_are_refused(spark, table):
    t, path = table
    before = files(path)
    with pytest.raises(Exception, match="is null"):
        t.upsert(spark.createDataFrame([(None, "x", 1)], SCHEMA))
    assert files(path) == before


def test_get_or_create(spark, tmp_path):
    rows = spark.createDataFrame([("h1", 7, "old")], "content_hash string, chunk_id long, meta string")
    t = buckets.create(rows, f"g{uuid.uuid4().hex}", str(tmp_path / "g"), ["content_hash"], parts=4, buckets=2)
    t.get_or_create(spark.createDataFrame([("h1", "new"), ("h2", "x")], "content_hash string, meta string"), "chunk_id", refresh=("meta",))
    assert sorted((r.content_hash, r.chunk_id, r.meta) for r in t.rows().collect()) == [("h1", 7, "new"), ("h2", 8, "x")]
    t.get_or_create(spark.createDataFrame([("h1", "newer"), ("h3", "y")], "content_hash string, meta string"), "chunk_id")
    assert sorted((r.content_hash, r.chunk_id, r.meta) for r in t.rows().collect()) == [("h1", 7, "new"), ("h2", 8, "x"), ("h3", 9, "y")]

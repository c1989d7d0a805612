from sievelight.operators import store


def test_paging_is_clamped(spark):
    t = spark.range(300).withColumnRenamed("id", "k")
    assert store.page(t, "k", limit=1000).count() == 200
    assert [r.k for r in store.page(t, "k", limit=0, offset=-3).collect()] == [0]


def test_chunks_are_guarded(spark):
    schema = "snapshot_id long, kind string, lang string, content string, meta string"
    rows = spark.createDataFrame([(1, "k", "l", "x", '{"file":null}'), (1, "k", "l", "x", '{"file":"b"}'), (1, "k", "l", "y", "{}"), (9, "k", "l", "z", '{"file":"a"}'), (1, "", "l", "q", '{"file":"a"}'), (1, "k", "l", None, '{"file":"a"}')], schema)
    stored = spark.createDataFrame([(5, 1, "k", "l", "old", '{"file":"a"}', "h")], f"chunk_id long, {schema}, content_hash string")
    new, refused = store.insert_chunks(stored, spark.createDataFrame([(1,)], "snapshot_id long"), rows)
    assert sorted(r.chunk_id for r in new.collect()) == [5, 6, 7]
    assert sorted(r.reason for r in refused.collect()) == ["fk", "length", "meta_file"]
    again, dup = store.insert_chunks(new, spark.createDataFrame([(1,)], "snapshot_id long"), rows)
    assert again.count() == 3 and [r.reason for r in dup.collect()].count("unique") == 3


def test_projects_and_snapshots(spark):
    p = spark.createDataFrame([(1, "a")], "project_id long, name string")
    new, taken = store.insert_projects(p, spark.createDataFrame([("a",), ("b",), ("b",)], "name string"))
    assert sorted((r.project_id, r.name) for r in new.collect()) == [(1, "a"), (2, "b")] and taken.count() == 1
    s = spark.createDataFrame([], "snapshot_id long, project_id long, commit_sha string")
    made, bad = store.insert_snapshots(s, new, spark.createDataFrame([(1, ""), (1, "mock"), (8, "x")], "project_id long, commit_sha string"))
    assert [(r.snapshot_id, r.commit_sha) for r in made.collect()] == [(1, "mock")] and [r.reason for r in bad.collect()] == ["fk"]


def test_upsert_update_and_cascade(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, seq int")
    new = spark.createDataFrame([(2, "c", 3), (2, "d", 2), (3, "e", 1)], "k int, v string, seq int")
    assert sorted((r.k, r.v) for r in store.upsert_latest(old, new, ["k"], "seq").collect()) == [(1, "a"), (2, "c"), (3, "e")]
    late = spark.createDataFrame([(2, "older", 0), (1, "same", 1), (4, "none", None)], "k int, v string, seq int")
    assert sorted((r.k, r.v) for r in store.upsert_latest(old, late, ["k"], "seq").collect()) == [(1, "same"), (2, "b"), (4, "none")]
    assert sorted(r.k for r in store.upsert_latest(old, new, ["k"]).collect()) == [1, 2, 3]  # one row a key
    assert store.update(old, ["k"], new.select("k", "v")).count() == 2
    assert sorted((r.k, r.v) for r in store.update(old, ["k"], new.select("k", "v").limit(1)).collect()) == [(1, "a"), (2, "c")]
    child = spark.createDataFrame([(10, 1), (11, 2), (12, None)], "c int, k int")
    left, kids = store.cascade_delete([(old, "k", None), (child, "c", "k")], [1])
    assert [r.k for r in left.collect()] == [2] and sorted(r.c for r in kids.collect()) == [11, 12]
    assert [r.c for r in store.orphans(child, left, "k").collect()] == [10]


def test_null_keys_are_equal(spark):
    old = spark.createDataFrame([(None, "a", 1), (1, "b", 1)], "k int, v string, seq int")
    new = spark.createDataFrame([(None, "c", 2), (2, "d", 2)], "k int, v string, seq int")
    assert sorted((r.k or 0, r.v) for r in store.insert_ignore(old, new, ["k"]).collect()) == [(0, "a"), (1, "b"), (2, "d")]
    assert store.insert_ignore(store.insert_ignore(old, new, ["k"]), new, ["k"]).count() == 3
    for seq in (None, "seq"):
        assert sorted((r.k or 0, r.v) for r in store.upsert_latest(old, new, ["k"], seq).collect()) == [(0, "c"), (1, "b"), (2, "d")]
    assert sorted((r.k or 0, r.v) for r in store.update(old, ["k"], new.select("k", "v")).collect()) == [(0, "c"), (1, "b")]


def test_states_are_checked(spark):
    runs = spark.createDataFrame([("a", "INIT", None, None)], "run_id string, status string, created_at timestamp, updated_at timestamp")
    new, bad = store.create_runs(runs, spark.createDataFrame([("a", "INIT"), ("b", None), ("c", "WHAT")], "run_id string, status string"))
    assert sorted((r.run_id, r.status) for r in new.collect()) == [("a", "INIT"), ("b", "INIT")]
    assert sorted((r.run_id, r.reason) for r in bad.collect()) == [("a", "unique"), ("c", "status")]
    assert new.filter("run_id = 'b' and created_at is not null").count() == 1
    patches = spark.createDataFrame([], "patch_id string, run_id string, status string, created_at timestamp")
    kept, refused = store.add_patches(patches, new, spark.createDataFrame([("1", "a", "applied"), ("2", "a", "odd"), ("3", "z", "applied")], "patch_id string, run_id string, status string"))
    assert [r.patch_id for r in kept.collect()] == ["1"] and sorted(r.reason for r in refused.collect()) == ["fk", "status"]
    steps, refused = store.add_steps(spark.createDataFrame([], "step_id string, run_id string, created_at timestamp"), new, spark.createDataFrame([("1", "b"), ("2", "z")], "step_id string, run_id string"))
    assert [r.step_id for r in steps.collect()] == ["1"] and [r.reason for r in refused.collect()] == ["fk"]
    moved, refused = store.set_status(new, "run_id", spark.createDataFrame([("a", "STOP"), ("b", "odd")], "run_id string, status string"), store.RUN_STATES)
    assert sorted((r.run_id, r.status) for r in moved.collect()) == [("a", "STOP"), ("b", "INIT")] and refused.count() == 1
    assert [t.count() for t in store.truncate(new, moved)] == [0, 0]


def test_get_or_create_refreshes_meta(spark):
    stored = spark.createDataFrame([(7, "h1", "old")], "chunk_id long, content_hash string, meta string")
    out = store.get_or_create(stored, spark.createDataFrame([("h1", "new"), ("h2", "x")], "content_hash string, meta string"), ["content_hash"], "chunk_id", refresh=("meta",))
    assert sorted((r.chunk_id, r.content_hash, r.meta) for r in out.collect()) == [(7, "h1", "new"), (8, "h2", "x")]


def test_lock_keys():
    import hashlib
    import struct

    assert store.lock_key("a") == struct.unpack(">q", hashlib.sha256(b"a").digest()[:8])[0]

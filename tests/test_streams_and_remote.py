"""Counters as a stream, the nested output of steps, and remote embedding over a transport that fails."""

import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from sievelight.operators import embedding, telemetry
from sievelight.streaming import counters

SCORED = "run_id long, iter int, key string, score struct<a:double,b:double,c:double,d:double>"


def test_counters_equal_the_batch(spark, tmp_path):
    r = random.Random(1)
    rows = [(run, i, r.choice(["x", "y", None]), (float(r.randint(0, 2)), 0.5, float(r.randint(0, 1)), -r.choice([0.0, 1.0]))) for run in range(12) for i in range(r.randint(1, 9))]
    table = spark.createDataFrame(rows, SCORED)
    want = telemetry.running_best(telemetry.no_progress(table, "key")).select("run_id", F.col("iter").cast("long"), "streak", F.col("best_iter").cast("long"), "stale")
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for upto, name in ((3, "0"), (6, "1"), (99, "2")):  # each start goes on from the state that the last one left
        own = [x for x in rows if upto - 3 <= x[1] < upto or upto == 99 and x[1] >= 6]
        r.shuffle(own)
        again = [x for x in rows if x[1] == 0][:4] if name != "0" else []  # these came before
        (source / f"{name}.json").write_text("\n".join(json.dumps({"run_id": a, "iter": b, "key": c, "score": dict(zip("abcd", d, strict=True))}) for a, b, c, d in own + again))
        stream = counters.counted(spark.readStream.schema(SCORED).json(str(source)))
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(180)
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, want.collect()))


def test_counters_of_many_runs_at_once():
    """A bucket's runs are counted in one go, over any number of batches; run 0 and the run without an id are two."""
    import pandas as pd

    r = random.Random(3)
    kept, got, want, runs = None, [], [], {}
    for batch in range(4):
        rows = [(k == 9, 0 if k == 9 else k, i, r.choice(["x", "y", None]), *(float(r.randint(0, 1)) for _ in "abcd")) for k in range(10) for i in r.sample(range(batch * 3, batch * 3 + 5), 4)]
        r.shuffle(rows)
        found, kept = counters.follow(kept, pd.DataFrame(rows, columns=["none", "run_id", "iter", "key", *"abcd"]))
        got += [tuple(None if pd.isna(x) else int(x) for x in t) for t in found.itertuples(index=False)]
        for none, run, i, key, *score in sorted(rows, key=lambda x: x[:3]):
            last, same, streak, best, at = runs.get((none, run), (-1, ..., 0, None, None))
            if i > last:
                streak = streak + 1 if key == same else 0
                best, at = (score, i) if best is None or score < best else (best, at)
                runs[none, run] = (i, key, streak, best, at)
                want.append((None if none else run, i, streak, at, i - at))
    assert sorted(got, key=str) == sorted(want, key=str) and len(kept) == 10


def test_step_output_is_parsed_once(spark):
    out = {"target_file": "f", "constraint_violation": {"code": "too_large"}, "runner": {"exit_code": 101}, "issues": [1, {"a": 2}], "evidence": {"items": [1, "x", None]}}
    odd = ["{bad", None, "[]", '{"runner":{"exit_code":"7"},"issues":5,"evidence":{"items":{}},"target_file":null}']
    rows = [("a", i, n, json.dumps(out)) for i, n in enumerate(["RETRIEVE", "GENERATE", "EXECUTE", "DIAGNOSE"])] + [(f"o{k}", i, n, t) for k, t in enumerate(odd) for i, n in enumerate(["RETRIEVE", "GENERATE", "EXECUTE", "DIAGNOSE"])]
    steps = spark.createDataFrame(rows, "run_id string, seq long, step_name string, output_json string")
    runs = steps.select("run_id", F.lit("STOP").alias("status")).distinct()
    none = spark.createDataFrame([], "run_id string, seq long, key string, value_json string")
    patches = spark.createDataFrame([], "run_id string, seq long, file_path string, status string")
    found = telemetry.run_summary(runs, steps, none, patches)
    got = {r.run_id: r for r in found.collect()}
    assert (got["a"].evidence_count, got["a"].diagnose_issue_count, got["a"].target_file, got["a"].constraint_violation, got["a"].execute_exit_code) == (3, 2, "f", "too_large", 101)
    assert all((got[f"o{k}"].evidence_count, got[f"o{k}"].diagnose_issue_count, got[f"o{k}"].target_file) == (0, 0, "") for k in range(4))
    assert [got[f"o{k}"].execute_exit_code for k in range(4)] == [None, None, None, 7]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1 and "get_json_object(output_json" not in plan


class Server:
    """A transport that answers by a list of statuses, and well once that is at its end."""

    def __init__(self, statuses=(), odd=None):
        self.statuses, self.odd, self.asked, self.slept, self.now, self.most = list(statuses), odd, [], [], 0, 0
        self.lock = threading.Lock()

    def __call__(self, url, body, headers, limit):
        with self.lock:
            self.now += 1
            self.most = max(self.most, self.now)
            self.asked.append(body["input"])
            status = self.statuses.pop(0) if self.statuses else 200
        threading.Event().wait(0.01)
        data = [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in enumerate(body["input"])]
        with self.lock:
            self.now -= 1
        return status, json.dumps({"data": self.odd(data[::-1]) if self.odd else data[::-1]}).encode()

    def provider(self, **more):
        return embedding.remote({"url": "u", "model": "m", "transport": self, "sleep": self.slept.append, **more})


def test_remote_batches_and_order():
    s = Server()
    texts = ["x" * i for i in range(300)]
    assert s.provider(at_once=3)(texts) == [[float(i), 1.0] for i in range(300)]
    assert sorted(map(len, s.asked)) == [44, 128, 128] and s.most <= 3
    s = Server()
    s.provider(batch=1, at_once=4)(texts[:40])
    assert len(s.asked) == 40 and 1 < s.most <= 4
    assert Server().provider()([]) == []


def test_remote_tries_again():
    s = Server([429, 503, 0, 500, 502])
    assert s.provider()(["a"]) == [[1.0, 1.0]] and s.slept == [1.0, 2.0, 4.0, 8.0, 10.0] and len(s.asked) == 6
    with pytest.raises(ValueError, match="provider_failed:503"):
        Server([503] * 6).provider()(["a"])
    s = Server([401])
    with pytest.raises(ValueError, match="provider_failed:401"):
        s.provider()(["a"])
    assert s.slept == []
    for odd in (lambda d: d[:-1], lambda d: [*d, d[0]], lambda d: [{**d[0], "index": 7}, *d[1:]]):
        with pytest.raises(ValueError, match="count_mismatch"):
            Server(odd=odd).provider()(["a", "b"])


def test_embedding_goes_on_where_it_was(spark):
    chunks = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (3, 2, "a"), (4, 2, "c"), (5, 2, None)], "chunk_id long, snapshot_id long, content string")
    none = spark.createDataFrame([], "chunk_id long, model_id string, content_hash string, embedding array<float>")
    first = embedding.embed_missing(none, chunks.filter("chunk_id < 3"), "stub", {"dimension": 4}, model_id="m")
    stored = spark.createDataFrame(first.select("chunk_id", "model_id", "content_hash", "embedding").collect(), none.schema)
    rest = {r.chunk_id: r for r in embedding.embed_missing(stored, chunks, "stub", {"dimension": 4}, model_id="m").collect()}
    assert sorted(rest) == [3, 4, 5] and [round(x, 5) for x in rest[3].embedding] == [round(x, 5) for x in embedding.stub_vector("a", 4)]
    odd = embedding.embed_missing(stored, chunks.filter("chunk_id = 3"), "stub", {"dimension": -1}, model_id="m")
    assert odd.count() == 1  # its content is stored, so no provider is asked
    changed = embedding.embed_missing(stored, chunks.filter("chunk_id = 1").withColumn("content", F.lit("new")), "stub", {"dimension": 4}, model_id="m")
    assert [r.chunk_id for r in changed.collect()] == [1]


def test_embedding_by_the_registry(spark):
    models = spark.createDataFrame([("s", "stub", 3, '{"seed": 5}'), ("t", "stub", 2, None)], "model_id string, provider_type string, dimension int, config_jsonb string")
    chunks = spark.createDataFrame([(1, 1, "a")], "chunk_id long, snapshot_id long, content string")
    assert [round(x, 5) for x in embedding.embed_registered(chunks, models, "s").first().embedding] == [round(x, 5) for x in embedding.stub_vector("a", 3, 5)]
    assert len(embedding.embed_registered(chunks, models, "t").first().embedding) == 2
    with pytest.raises(ValueError, match="model_not_found"):
        embedding.embed_registered(chunks, models, "x")

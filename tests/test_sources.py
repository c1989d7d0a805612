"""Sources, sinks and the rules of text that they follow."""

import gzip
import hashlib
import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from sievelight.functions import diagnostics, features, text
from sievelight.operators import telemetry
from sievelight.sources import readers, writers


def one(spark, values, schema, expr):
    return [r[0] for r in spark.createDataFrame(values, schema).select(expr).collect()]


def test_decimals_are_those_of_the_binary_value(spark):
    values = [0.125, 0.375, 2.675, 12.3456, 88.888, 88.885, -0.005, 1e15, None]
    assert one(spark, [(v,) for v in values], "v double", text.fixed2(F.col("v"))) == [None if v is None else f"{v:.2f}" for v in values]


def test_white_space_is_stripped_as_a_whole(spark):
    assert one(spark, [("\tpub fn x() {",)], "v string", features.signature(F.col("v"))) == ["pub fn x()"]
    odd = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
    assert one(spark, [(odd + "a b" + odd,)], "v string", text.strip(F.col("v"))) == ["a b"] and set(text.WHITE) == set(odd)


def test_payload_and_names_beyond_ascii(spark):
    logs = [json.dumps({"stdout": "out", "stderr": e}) for e in ("\n", " \t", "err", "")]
    assert one(spark, [(x,) for x in logs], "v string", diagnostics.payload(F.col("v"))) == ["out", "out", "err", "out"]
    got = spark.createDataFrame([("größe.rs:3:1: error: bad",)], "v string").select(diagnostics.issue(F.col("v")).alias("i")).select("i.*").first()
    assert (got.file, got.line, got.summary) == ("größe.rs", 3, "error: bad")


def test_paths_are_cut_by_their_prefix(spark, tmp_path):
    root = tmp_path / "a"
    deep = root / "src" / str(root).strip("/")
    deep.mkdir(parents=True)
    (deep / "x.rs").write_text("fn x() {}")
    assert [r.path for r in readers.source_files(spark, str(root)).collect()] == [f"src{root}/x.rs"]


def test_configuration(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("# limits\nmax_iters: 7  # of the loop\nno_progress_limit: 0\nname: 'a: b'\nnested:\n  max_iters: 9\n")
    got = readers.LoopConfig.load(spark, str(tmp_path / "c.yaml"), {"max_iters": None})
    assert (got.max_iters, got.no_progress_limit) == (7, 5)
    assert readers.LoopConfig.load(spark, str(tmp_path / "none.yaml"), {"no_progress_limit": -4}) == readers.LoopConfig(20, 1)
    assert got.digest == hashlib.sha256(b'{"max_iters": 7, "no_progress_limit": 5}').hexdigest()
    (tmp_path / "p.toml").write_text('[tool.x]\nversion = "1"\nargs = ["a", "b"]\n')
    assert readers.toml_section(spark, str(tmp_path / "p.toml"), "tool", "x") == {"version": "1", "args": ["a", "b"]}
    assert readers.toml_section(spark, str(tmp_path / "p.toml"), "tool", "y") == {} == readers.toml_section(spark, str(tmp_path / "c.yaml"), "tool")
    assert readers.data_root({"SIEVELIGHT_HOST": "h:1", "SIEVELIGHT_PATH": "/a/"}) == "hdfs://h:1/a"
    with pytest.raises(ValueError):
        readers.data_root({})
    assert [r.n for r in readers.series(spark, 2, 6, 2).collect()] == [2, 4, 6]


def test_iteration_files(spark, tmp_path):
    rows = [(1, 3, 12.3456, 2, 88.888, "t", "c", "h"), (2, 0, 0.125, 0, 100.0, "t", "c", "h")]
    metrics = spark.createDataFrame(rows, "iteration int, unsafe_blocks int, unsafe_line_pct double, raw_ptr_count int, test_pass_rate double, timestamp_utc string, commit string, config_hash string")
    writers.iteration_files(metrics, str(tmp_path))
    assert sorted(f.name for f in tmp_path.iterdir() if f.suffix != ".sha256" and f.suffix != ".crc") == ["0001.csv", "0001.json", "0002.csv", "0002.json"]
    assert (tmp_path / "0001.csv").read_text().splitlines()[1] == "1,3,12.35,2,88.89,t,c,h"
    assert json.loads((tmp_path / "0002.json").read_text())["metrics"] == {"unsafe_blocks": 0, "unsafe_line_pct": round(0.125, 2), "raw_ptr_count": 0, "test_pass_rate": 100.0}
    assert all(r.ok for r in readers.digest_check(spark, str(tmp_path), "*").collect())
    assert [r.iteration for r in readers.iteration_csv(spark, str(tmp_path / "0002.csv")).collect()] == [2]
    assert readers.iteration_json(spark, str(tmp_path / "0001.json")).first().missing == []


def test_spilled_output_and_clean_up(spark, tmp_path):
    outputs = spark.createDataFrame([(1, "x" * 11000, "e"), (2, "short", "")], "k int, stdout string, stderr string")
    slim = writers.spill_gz(outputs, str(tmp_path / "logs"))
    assert sorted((r.k, r.stdout, r.stderr, r.spilled) for r in slim.collect()) == [(1, "", "", True), (2, "short", "", False)]
    files = list((tmp_path / "logs").glob("*.gz"))
    assert [json.loads(line)["stderr"] for f in files for line in gzip.open(f, "rt")] == ["e"]
    now = datetime.now()
    assert writers.clean_up(spark, str(tmp_path / "logs"), now) == 0
    assert writers.clean_up(spark, str(tmp_path / "logs"), now + timedelta(days=9)) == len(files)


def test_tool_log_and_lines(spark, tmp_path):
    runs = spark.createDataFrame([("r1", datetime(2024, 2, 3, 4, 5, 6, tzinfo=timezone.utc), json.dumps({"cmd": "x", "cwd": "/c", "snapshot_version": "v1"}))], "run_id string, at timestamp, payload string")
    writers.tool_logs(runs, str(tmp_path / "l"))
    path = str(tmp_path / "l" / "20240203T040506Z_r1.json.gz")
    assert json.loads(gzip.open(path).read())["cwd"] == "/c"
    assert json.loads((tmp_path / "l" / "20240203T040506Z_r1.manifest.json").read_text())["c2rust_log_path"] == path
    assert [(r.snapshot_version, r.tool_version) for r in readers.manifest(spark, str(tmp_path / "l" / "*.manifest.json")).collect()] == [("v1", None)]



def test_tree_digest_depends_on_names_and_contents(spark):
    files = [("B.rs", b"1"), ("a.rs", b"2"), ("x/.git/c", b"3")]
    of = lambda rows: telemetry.tree_digest(spark.createDataFrame(rows, "path string, content binary")).first()[0]
    assert of(files) == of(files[::-1]) == of(files[:2]) != of([("B.rs", b"1"), ("a.rs", b"3")])
    assert of([("a", b""), ("b", b"")]) != of([("a", b""), ("c", b"")])


def test_digested_files(spark, tmp_path):
    from sievelight.sources import digested

    folder = str(tmp_path / "d")
    rows = spark.range(450).select(F.format_string("f%03d.txt", "id").alias("file"), F.repeat(F.lit("x"), F.col("id").cast("int")).cast("binary").alias("content")).repartition(5)
    digested.write(rows, folder)
    got = digested.read(spark, folder)
    assert got.rdd.getNumPartitions() == 3 and got.filter("ok").count() == 450
    assert sorted((r.file, bytes(r.content)) for r in got.collect()) == sorted((r.file, bytes(r.content)) for r in rows.collect())
    assert not [f for f in (tmp_path / "d").iterdir() if f.name.startswith("_staging")]
    (tmp_path / "d" / "f001.txt").write_text("changed")
    (tmp_path / "d" / "f002.txt.sha256").unlink()
    assert sorted((r.file, r.ok) for r in digested.read(spark, folder).filter("ok is null or not ok").collect()) == [("f001.txt", False), ("f002.txt", None)]
    assert digested.read(spark, str(tmp_path / "none")).count() == 0


def test_failed_tasks_leave_no_file(spark, tmp_path):
    from sievelight.sources import digested

    folder = tmp_path / "d"
    good = spark.range(40).select(F.concat(F.lit("f"), "id").alias("file"), F.lit("x").cast("binary").alias("content"))
    odd = {"a name": F.when(F.col("file") == "f39", "../up").otherwise(F.col("file")), "no name": F.when(F.col("file") == "f7", None).otherwise(F.col("file")), "twice": F.when(F.col("file") == "f39", "f0").otherwise(F.col("file"))}
    for name in odd.values():
        with pytest.raises(Exception, match="not a file|same file|Python"):
            digested.write(good.withColumn("file", name).repartition(4), str(folder))
        assert not folder.exists() or list(folder.iterdir()) == []
    digested.write(good, str(folder))
    assert digested.read(spark, str(folder)).filter("ok").count() == 40

import gzip
import json

import pytest
from pyspark.sql import functions as F

from sievelight.functions import diagnostics, diffs, features, text
from sievelight.operators import chunking, embedding, telemetry
from sievelight.sources import readers, writers


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def test_lines_and_windows(spark):
    assert one(spark, "a\r\nb\n\x0bc ", text.lines) == "a\r\nb\n\x0bc ".splitlines()
    assert one(spark, None, text.lines) == []
    files = spark.createDataFrame([("f", "1\n2\n3\n4"), ("g", "\n \n"), ("h", "")], "path string, content string")
    got = [(r.path, r.start_row, r.end_row, r.content) for r in chunking.window_chunks(files, 2).orderBy("path", "start_row").collect()]
    assert got == [("f", 0, 2, "1\n2"), ("f", 2, 4, "3\n4")]


def test_function_slices_and_reasons(spark):
    code = "use x;\npub fn a() {\n  fn inner() {}\n}\nunsafe fn b() { 1 }\n"
    files = spark.createDataFrame([("f", code), ("g", "no functions"), ("h", "fn c() {"), ("i", "x" * 50)], "path string, content string")
    got = chunking.function_chunks(files, chunking.rust_parser, 200, 1000).collect()
    assert sorted((r.path, r.start_row, r.end_row, r.degrade_reason) for r in got if r.path == "f") == [("f", 1, 4, None), ("f", 4, 5, None)]
    assert {r.path: r.degrade_reason for r in got if r.path != "f"} == {"g": "no_functions_found", "h": "tree_sitter_error_nodes", "i": "no_functions_found"}
    big = chunking.function_chunks(files.filter("path = 'i'"), chunking.rust_parser, 200, 10).first()
    assert big.degrade_reason == "file_too_large"


def test_functions_by_tokens():
    cases = {
        'fn a() { let s = "{"; }\nfn b() {}': [("a", 0, 1), ("b", 1, 2)],
        'fn a() {\n let s = r#"}" fn x() {"#;\n}': [("a", 0, 3)],
        'fn a() { br##""#}"##; b"\\"{"; c"}"; "\n{" }\nfn b() {}': [("a", 0, 2), ("b", 2, 3)],
        "fn a<'x>(c: &'x str) -> char { match c { _ => '{', } ; '\\''; b'}'; '\\u{7d}' }": [("a", 0, 1)],
        "/* fn no() { /* } */ fn no2() {} */\n// fn no3() {\nfn a() { /* { */ } // }": [("a", 2, 3)],
        "impl T for S {\n  fn a(&self);\n  pub(crate)\n  unsafe extern \"C\" fn b() {\n    fn inner() {}\n  }\n}": [("b", 2, 6)],
        "mod m { pub struct P(i32); const fn a() {} trait U { fn d() -> [u8; 3]; fn e(x: fn(u8) -> u8) {} } }": [("a", 0, 1), ("e", 0, 1)],
        "fn r#fn() {}\nlet f: fn(i32) = g; macro! { x } ": [("fn", 0, 1)],
        "fn a() -> [u8; 2]\nwhere T: X {\n}": [("a", 0, 3)],
        "": [],
    }
    for text, want in cases.items():
        assert chunking.rust_parser(text) == want, text
    for bad in ("fn a() {", "}", "fn a() { ) }", '"', "/* /* */", 'r#"x"', "fn a("):
        with pytest.raises(ValueError, match="match|end"):
            chunking.rust_parser(bad)


def test_ingest_is_idempotent(spark):
    files = spark.createDataFrame([("b.rs", "unsafe { free(p) }"), ("A.rs", "unsafe { free(p) }")], "path string, content string")
    rows = chunking.ingest(files, 3).collect()
    assert len(rows) == 1 and json.loads(rows[0].meta)["file"] == "A.rs" and json.loads(rows[0].meta)["risk_tags"] == ["unsafe", "manual_mem"]


def test_tags_signature_calls(spark):
    code = "// x\n pub(crate) unsafe fn go(a: *mut u8) -> i32 {\n if (a) { ptr::copy_nonoverlapping(a); b(1); b(2) }"
    assert one(spark, code, features.risk_tags) == ["unsafe", "raw_ptr"]
    assert one(spark, code, features.api_tags) == ["ptr::copy", "ptr::copy_nonoverlapping"]
    assert one(spark, code, features.signature) == "pub(crate) unsafe fn go(a: *mut u8) -> i32"
    assert one(spark, code, features.calls) == ["go", "copy_nonoverlapping", "b"]
    assert one(spark, "nothing", features.signature) is None
    assert one(spark, ["unsafe", " unsafe ", "x"], features.risk_score, "array<string>") == 6
    assert one(spark, "as *const", lambda c: features.safety_counts(c)["raw_ptr_count"]) == 2


def test_issue_lines(spark):
    cases = {
        "src/a.rs:3:7 1:2 E0502: cannot borrow": ("E0502", "src/a.rs", 3, "cannot borrow"),
        "path/x.rs:1:1: E0001: bad": (None, "path/x.rs", 1, "E0001: bad"),
        "plain": (None, None, None, "plain"),
    }
    for line, want in cases.items():
        assert tuple(one(spark, line, diagnostics.issue)) == want


def test_logs_from_files(spark, tmp_path):
    with gzip.open(tmp_path / "a.json.gz", "wt") as f:
        f.write(json.dumps({"stdout": "out", "stderr": "a.rs:1:2: bad\n\nsecond"}))
    got = readers.logs(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.file, r.summary) for r in got] == [("a.rs", "bad"), (None, "second")]


def test_error_kinds(spark):
    kind = lambda code, err, step=None: spark.range(1).select(diagnostics.error_kind(F.lit(code), F.lit(err), F.lit(step)).alias("k")).first().k
    assert [kind(124, ""), kind(0, "TIMEOUT"), kind(1, "Assertion failed"), kind(1, ""), kind(0, None)] == ["timeout", "timeout", "test_fail", "compile_fail", "unknown"]
    assert kind(0, "", "patch_constraint_violation:x") == "patch_constraint_violation"


def test_diff_checks(spark):
    check = lambda d: one(spark, d, lambda c: diffs.violation(c, F.lit("f"), F.lit("fn keep"), F.lit(1), F.lit(9)))
    head = "--- a/f\n+++ b/f\n"
    assert check(head + "@@ -2,1 +2,1 @@\n-a\n+b") is None
    assert check(head + "@@ -20,1 +2,1 @@\n-a\n+b") == "outside_boundary"
    assert check(head + "@@ -2,1 +2,1 @@\n-fn keep()\n") == "signature_changed"
    assert check(head + "@@ -2,1 +2,1 @@\n" + "+x\n" * 41) == "too_many_changes"
    assert check("\n" * 121) == "too_large" and check("") == "missing_file_header"
    assert one(spark, "", diffs.only_hunks) and not one(spark, "@@ x\nfoo", diffs.only_hunks) and not one(spark, "+x", diffs.only_hunks)


def test_stub_embedding_and_provider(spark):
    chunks = spark.createDataFrame([(1, 1, "aaa"), (2, 1, "bbb"), (3, 1, None)], "chunk_id long, snapshot_id long, content string")
    stored = embedding.embed(chunks, "stub", {"dimension": 8}, model_id="s")
    twice = embedding.embed_and_upsert(stored, chunks, "stub", {"dimension": 8}, model_id="s")
    assert twice.count() == 3
    want = embedding.stub_vector("aaa", 8)
    got = [r.embedding for r in twice.collect() if r.chunk_id == 1][0]
    assert all(abs(a - b) < 1e-6 for a, b in zip(got, want, strict=True))
    try:
        embedding.provider("other", {})
    except ValueError as e:
        assert str(e) == "unknown_provider_type:other"


def test_streaks_and_best(spark):
    it = spark.createDataFrame([(1, 1, "a", 5.0), (1, 2, "a", 3.0), (1, 3, "b", 3.0), (1, 4, None, 9.0), (1, 5, None, 1.0)], "run_id int, iter int, sig string, score double")
    assert [r.streak for r in telemetry.no_progress(it, "sig").orderBy("iter").collect()] == [0, 1, 0, 0, 1]
    assert [(r.best_iter, r.stale) for r in telemetry.running_best(it).orderBy("iter").collect()] == [(1, 0), (2, 0), (2, 1), (2, 2), (5, 0)]
    assert telemetry.best(it).first().iter == 5


def test_metrics_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, 12.3456, 0, 88.888, "t", "c", "h")], "iteration int, unsafe_blocks int, unsafe_line_pct double, raw_ptr_count int, test_pass_rate double, timestamp_utc string, commit string, config_hash string")
    shown = writers.iteration_rows(rows).first()
    assert (shown.file, shown.unsafe_line_pct, shown.test_pass_rate) == ("0001", "12.35", "88.89")
    (tmp_path / "0001.csv").write_text(shown.csv)
    (tmp_path / "0001.csv.sha256").write_text(shown.sha256)
    assert readers.digest_check(spark, str(tmp_path), "0001.csv*").first().ok
    assert readers.iteration_csv(spark, str(tmp_path / "0001.csv")).first().unsafe_blocks == 2
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    try:
        readers.iteration_csv(spark, str(tmp_path / "bad.csv"))
        raise AssertionError
    except ValueError as e:
        assert str(e) == "csv_header_mismatch"


def test_spill_and_config(spark):
    out = spark.createDataFrame([("a" * 10240, "e"), ("b", "f")], "stdout string, stderr string")
    slim, large = writers.spill(out)
    assert sorted(r.stderr for r in slim.collect()) == ["", "f"] and large.count() == 1
    c = readers.LoopConfig.of({"max_iters": -1})
    assert (c.max_iters, c.no_progress_limit, len(c.digest)) == (1, 5, 64)


def test_source_tree(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.rs").write_bytes(b"fn a() {}\xff")
    (tmp_path / "b.txt").write_text("no")
    got = readers.source_files(spark, str(tmp_path)).collect()
    assert [(r.path, r.content) for r in got] == [("s/a.rs", "fn a() {}�")]


def test_numbers_of_any_size(spark):
    """No line, hunk or count is too large for the job."""
    from sievelight.functions import diagnostics, diffs

    logs = spark.createDataFrame([("src/a.rs:99999999999:1: boom",), ("a.rs:" + "9" * 30 + ":1: x",), ("a.rs:7:1: E1: y",), ("a.rs:\u0663:1: z",)], "l string")
    got = [tuple(r[0]) for r in logs.select(diagnostics.issue(F.col("l"))).collect()]
    assert got[0] == (None, "src/a.rs", 99999999999, "boom") and got[1][1:3] == ("a.rs", None) and got[2][2] == 7 and got[3] == (None, None, None, "a.rs:\u0663:1: z")
    tests = spark.createDataFrame([("test result: ok. 99999999999 passed; 1 failed;",), ("test result: ok. " + "9" * 30 + " passed; 1 failed;",)], "o string")
    counts = [tuple(r[0]) for r in tests.select(diagnostics.pass_counts(F.col("o"), F.lit(""), F.lit(0))).collect()]
    assert counts == [(99999999999, 100000000000), (1, 1)]
    for start in ("99999999999", "9" * 30):
        d = spark.createDataFrame([(f"--- a/f\n+++ b/f\n@@ -{start},1 +1,1 @@\n-a\n+b\n",)], "d string")
        assert d.select(diffs.violation(F.col("d"), F.lit("f"), F.lit(""), F.lit(1), F.lit(9))).first()[0] == "outside_boundary"


CLASSED = {
    "Foo bar_baz": "asciiword:foo asciiword:bar asciiword:baz",
    "Été x1 42": "word:été numword:x1 uint:42",
    "main.rs example.com:80": "host:main.rs host:example.com:80",
    "src/lib/main.rs /usr/x": "file:src/lib/main.rs file:/usr/x",
    "see https://Example.com/a/b?q=1 now": "asciiword:see url:example.com/a/b?q=1 host:example.com url_path:/a/b?q=1 asciiword:now",
    "me.you@mail.example.org": "email:me.you@mail.example.org",
    "well-known a-1b élan-vital": "asciihword:well-known hword_asciipart:well hword_asciipart:known numhword:a-1b hword_asciipart:a hword_numpart:1b hword:élan-vital hword_part:élan hword_asciipart:vital",
    "-5 +7 10-20 3.14 -2.5e10 1.2.3": "int:-5 int:+7 uint:10 int:-20 float:3.14 sfloat:-2.5e10 version:1.2.3",
    "<b class='x'>y</b> &amp; &#39; <!-- z -->": "asciiword:y",
    "": "",
}


def test_token_classes(spark):
    from sievelight.functions import classes
    from sievelight.operators import search

    df = spark.createDataFrame([(i, t) for i, t in enumerate([*CLASSED, None])], "chunk_id long, content string")
    got = {r.chunk_id: " ".join(f"{x['class']}:{x['token']}" for x in r.c) for r in df.select("chunk_id", classes.classed_tokens(F.col("content")).alias("c")).collect()}
    assert [got[i] for i in range(len(got))] == [*CLASSED.values(), ""]
    long = spark.createDataFrame([(1, "a " * 400 + "b " * 17000 + "c"), (2, "a_" * 50_000), (3, "/x" * 20_000 + "a-" * 20_000)], "chunk_id long, content string")
    places = {r.tok: (r.n, r.most) for r in classes.classed_postings(long.filter("chunk_id = 1")).groupBy("tok").agg(F.count("*").alias("n"), F.max("pos").alias("most")).collect()}
    assert places == {"a": (256, 256), "b": (256, 656), "c": (1, 16383)}
    assert long.select(F.sum(F.size(classes.plain(F.col("content"))))).first()[0] > 60_000  # any length is scanned
    chunks = spark.createDataFrame([(1, 1, "k", "l", "open src/main.rs"), (2, 1, "k", "l", "src main rs")], "chunk_id long, snapshot_id long, kind string, lang string, content string")
    found = lambda q: [r.chunk_id for r in search.lexical_search(chunks, q, words=classes.plain).collect()]
    assert found("src/main.rs") == [1] and found("main rs") == [2] and found("open src/main.rs") == [1] and found("<b>") == []


def test_class_tokens_of_any_length(spark):
    """Long exponents, digits, words and tags are one token each, as in the SQL, whose engine has no bounds."""
    from sievelight.functions import classes

    n = "1234567890" * 3
    cases = {
        "x 5567e50916673 y": ["asciiword:x", "sfloat:5567e50916673", "asciiword:y"], "379e003298": ["sfloat:379e003298"], f"{n}.{n}": [f"float:{n}.{n}"], "b" * 3000: ["asciiword:" + "b" * 3000],
        f"<a href='{'x' * 4000}'>z</a>": ["asciiword:z"], f"a.com/{'p' * 3000}": [f"url:a.com/{'p' * 3000}", "host:a.com", f"url_path:/{'p' * 3000}"],
    }
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string")
    got = {r.i: [f"{x['class']}:{x['token']}" for x in r.c] for r in df.select("i", classes.classed_tokens(F.col("t")).alias("c")).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_files_are_parsed_once(spark):
    """Slices and windows come from one pass of the parser, and equal paths don't multiply."""
    files = spark.createDataFrame([("a", "fn f() {\n}\n"), ("b", "x\n\n\ny"), ("b", "z"), ("c", None)], "path string, content string")
    out = chunking.function_chunks(files, chunking.rust_parser, 2)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    none = "no_functions_found"
    assert sorted(map(tuple, out.collect())) == [("a", 0, 0, 2, "fn f() {\n}", None), ("b", 0, 0, 1, "z", none), ("b", 0, 0, 2, "x\n", none), ("b", 1, 2, 4, "\ny", none)]


def test_diff_checks_cut_lines_once(spark, sf):
    """Each check cuts a diff's lines once, and a small file's rows are dealt to all cores."""
    from sievelight.plans import catalogue

    q = catalogue.QUERIES["diff_constraints"](spark, sf)
    assert q._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 3
    assert q.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism

"""The engine's tables as views of the test data: Spark plans and the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.operators import text_index, vector_index
from sievelight.session import shared_folder
from sievelight.sources.readers import sf_table

NL = "chr(10)"


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as chunks: the source is the kind, snapshots are id modulo 4, two sources carry risk tags."""
    tags = F.when(F.col("source") == "src1", '["unsafe","raw_ptr"]').when(F.col("source") == "src2", '["manual_mem"," unsafe","other"]').otherwise("[]")
    meta = F.concat(F.lit('{"file":"'), F.col("source"), F.lit('/"'), F.lit(',"risk_tags":'), tags, F.lit("}"))
    return sf_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.pmod("doc_id", F.lit(4)).alias("snapshot_id"), F.col("source").alias("kind"), "lang", F.col("text").alias("content"), meta.alias("meta")
    )


_MADE: dict[tuple, str] = {}


def _once(spark: SparkSession, sf_dir: str, table: str, kind: str, make) -> str:
    """The path of a stored index, which a session makes once for a table's files, as a service has it before any query."""
    key = (spark.sparkContext.applicationId, kind, *sorted(sf_table(spark, sf_dir, table).inputFiles()))
    if key not in _MADE:
        path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
        make(path)
        _MADE[key] = path
    return _MADE[key]


def index(spark: SparkSession, sf_dir: str) -> str:
    """The inverted index of the chunks."""
    return _once(spark, sf_dir, "documents", "index", lambda path: text_index.build(chunks(spark, sf_dir), path))


def changed_index(spark: SparkSession, sf_dir: str) -> str:
    """An inverted index that followed changes: every seventh chunk's content is longer, every fifth is gone, copies
    of some came and half of these went; then it was merged, and every thirteenth chunk is gone, too."""
    own, k = chunks(spark, sf_dir), F.col("chunk_id")

    def make(path: str) -> None:
        text_index.build(own, path)
        longer = own.filter(k % 7 == 1).withColumn("content", F.concat("content", F.lit(" the of the")))
        text_index.apply_changes(path, longer, own.filter(k % 5 == 0))
        copies = own.filter(k % 11 == 3).withColumn("chunk_id", k + 1_000_000_000)
        text_index.apply_changes(path, copies)
        text_index.apply_changes(path, own.limit(0), copies.filter((k - 1_000_000_000) % 22 == 3))
        text_index.merge(spark, path)
        text_index.apply_changes(path, own.limit(0), own.filter((k % 13 == 0) & (k % 7 != 1)))

    return _once(spark, sf_dir, "documents", "changed-index", make)


CHANGED_SQL = """docs AS (SELECT doc_id, source, CASE WHEN doc_id % 7 = 1 THEN text || ' the of the' ELSE text END AS text FROM documents WHERE doc_id % 7 = 1 OR (doc_id % 5 <> 0 AND doc_id % 13 <> 0)
 UNION ALL SELECT doc_id + 1000000000, source, text FROM documents WHERE doc_id % 11 = 3 AND doc_id % 22 <> 3)"""


def vector_lists(spark: SparkSession, sf_dir: str) -> str:
    """The approximate index of the vectors."""
    return _once(spark, sf_dir, "embeddings", "lists", lambda path: vector_index.build(vectors(spark, sf_dir), path))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sf_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.pmod("vec_id", F.lit(4)).alias("snapshot_id"), F.lit("m").alias("model_id"), "embedding", "label")


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    """One stored vector, by id."""
    return list(sf_table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()[0])


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as source texts (path, content, k) that have what the feature rules look for."""
    k = F.col("o_orderkey")
    body = (
        F.when(k % 3 == 0, F.concat(F.lit("  unsafe { free(a); } // "), F.col("o_orderpriority")))
        .when(k % 5 == 0, F.lit("  memcpy(a, b); v.add(1);\n\n  let p = x as *mut u8;"))
        .otherwise(F.lit("  let v = Vec::new();\n  helper(k); if (x) { other(helper(1)) }"))
    )
    head = F.when(k % 7 == 0, F.lit("// nothing")).otherwise(F.concat(F.lit("pub fn f"), k.cast("string"), F.lit("(a: *const u8) {")))
    return sf_table(spark, sf_dir, "orders").select(F.concat(F.lit("src/m"), (k % 10).cast("string"), F.lit("/f"), k.cast("string"), F.lit(".rs")).alias("path"), F.concat(head, F.lit("\n"), body, F.lit("\n}")).alias("content"), k.alias("k"))


#: Ten lines with a function that only a reader of tokens finds: rows 3 to 8.
TRICKY = r"""/* fn no() { /* nested { */ */
impl<'a> T<'a> {
    // fn commented() {
    pub(crate) unsafe fn tricky<'b>(c: char) -> &'b str {
        let s = "}\"{"; let r = r#"fn x() { " "#; let q = '\''; let o = '{';
        fn inner() { "{" }
        s
    }
    fn declared(&self);
}"""


def tricky_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source texts with strings, characters, comments and lifetimes that mislead a count of braces."""
    return code(spark, sf_dir).withColumn("content", F.concat("content", F.lit("\n" + TRICKY)))


CODE_SQL = f"""code AS (SELECT 'src/m' || (o_orderkey % 10) || '/f' || o_orderkey || '.rs' AS path, o_orderkey AS k,
 (CASE WHEN o_orderkey % 7 = 0 THEN '// nothing' ELSE 'pub fn f' || o_orderkey || '(a: *const u8) {{' END) || {NL} ||
 (CASE WHEN o_orderkey % 3 = 0 THEN '  unsafe {{ free(a); }} // ' || o_orderpriority
  WHEN o_orderkey % 5 = 0 THEN '  memcpy(a, b); v.add(1);' || {NL} || {NL} || '  let p = x as *mut u8;'
  ELSE '  let v = Vec::new();' || {NL} || '  helper(k); if (x) {{ other(helper(1)) }}' END) || {NL} || '}}' AS content FROM orders)"""


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as log lines (event_id, line): located with a code, located without, and plain."""
    e = F.col("event_id")
    text = F.when(e % 3 == 0, F.format_string("src/u%d/main.rs:%d:7 %d:%d E%04d: value is %s", "user_id", e, e, e, e, "event_type"))
    text = text.when(e % 3 == 1, F.format_string("lib.rs:%d:1: %s happened", F.when(e % 97 == 0, e * 100_000_000_000).otherwise(e), "event_type")).otherwise(F.concat(F.lit("note: "), F.col("event_type")))
    return sf_table(spark, sf_dir, "events").select("event_id", text.alias("line"))


LOGS_SQL = """logs AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'src/u' || user_id || '/main.rs:' || event_id || ':7 ' || event_id || ':' || event_id || ' E' || lpad(event_id::varchar, greatest(4, length(event_id::varchar))::integer, '0') || ': value is ' || event_type
 WHEN event_id % 3 = 1 THEN 'lib.rs:' || event_id || CASE WHEN event_id % 97 = 0 AND event_id > 0 THEN repeat('0', 11) ELSE '' END || ':1: ' || event_type || ' happened' ELSE 'note: ' || event_type END AS line FROM events)"""


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as steps of runs (run_id, seq, step_name, ms, ok, input_json, output_json)."""
    names = F.array(*map(F.lit, STEP_NAMES))
    e = F.col("event_id")
    name = F.get(names, F.pmod(e, F.lit(6)).cast("int"))
    k = F.get_json_object("props", "$.k")
    return sf_table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("run_id"), e.alias("seq"), name.alias("step_name"), F.floor("value").cast("long").alias("ms"), (e % 4 != 0).alias("ok"),
        F.concat(F.lit('{"snapshot_id":'), F.pmod(e, F.lit(30)).cast("string"), F.lit("}")).alias("input_json"),
        F.concat(F.lit('{"target_file":"f'), k, F.lit('","runner":{"exit_code":'), k, F.lit('},"issues":['), F.when(e % 5 == 0, "1,2").otherwise(""), F.lit('],"evidence":{"items":[1]}}')).alias("output_json"), "value", "event_type",
    )


STEP_NAMES = ["INIT", "RETRIEVE", "GENERATE", "APPLY", "EXECUTE", "DIAGNOSE"]
STEPS_SQL = f"""steps AS (SELECT user_id::varchar AS run_id, event_id AS seq, {STEP_NAMES}[(event_id % 6) + 1] AS step_name, floor(value)::bigint AS ms, event_id % 4 <> 0 AS ok,
 event_id % 30 AS snapshot, json_extract_string(props, '$.k') AS k, CASE WHEN event_id % 5 = 0 THEN 2 ELSE 0 END AS issues, value, event_type FROM events)"""


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as metrics (run_id, seq, key, value_json): modes, states and times."""
    e = F.col("event_id")
    key = F.get(F.array(*map(F.lit, METRIC_KEYS)), F.pmod(e, F.lit(5)).cast("int"))
    value = F.when(key == "mode", F.when(e % 2 == 0, '"enhanced"').otherwise('"none"')).when(key == "final_status", F.when(e % 4 == 0, '"OK"').otherwise('"FAILED"'))
    value = value.when(key == "primary_error_kind", F.when(e % 3 == 0, '"test_fail"').otherwise('"compile_fail"')).otherwise(F.floor("value").cast("string"))
    return sf_table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("run_id"), e.alias("seq"), key.alias("key"), value.alias("value_json"))


METRIC_KEYS = ["mode", "final_status", "primary_error_kind", "total_ms", "iteration_count"]
METRICS_SQL = f"""metrics0 AS (SELECT user_id::varchar AS run_id, event_id AS seq, {METRIC_KEYS}[(event_id % 5) + 1] AS key, value, event_id FROM events),
 metrics AS (SELECT run_id, seq, key, CASE key WHEN 'mode' THEN CASE WHEN event_id % 2 = 0 THEN 'enhanced' ELSE 'none' END WHEN 'final_status' THEN CASE WHEN event_id % 4 = 0 THEN 'OK' ELSE 'FAILED' END
  WHEN 'primary_error_kind' THEN CASE WHEN event_id % 3 = 0 THEN 'test_fail' ELSE 'compile_fail' END ELSE floor(value)::bigint::varchar END AS v FROM metrics0),
 latest AS (SELECT run_id, key, arg_max(v, seq) AS v FROM metrics GROUP BY 1, 2)"""


def iterations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as iterations of runs (run_id = order, iter = line) with the numbers of a score."""
    rows = sf_table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("iter"))
    return rows.agg(
        F.max(F.floor(F.col("l_quantity") / 10).cast("long")).alias("blocks"), F.max("l_discount").alias("pct"), F.max(F.pmod("l_partkey", F.lit(5))).alias("ptrs"),
        F.max("l_tax").alias("rate"), F.min(F.col("l_returnflag") == "R").alias("failed"), F.max("l_linestatus").alias("l_linestatus"),
    )


ITER_SQL = "it AS (SELECT l_orderkey AS run_id, l_linenumber AS iter, max(floor(l_quantity / 10)::bigint) AS blocks, max(l_discount) AS pct, max(l_partkey % 5) AS ptrs, max(l_tax) AS rate, bool_and(l_returnflag = 'R') AS failed, max(l_linestatus) AS l_linestatus FROM lineitem GROUP BY 1, 2)"
SCORE_SQL = "CASE WHEN failed THEN 1e9 ELSE blocks::double END AS a, CASE WHEN failed THEN 1e9 ELSE pct END AS b, CASE WHEN failed THEN 1e9 ELSE ptrs::double END AS c, CASE WHEN failed THEN 0.0 ELSE -rate END AS d"


def diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers as diffs (id, diff), one fault in each but every twelfth."""
    k = F.col("c_custkey")
    nth = F.pmod(k, F.lit(12))
    head = F.when(nth == 1, "").when(nth == 2, "--- a/f.rs\n+++ b/g.rs\n").when(nth == 3, "--- a/z.rs\n+++ b/z.rs\n").otherwise("--- a/f.rs\n+++ b/f.rs\n")
    hunk = F.when(nth == 4, "@@ -1,2 +1,2 @@\n@@ -5,2 +5,2 @@\n").when(nth == 5, "@@ broken\n").when((nth == 6) & (k % 5 == 0), "@@ -99999999999,2 +90,2 @@\n").when(nth == 6, "@@ -90,2 +90,2 @@\n").otherwise("@@ -3,2 +3,2 @@\n")
    body = F.when(nth == 7, " same\n").when(nth == 8, "-pub fn keep()\n+x\n").when(nth == 9, "-old\n+new\n" * 60).when(nth == 10, "-old\n+new\n" * 21).when(nth == 11, "odd\n-old\n+new\n").otherwise("-old\n+new\n")
    keys = sf_table(spark, sf_dir, "customer").select("c_custkey").repartition(4 * spark.sparkContext.defaultParallelism)  # a small file of long work
    return keys.select(k.alias("id"), F.concat(head, hunk, body).alias("diff"))


DIFFS_SQL = f"""diffs AS (SELECT c_custkey AS id, c_custkey % 12 AS nth FROM customer),
 text AS (SELECT id, CASE nth WHEN 1 THEN '' WHEN 2 THEN '--- a/f.rs|+++ b/g.rs|' WHEN 3 THEN '--- a/z.rs|+++ b/z.rs|' ELSE '--- a/f.rs|+++ b/f.rs|' END
  || CASE nth WHEN 4 THEN '@@ -1,2 +1,2 @@|@@ -5,2 +5,2 @@|' WHEN 5 THEN '@@ broken|' WHEN 6 THEN CASE WHEN id % 5 = 0 THEN '@@ -99999999999,2 +90,2 @@|' ELSE '@@ -90,2 +90,2 @@|' END ELSE '@@ -3,2 +3,2 @@|' END
  || CASE nth WHEN 7 THEN ' same|' WHEN 8 THEN '-pub fn keep()|+x|' WHEN 9 THEN repeat('-old|+new|', 60) WHEN 10 THEN repeat('-old|+new|', 21) WHEN 11 THEN 'odd|-old|+new|' ELSE '-old|+new|' END AS t FROM diffs),
 parts AS (SELECT id, replace(t, '|', {NL}) AS diff, string_split(rtrim(t, '|'), '|') AS l FROM text),
 told AS (SELECT id, diff, l, list_filter(l, lambda x: starts_with(x, '@@')) AS hunks,
  list_distinct(list_transform(list_filter(l, lambda x: starts_with(x, '--- a/') OR starts_with(x, '+++ b/')), lambda x: trim(x[7:]))) AS files,
  list_filter(l, lambda x: (starts_with(x, '+') OR starts_with(x, '-')) AND NOT starts_with(x, '+++ ') AND NOT starts_with(x, '--- ')) AS changed FROM parts),
 begun AS (SELECT *, list_filter(list_transform(hunks, lambda x: regexp_extract(x, '^@@\\s+-(\\d+)(?:,\\d+)?\\s+\\+\\d+(?:,\\d+)?\\s+@@', 1)), lambda x: x <> '') AS starts FROM told)"""


def runner_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as outputs of a runner (event_id, content): JSON with an error, with a blank one, and plain."""
    e, kind = F.col("event_id"), F.col("event_type")
    error = F.when(e % 4 == 0, F.concat(F.lit("err "), kind)).when(e % 4 == 1, " \\n").otherwise("")
    log = F.concat(F.lit('  {"stdout": "out '), kind, F.lit('", "stderr": "'), error, F.lit('"}'))
    return sf_table(spark, sf_dir, "events").select("event_id", F.when(e % 4 == 3, F.concat(F.lit("plain "), kind)).otherwise(log).alias("content"))


RUNNER_SQL = """logs AS (SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 'plain ' || event_type ELSE '  {"stdout": "out ' || event_type || '", "stderr": "' || CASE event_id % 4 WHEN 0 THEN 'err ' || event_type WHEN 1 THEN ' \\n' ELSE '' END || '"}' END AS content FROM events)"""

"""Run telemetry: steps, patches and key-value metrics to summaries and reports.

Steps carry an explicit sequence number `seq`, as their timestamps may all be equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelight.functions.diagnostics import correctness
from sievelight.functions.text import strip

#: Metric keys of the report, in its order.
REPORT_METRICS = ["final_status", "diagnose_issue_count", "iteration_count", "rollback_count", "total_ms", "retrieve_ms", "generate_ms", "execute_ms", "primary_error_kind", "final_stop_reason"]
#: Metric keys that a summary shows as they are.
SUMMARY_METRICS = ["iteration_count", "no_progress_count", "rollback_count", "total_ms", "retrieve_ms", "generate_ms", "execute_ms", "final_stop_reason", "primary_error_kind", "last_patch_hash", "last_error_signature"]
#: Steps whose times are summed, and the metric's name.
TIMED = {"RETRIEVE": "retrieve_ms", "GENERATE": "generate_ms", "EXECUTE": "execute_ms"}


def text_value(json: Column) -> Column:
    """A JSON scalar as text; JSON null as null."""
    return F.get_json_object(F.concat(F.lit('{"v":'), json, F.lit("}")), "$.v")


def latest_metrics(metrics: DataFrame, seq: str = "seq") -> DataFrame:
    """The last value of each (run_id, key)."""
    return metrics.groupBy("run_id", "key").agg(F.max_by("value_json", seq).alias("value_json"))


def metrics_pivot(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """A row per run with a text column per key, null where it has none. One aggregation over a fixed list of keys."""
    return metrics.groupBy("run_id").agg(*(F.max(F.when(F.col("key") == k, text_value(F.col("value_json")))).alias(k) for k in keys))


def first_step(steps: DataFrame, name: str) -> DataFrame:
    """Each run's first step of a name."""
    rest = F.struct(*(c for c in steps.columns if c != "run_id"))
    return steps.filter(F.col("step_name") == name).groupBy("run_id").agg(F.min_by(rest, "seq").alias("s")).select("run_id", "s.*")


def last_steps(steps: DataFrame) -> DataFrame:
    """Each run's last step of every name."""
    rest = F.struct(*(c for c in steps.columns if c not in ("run_id", "step_name")))
    return steps.groupBy("run_id", "step_name").agg(F.max_by(rest, "seq").alias("s")).select("run_id", "step_name", "s.*")


def step_durations(steps: DataFrame, ms: str = "ms") -> DataFrame:
    """Total time of each run and that of the timed steps."""
    return steps.groupBy("run_id").agg(F.sum(ms).alias("total_ms"), *(F.coalesce(F.sum(F.when(F.col("step_name") == k, F.col(ms))), F.lit(0)).alias(v) for k, v in TIMED.items()))


def step_flags(steps: DataFrame, names: list[str]) -> DataFrame:
    """Whether each run has a step of each name that is ok."""
    return steps.groupBy("run_id").agg(*(F.coalesce(F.bool_or(F.when(F.col("step_name") == n, F.col("ok"))), F.lit(False)).alias(f"has_{n.lower()}") for n in names))


def tag_counts(items: DataFrame) -> DataFrame:
    """(run_id, tag, n) over the code evidence of items (run_id, evidence_type, risk_tags)."""
    code = items.filter(F.col("evidence_type").startswith("code"))
    return code.select("run_id", F.explode("risk_tags").alias("tag")).withColumn("tag", strip(F.col("tag"))).filter("tag <> ''").groupBy("run_id", "tag").agg(F.count("*").alias("n"))


def recent_runs(runs: DataFrame, limit: int = 200) -> DataFrame:
    return runs.orderBy(F.desc("created_at"), "run_id").limit(min(max(1, limit), 2000))


def experiments_report(runs: DataFrame, steps: DataFrame, metrics: DataFrame, patches: DataFrame, snapshots: DataFrame, projects: DataFrame, safety: DataFrame | None = None) -> DataFrame:
    """One row per run: context, mode, correctness, safety counts and metrics, in one plan of left joins.

    safety: (run_id, unsafe_blocks, raw_ptr_count, unsafe_api_count); zeros where a run has none.
    """
    init = first_step(steps, "INIT").select("run_id", F.expr("try_cast(get_json_object(input_json, '$.snapshot_id') as bigint)").alias("snapshot"))
    where = snapshots.join(projects, "project_id").select(F.col("snapshot_id").alias("snapshot"), F.col("name").alias("project"), F.col("commit_sha").alias("commit"))
    rounds = patches.groupBy("run_id").agg(F.count("*").alias("patch_rounds"))
    out = runs.select("run_id").join(init, "run_id", "left").join(where, "snapshot", "left")
    out = out.join(metrics_pivot(metrics, ["mode", *REPORT_METRICS]), "run_id", "left").join(rounds, "run_id", "left")
    counts = ["unsafe_blocks", "raw_ptr_count", "unsafe_api_count"]
    out = out.join(safety.select("run_id", *counts), "run_id", "left") if safety is not None else out.withColumns({c: F.lit(None).cast("long") for c in counts})
    compiled, tested = correctness(F.col("final_status"), F.col("primary_error_kind"))
    done = F.coalesce("patch_rounds", F.lit(0))
    mode = F.when(F.col("mode").isin("baseline", "enhanced"), F.col("mode")).when(done > 0, "enhanced").otherwise("baseline")
    return out.select(
        "project", "snapshot", "commit", "run_id", mode.alias("mode"), compiled.alias("compile_ok"), tested.alias("test_ok"), *REPORT_METRICS[:2],
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts), "iteration_count", done.alias("patch_rounds"), *REPORT_METRICS[3:],
    )


def run_summary(runs: DataFrame, steps: DataFrame, metrics: DataFrame, patches: DataFrame) -> DataFrame:
    """One row per run: what its last steps, its first patch and its metrics say.

    A value of 0 or "" gives way to the next source, as counts and names fall back on each other.
    """
    # the output of a step is parsed once, into a variant; what is missing, of another kind or no JSON is null
    last = last_steps(steps).select("run_id", "step_name", F.try_parse_json("output_json").alias("out"))
    got = lambda path, kind: F.try_variant_get("out", path, kind)
    told = last.select(
        "run_id", "step_name", F.size(got("$.evidence.items", "array<variant>")).alias("items"), got("$.target_file", "string").alias("target"),
        got("$.constraint_violation.code", "string").alias("violation"), got("$.runner.exit_code", "string").alias("exit_code"), F.size(got("$.issues", "array<variant>")).alias("issues"),
    )
    of = lambda name, col: F.max(F.when((F.col("step_name") == name) & (F.col(col).isNotNull() if col not in ("items", "issues") else F.col(col) >= 0), F.col(col)))
    seen = told.groupBy("run_id").agg(
        of("RETRIEVE", "items").alias("items"), of("GENERATE", "target").alias("target"), of("GENERATE", "violation").alias("constraint_violation"),
        of("EXECUTE", "exit_code").try_cast("int").alias("execute_exit_code"), of("DIAGNOSE", "issues").alias("issues"),
    )
    n_steps = steps.groupBy("run_id").agg(F.count("*").alias("n_steps"))
    patch = patches.groupBy("run_id").agg(F.min_by(F.struct("file_path", "status"), "seq").alias("p"), F.count("*").alias("n_patches"))
    wide = metrics_pivot(metrics, ["retrieve_count", "diagnose_issue_count", "final_status", *SUMMARY_METRICS])
    out = runs.select("run_id", "status").join(seen, "run_id", "left").join(n_steps, "run_id", "left").join(patch, "run_id", "left").join(wide, "run_id", "left")
    count = lambda metric, other: F.coalesce(F.nullif(F.expr(f"try_cast({metric} as bigint)"), F.lit(0)), F.col(other).cast("long"), F.lit(0))
    return out.select(
        "run_id", "status", F.coalesce("n_steps", F.lit(0)).alias("n_steps"), F.coalesce("n_patches", F.lit(0)).alias("n_patches"),
        count("retrieve_count", "items").alias("evidence_count"), count("diagnose_issue_count", "issues").alias("diagnose_issue_count"),
        F.coalesce(F.nullif("target", F.lit("")), F.col("p.file_path"), F.lit("")).alias("target_file"), "constraint_violation", F.coalesce(F.col("p.status"), F.lit("")).alias("patch_status"),
        "execute_exit_code", F.coalesce(F.nullif("final_status", F.lit("")), F.col("status")).alias("final_status"), *SUMMARY_METRICS,
    )


def no_progress(iterations: DataFrame, key: str, by: str = "run_id", order: str = "iter") -> DataFrame:
    """Adds streak: how many iterations in a row, up to this one, had the same key as the one before."""
    w = Window.partitionBy(by).orderBy(order)
    same = iterations.withColumn("same", F.col(key).eqNullSafe(F.lag(key).over(w)) & F.lag(order).over(w).isNotNull())
    islands = same.withColumn("island", F.sum(F.when(F.col("same"), 0).otherwise(1)).over(w))
    return islands.withColumn("streak", (F.row_number().over(Window.partitionBy(by, "island").orderBy(order)) - 1).cast("long")).drop("same", "island")


def score(unsafe_blocks: Column, unsafe_pct: Column, raw_ptrs: Column, pass_rate: Column, failed: Column) -> Column:
    """What is compared, field by field, the least being best; a patch that failed to apply is worse than all."""
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("double")
    worst = F.lit(1e9)
    return F.struct(*(F.when(failed, w).otherwise(v).alias(n) for n, w, v in (("a", worst, zero(unsafe_blocks)), ("b", worst, zero(unsafe_pct)), ("c", worst, zero(raw_ptrs)), ("d", F.lit(0.0), -zero(pass_rate)))))


def running_best(iterations: DataFrame, score_col: str = "score", by: str = "run_id", order: str = "iter") -> DataFrame:
    """Adds best_iter: the iteration with the best score so far, the first of equals; and stale: iterations since."""
    w = Window.partitionBy(by).orderBy(order)
    best = F.min(F.struct(F.col(score_col).alias("s"), F.col(order).alias("i"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return iterations.withColumn("best_iter", best["i"]).withColumn("stale", (F.col(order) - F.col("best_iter")).cast("long"))


def best(iterations: DataFrame, score_col: str = "score", by: str = "run_id", order: str = "iter") -> DataFrame:
    """Each run's iteration with the least score, the first of equals."""
    return iterations.groupBy(by).agg(F.min(F.struct(F.col(score_col).alias("s"), F.col(order).alias("i"))).alias("m")).select(by, F.col("m.i").alias(order))


def percentile(values: DataFrame, col: str, share: float = 0.95, by: list[str] | None = None) -> DataFrame:
    """A value of the column that at least the share of the values don't exceed."""
    p = F.expr(f"percentile_disc({share}) within group (order by {col})")
    return (values.groupBy(*by) if by else values).agg(F.count(col).alias("n"), F.min(col).alias("min"), p.alias("p"), F.max(col).alias("max"))


def merged_source_measures(files: DataFrame) -> DataFrame:
    """unsafe_blocks, unsafe_line_pct and raw_ptr_count over all files (path, content); 0 percent of no lines."""
    from sievelight.functions.features import source_measures

    m = source_measures(F.col("content"))
    sums = files.select(*(c.alias(n) for n, c in m.items())).agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in m))
    pct = F.when(F.col("total_lines") > 0, F.col("unsafe_lines") * 100.0 / F.col("total_lines")).otherwise(0.0)
    return sums.select("unsafe_blocks", pct.alias("unsafe_line_pct"), "raw_ptr_count")


def tree_digest(files: DataFrame) -> DataFrame:
    """One digest of a tree of files (path, content as bytes): over the files' own digests, in order of path, without .git.

    Contents are hashed where they are read; the digests, 64 characters a file, are first put together in
    4096 parts by a hash of the path, so that no task holds those of all files.
    """
    own = files.filter(~F.col("path").contains("/.git/")).select("path", F.sha2(F.col("content").cast("binary"), 256).alias("d"))
    parts = F.sort_array(F.collect_list(F.struct(F.lower("path").alias("l"), "path", "d")))
    some = own.groupBy(F.substring(F.sha2("path", 256), 1, 3).alias("part")).agg(F.sha2(F.array_join(F.transform(parts, lambda x: F.concat(x["path"], F.lit("\0"), x["d"])), "\0").cast("binary"), 256).alias("d"))
    return some.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "d"))), lambda x: x["d"]), "\0").cast("binary"), 256).alias("digest"))

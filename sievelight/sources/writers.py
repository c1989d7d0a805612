"""Sinks: reports, per-iteration metrics, event logs and spilled output."""

from __future__ import annotations

import gzip
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.functions.text import fixed2
from sievelight.sources import digested
from sievelight.sources.schemas import ITERATION_COLUMNS

#: Fixed value: bytes of an output from which both outputs of a run are moved out.
SPILL_BYTES = 10 * 1024


def report_csv(report: DataFrame, path: str) -> None:
    """One CSV file with a header; nulls are empty. A report has a row per run of a bounded list."""
    report.coalesce(1).write.mode("overwrite").csv(path, header=True, emptyValue="", nullValue="")


def iteration_rows(metrics: DataFrame) -> DataFrame:
    """Per-iteration metrics as the CSV shows them, with the row's text and its sha256."""
    shown = metrics.select(*(fixed2(F.col(c)).alias(c) if c in ("unsafe_line_pct", "test_pass_rate") else F.col(c).cast("string").alias(c) for c in ITERATION_COLUMNS))
    line = F.concat_ws(",", *(F.coalesce(c, F.lit("")) for c in ITERATION_COLUMNS))
    body = F.concat(F.lit(",".join(ITERATION_COLUMNS) + "\n"), line, F.lit("\n"))
    return shown.withColumn("file", F.format_string("%04d", F.col("iteration").cast("int"))).withColumn("csv", body).withColumn("sha256", F.sha2(F.col("csv").cast("binary"), 256))


def _iteration_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The CSV and the JSON file of each row."""
    for b in batches:
        out = []
        for r in b.to_dict("records"):
            r = {k: None if v is None or v != v else v for k, v in r.items()}
            told = {k: r[k] or "" for k in ("timestamp_utc", "commit", "config_hash")}
            shown = {"unsafe_blocks": int(r["unsafe_blocks"] or 0), "unsafe_line_pct": round(float(r["unsafe_line_pct"] or 0), 2), "raw_ptr_count": int(r["raw_ptr_count"] or 0), "test_pass_rate": round(float(r["test_pass_rate"] or 0), 2)}
            body = json.dumps({"meta": told, "iteration": int(r["iteration"]), "metrics": shown}, ensure_ascii=False, indent=2) + "\n"
            out += [(f"{r['file']}.csv", r["csv"].encode()), (f"{r['file']}.json", body.encode())]
        yield pd.DataFrame(out, columns=["file", "content"])


def iteration_files(metrics: DataFrame, folder: str) -> None:
    """The CSV and JSON files of each iteration with their .sha256 neighbours, written by executors, all or none."""
    shown = [fixed2(F.col(c)) if c in ("unsafe_line_pct", "test_pass_rate") else F.col(c).cast("string") for c in ITERATION_COLUMNS]
    line = F.concat_ws(",", *(F.coalesce(c, F.lit("")) for c in shown))
    body = F.concat(F.lit(",".join(ITERATION_COLUMNS) + "\n"), line, F.lit("\n"))
    rows = metrics.select("iteration", *(c for c in ITERATION_COLUMNS if c != "iteration"), F.format_string("%04d", F.col("iteration").cast("int")).alias("file"), body.alias("csv"))
    digested.write(rows.mapInPandas(_iteration_texts, "file string, content binary"), folder)


def stamp(at: Column) -> Column:
    """A time as the log files' names show it, in UTC."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyyMMdd'T'HHmmss'Z'")


def elapsed_ms(start: Column, end: Column) -> Column:
    """Whole milliseconds from start to end, none below 0."""
    return F.greatest(F.unix_millis(end.cast("timestamp")) - F.unix_millis(start.cast("timestamp")), F.lit(0).cast("long"))


def json_rows(rows: DataFrame) -> DataFrame:
    """Rows as lines of JSON, nulls included, for standard output or a log."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("line"))


def _tool_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The gzip JSON log of each run and the manifest that names it."""
    for b in batches:
        out = []
        for name, folder, payload in zip(b["name"], b["folder"], b["payload"], strict=True):
            told = json.loads(payload)
            known = {k: told.get(k, "") for k in ("snapshot_version", "c2rust_version", "rust_workspace_dir")}
            manifest = {**known, "c_project_path": told.get("cwd", ""), "c2rust_log_path": f"{folder}/{name}.json.gz"}
            out.append((f"{name}.json.gz", gzip.compress((json.dumps(told, ensure_ascii=False) + "\n").encode(), mtime=0)))
            out.append((f"{name}.manifest.json", (json.dumps(manifest, ensure_ascii=False, indent=2) + "\n").encode()))
        yield pd.DataFrame(out, columns=["file", "content"])


def tool_logs(runs: DataFrame, folder: str) -> None:
    """Runs of tools (run_id, at, payload as a JSON object) as gzip JSON logs, each with a manifest that names it; written by executors, all or none."""
    name = F.concat(stamp(F.col("at")), F.lit("_"), F.col("run_id"))
    rows = runs.select(name.alias("name"), F.lit(folder).alias("folder"), F.col("payload"))
    digested.write(rows.mapInPandas(_tool_texts, "file string, content binary"), folder)


def events_jsonl(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def parquet_partitioned(table: DataFrame, path: str, by: str = "snapshot_id", mode: str = "overwrite") -> None:
    """Files per snapshot, so that a snapshot's queries read its folder only."""
    table.repartition(by).write.mode(mode).partitionBy(by).parquet(path)


def spill(outputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with both outputs emptied where either is large, the large rows' outputs)."""
    large = (F.octet_length(F.coalesce("stdout", F.lit(""))) >= SPILL_BYTES) | (F.octet_length(F.coalesce("stderr", F.lit(""))) >= SPILL_BYTES)
    kept = outputs.withColumn("spilled", large)
    slim = kept.withColumns({c: F.when(F.col("spilled"), F.lit("")).otherwise(F.col(c)) for c in ("stdout", "stderr")})
    return slim, kept.filter("spilled").drop("spilled")


def retention(files: DataFrame, now, days: int = 7) -> DataFrame:
    """Files (path, modificationTime) that are older than the days."""
    return files.filter(F.col("modificationTime") < F.lit(now) - F.make_dt_interval(F.lit(days)))


def spill_gz(outputs: DataFrame, folder: str) -> DataFrame:
    """outputs without the large texts, which are appended to gzip JSON files in folder; spilled tells which."""
    slim, large = spill(outputs)
    large.write.mode("append").option("compression", "gzip").json(folder)
    return slim


def clean_up(spark: SparkSession, folder: str, now, days: int = 7, pattern: str = "*.gz") -> int:
    """Deletes the folder's files that are older than the days; how many. Names come to the driver one at a time."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "modificationTime")
    n = 0
    for r in retention(files, now, days).select("path").toLocalIterator():
        place = spark._jvm.org.apache.hadoop.fs.Path(r["path"])
        n += bool(place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, False))
    return n

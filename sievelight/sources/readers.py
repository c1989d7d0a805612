"""Sources: stored tables, source trees, logs, manifests, metrics files and their checks.

All go through Spark's own readers, so any store that Spark can read will do.
"""

from __future__ import annotations

import hashlib
import json
import re
import tomllib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.functions.diagnostics import issue, payload
from sievelight.functions.text import lines
from sievelight.sources.schemas import ITERATION_COLUMNS, TABLES


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")


def sf_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the test data."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_files(spark: SparkSession, root: str, suffix: str = "*.rs") -> DataFrame:
    """(path, content) of a tree, path relative to root; bytes that aren't UTF-8 become U+FFFD."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", suffix).option("recursiveFileLookup", "true").load(root)
    base = re.sub("^[a-z]+:/*", "/", root.rstrip("/")) + "/"
    path = F.regexp_replace(F.col("path"), "^[a-z]+:/*", "/")
    own = F.when(path.startswith(base), F.substr(path, F.lit(len(base) + 1))).otherwise(path)
    return files.select(own.alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of files as they are, gzip opened."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))


def issues(texts: DataFrame, text: str = "content") -> DataFrame:
    """Logs to rows: the columns of texts but the log, pos, error_code, file, line, summary, suggestion."""
    rest = [c for c in texts.columns if c != text]
    rows = texts.select(*rest, F.posexplode(lines(payload(F.col(text)))).alias("pos", "raw")).filter(F.length("raw") > 0)
    return rows.select(*rest, "pos", issue(F.col("raw")).alias("i")).select(*rest, "pos", "i.*", F.lit(None).cast("string").alias("suggestion"))


def logs(spark: SparkSession, path: str) -> DataFrame:
    """Issues of plain, gzip or JSON runner logs."""
    return issues(whole_texts(spark, path))


def runner_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("stdout string, stderr string").json(path)


def scenarios(spark: SparkSession, path: str) -> DataFrame:
    """(exit_code, stdout, stderr) of scenario files; a missing exit code is 0."""
    found = spark.read.schema("exit_code int, stdout string, stderr string").json(path, multiLine=True)
    return found.select(F.coalesce("exit_code", F.lit(0)).alias("exit_code"), F.coalesce("stdout", F.lit("")).alias("stdout"), F.coalesce("stderr", F.lit("")).alias("stderr"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("snapshot_version string, tool struct<version:string>").json(path, multiLine=True).select("snapshot_version", F.col("tool.version").alias("tool_version"))


def iteration_csv(spark: SparkSession, path: str) -> DataFrame:
    """Per-iteration metrics; a header other than the fixed one is an error."""
    head = spark.read.text(path).limit(1).first()
    if head is None or head[0].split(",") != ITERATION_COLUMNS:
        raise ValueError("csv_header_mismatch")
    kinds = ["int", "int", "double", "int", "double", "string", "string", "string"]
    return spark.read.schema(", ".join(f"`{c}` {k}" for c, k in zip(ITERATION_COLUMNS, kinds, strict=True))).csv(path, header=True)


def iteration_json(spark: SparkSession, path: str) -> DataFrame:
    """Per-iteration metrics in JSON, with what is missing of meta and metrics in `missing`."""
    meta, metrics = ["timestamp_utc", "commit", "config_hash"], ["unsafe_blocks", "unsafe_line_pct", "raw_ptr_count", "test_pass_rate"]
    found = spark.read.schema("meta struct<timestamp_utc:string,commit:string,config_hash:string>, metrics struct<unsafe_blocks:int,unsafe_line_pct:double,raw_ptr_count:int,test_pass_rate:double>").json(path, multiLine=True)
    absent = [F.when(F.col(f"{g}.{c}").isNull(), f"{g}.{c}") for g, cs in (("meta", meta), ("metrics", metrics)) for c in cs]
    return found.select("meta.*", "metrics.*", F.array_compact(F.array(*absent)).alias("missing"))


def digest_check(spark: SparkSession, folder: str, suffix: str = "*") -> DataFrame:
    """(path, ok): whether each file's sha256 is what its .sha256 neighbour says; null without one."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", suffix).load(folder)
    own = files.filter(~F.col("path").endswith(".sha256")).select("path", F.sha2("content", 256).alias("digest"))
    told = files.filter(F.col("path").endswith(".sha256")).select(F.regexp_replace("path", r"\.sha256$", "").alias("path"), F.regexp_extract(F.decode("content", "UTF-8"), r"^\s*([0-9a-fA-F]{64})", 1).alias("told"))
    return own.join(told, "path", "left").select("path", (F.col("digest") == F.lower("told")).alias("ok"))


def sql_template(spark: SparkSession, text: str, **params) -> DataFrame:
    """A query with :name parameters, bound and not pasted."""
    return spark.sql(text, args=params)


def _text(spark: SparkSession, path: str) -> str:
    """A small file's text; empty where there is none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place):
        return ""
    row = spark.read.text(path, wholetext=True).first()
    return row[0] if row else ""


def plain_yaml(text: str) -> dict:
    """The top level of a YAML mapping of scalars: numbers, booleans, null and strings; what is nested is left out."""
    out: dict = {}
    for line in text.splitlines():
        m = re.match(r"([A-Za-z_][\w.-]*)\s*:(?:\s+(.*))?$", line)
        if not m:
            continue
        raw = (m[2] or "").strip()
        raw = raw[1:-1] if len(raw) > 1 and raw[0] == raw[-1] and raw[0] in "'\"" else re.sub(r"(^|\s+)#.*$", "", raw)
        try:
            out[m[1]] = {"": None, "~": None, "null": None, "true": True, "false": False}[raw]
        except KeyError:
            out[m[1]] = int(raw) if re.fullmatch(r"[-+]?\d+", raw) else float(raw) if re.fullmatch(r"[-+]?\d+\.\d*", raw) else raw
    return out


def toml_section(spark: SparkSession, path: str, *names: str) -> dict:
    """A section of a TOML file; empty where the file, the section or its syntax fails."""
    try:
        found = tomllib.loads(_text(spark, path))
    except tomllib.TOMLDecodeError:
        return {}
    for n in names:
        found = found.get(n) if isinstance(found, dict) else None
    return dict(found) if isinstance(found, dict) else {}


def series(spark: SparkSession, first: int, last: int, step: int = 1) -> DataFrame:
    """n from first to last, both included."""
    return spark.range(first, last + (1 if step > 0 else -1), step).withColumnRenamed("id", "n")


def data_root(env: dict[str, str]) -> str:
    """Where the tables lie: SIEVELIGHT_ROOT, else SIEVELIGHT_HOST and SIEVELIGHT_PATH as one address; none is an error."""
    if env.get("SIEVELIGHT_ROOT", "").strip():
        return env["SIEVELIGHT_ROOT"].strip().rstrip("/")
    if env.get("SIEVELIGHT_HOST", "").strip():
        return f"hdfs://{env['SIEVELIGHT_HOST'].strip()}/{env.get('SIEVELIGHT_PATH', '').strip('/ ')}".rstrip("/")
    raise ValueError("no_data_root")


@dataclass(frozen=True)
class LoopConfig:
    """Limits of the repair loop; each is 1 at least."""

    max_iters: int = 20
    no_progress_limit: int = 5

    @classmethod
    def of(cls, values: dict | None) -> LoopConfig:
        values = values or {}
        return cls(max(1, int(values.get("max_iters") or 20)), max(1, int(values.get("no_progress_limit") or 5)))

    @classmethod
    def load(cls, spark: SparkSession, path: str, overrides: dict | None = None) -> LoopConfig:
        """From a YAML file of key: value lines, if there is one; overrides that aren't null win."""
        return cls.of(plain_yaml(_text(spark, path)) | {k: v for k, v in (overrides or {}).items() if v is not None})

    @property
    def digest(self) -> str:
        return hashlib.sha256(json.dumps({"max_iters": self.max_iters, "no_progress_limit": self.no_progress_limit}, sort_keys=True).encode()).hexdigest()

"""Logs to issues, errors to kinds, outputs to pass rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievelight.functions.text import strip

#: Fixed value: a located diagnostic line.
ISSUE = r"(?U)^([\w./-]+\.\w+):([0-9]+):\d*(?:\s+\d+:\d+)?\s*(\w+)?\s*:\s*(.*)"

_MARK = "\x01"


def issue(line: Column) -> Column:
    """A line as (error_code, file, line, summary); one without a place is all summary. A line number beyond 64 bits is null."""
    # one match a line: its groups come in place of it, between marks that no located line begins with
    parts = F.split(F.regexp_replace(line, ISSUE + r"[\s\S]*", f"{_MARK}$3{_MARK}$1{_MARK}$2{_MARK}$4"), _MARK, 5)
    hit = (F.size(parts) == 5) & (F.get(parts, F.lit(0)) == "") & ~line.startswith(_MARK)
    part = lambda i: F.nullif(F.get(parts, F.lit(i)), F.lit(""))
    return F.struct(
        F.when(hit, part(1)).alias("error_code"),
        F.when(hit, part(2)).alias("file"),
        F.when(hit, part(3).try_cast("bigint")).alias("line"),
        F.when(hit, strip(F.get(parts, F.lit(4)))).otherwise(line).alias("summary"),
    )


def payload(text: Column) -> Column:
    """The output inside a runner's JSON log: its stderr unless blank, else its stdout; any other text is itself."""
    log = F.when(strip(text).startswith("{"), F.from_json(text, "stdout string, stderr string"))
    inner = F.when(strip(log["stderr"]) != "", log["stderr"]).otherwise(log["stdout"])
    return F.when(strip(inner) != "", inner).otherwise(text)


def error_kind(exit_code: Column, stderr: Column, step_error: Column) -> Column:
    """The kind of a failed run. The kinds, their order and what speaks for them."""
    low = F.lower(F.coalesce(stderr, F.lit("")))
    step = F.coalesce(step_error, F.lit(""))
    return (
        F.when(step.startswith("patch_constraint_violation:"), "patch_constraint_violation")
        .when(step.startswith("patch_apply_failed:"), "apply_fail")
        .when(step == "retrieve_no_results", "retrieve_empty")
        .when((exit_code == 124) | low.contains("timeout"), "timeout")
        .when(low.contains("assertion failed"), "test_fail")
        .when(exit_code != 0, "compile_fail")
        .otherwise("unknown")
    )


def error_signature(kind: Column, file: Column, code: Column) -> Column:
    return F.concat_ws("|", *(F.coalesce(x, F.lit("")) for x in (kind, file, code)))


def scope(path: Column) -> Column:
    """The directory of a path, with forward slashes; null where there is none."""
    return F.nullif(F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), "^(.*)/[^/]*$", 1), F.lit(""))


def pass_counts(stdout: Column, stderr: Column, exit_code: Column) -> Column:
    """(passed, total): from the first test result, else the number announced, else the exit code."""
    text = F.concat(F.coalesce(stdout, F.lit("")), F.lit("\n"), F.coalesce(stderr, F.lit("")))
    # fixed values: how test results and their number are announced
    result, announced = r"(?i)test result:\s*(?:ok|FAILED)\.\s*(\d+)\s+passed;\s+(\d+)\s+failed;", r"(?i)running\s+(\d+)\s+tests"
    passed, failed = (F.regexp_extract(text, result, i).try_cast("bigint") for i in (1, 2))
    count = F.regexp_extract(text, announced, 1).try_cast("bigint")
    good = exit_code == 0
    return (
        F.when(passed.isNotNull(), F.struct(passed.alias("passed"), F.try_add(passed, failed).alias("total")))
        .when(count.isNotNull(), F.struct(F.when(good, count).otherwise(F.lit(0).cast("long")).alias("passed"), count.alias("total")))
        .otherwise(F.struct(F.when(good, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")).alias("passed"), F.lit(1).cast("long").alias("total")))
    )


def correctness(final_status: Column, error: Column) -> tuple[Column, Column]:
    """(compiled, tests passed) as 0 or 1."""
    ok = F.coalesce(final_status == "OK", F.lit(False))
    return F.when(ok | F.coalesce(error == "test_fail", F.lit(False)), 1).otherwise(0), F.when(ok, 1).otherwise(0)

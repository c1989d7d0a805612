"""Checks of unified diffs, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievelight.functions.features import any_of
from sievelight.functions.text import bound, lines, strip

#: Fixed value: the header of a hunk.
HUNK = r"^@@\s+-(\d+)(?:,(\d+))?\s+\+(\d+)(?:,(\d+))?\s+@@"


def _paths(own: Column) -> Column:
    heads = F.filter(own, lambda x: x.startswith("--- a/") | x.startswith("+++ b/"))
    return F.array_distinct(F.filter(F.transform(heads, lambda x: strip(F.regexp_replace(x, "^[^/]*/", ""))), lambda x: x != ""))


def paths(diff: Column) -> Column:
    """Distinct files named by a diff's headers, in order."""
    return _paths(lines(diff))


def only_hunks(diff: Column) -> Column:
    """Whether a diff holds hunks and nothing that isn't a line of a diff; an empty one passes."""
    text = F.btrim(F.coalesce(diff, F.lit("")), F.lit("\r\n"))
    fine = F.forall(lines(text), lambda x: (x == "") | any_of([x.startswith(s) for s in ("--- ", "+++ ", "@@ ", "+", "-", " ")]))
    return F.when(text == "", True).otherwise(text.contains("@@ ") & fine)


def _changed(own: Column) -> Column:
    return F.filter(own, lambda x: (x.startswith("+") & ~x.startswith("+++ ")) | (x.startswith("-") & ~x.startswith("--- ")))


def changed_lines(diff: Column) -> Column:
    """The lines that a diff adds or removes, with their signs; headers of files and hunks aren't."""
    return _changed(lines(diff))


def _parts(own: Column) -> Column:
    """What the constraints look at: the number of lines, the changed ones, files, the number of hunks and the first start of one."""
    hunks = F.filter(own, lambda x: x.startswith("@@"))
    starts = F.filter(F.transform(hunks, lambda x: F.regexp_extract(x, HUNK, 1)), lambda x: x != "")
    return F.struct(F.size(own).alias("n"), _changed(own).alias("changed"), _paths(own).alias("files"), F.size(hunks).alias("hunks"), F.try_element_at(starts, F.lit(1)).alias("first"))


def violation(diff: Column, target: Column, signature: Column, start: Column, end: Column, pairs: int = 20, most: int = 120) -> Column:
    """The first constraint that a diff breaks, null if none; its lines are cut and sorted out once. The names of the constraints."""
    sign = strip(signature)

    def first_broken(own: Column) -> Column:
        changed, files, first = own["changed"], own["files"], own["first"]
        at = F.coalesce(first.try_cast("bigint"), F.when(first.isNotNull(), F.lit((1 << 63) - 1)))  # a start beyond 64 bits is outside of any file
        return (
            F.when(own["n"] > most, "too_large")
            .when((sign != "") & F.exists(changed, lambda x: F.substr(x, F.lit(2)).contains(sign)), "signature_changed")
            .when(F.size(files) == 0, "missing_file_header")
            .when(F.size(files) > 1, "multi_file_patch")
            .when(files[0] != target, "target_file_mismatch")
            .when(own["hunks"] != 1, "multi_hunk")
            .when(F.size(changed) == 0, "no_changes")
            .when(F.size(changed) > 2 * pairs, "too_many_changes")
            .when(at.isNull(), "missing_hunk_header")
            .when((at < start) | (at > end), "outside_boundary")
        )

    return bound(bound(lines(diff), _parts), first_broken)

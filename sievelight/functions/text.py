"""Tokens, lines and hashes of text columns."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that end a line, a carriage return with a line feed as one.
LINE_END = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"


#: White space that is stripped from the ends of a text, control characters and Unicode's included.
WHITE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(text: Column) -> Column:
    """A text without white space at its ends."""
    return F.btrim(text, F.lit(WHITE))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lines(text: Column) -> Column:
    """Lines without their ends; a last empty line doesn't count, a null or empty text has none."""
    cut = lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return bound(F.split(F.coalesce(text, F.lit("")), LINE_END), cut)


def occurrences(text: Column, what: str) -> Column:
    """How often a fixed string occurs, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))) / len(what)).cast("long")


def ordered_distinct(values: Column) -> Column:
    """Trimmed, without blanks and nulls, the first of equals."""
    return F.array_distinct(F.filter(F.transform(values, strip), lambda x: x.isNotNull() & (x != "")))


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def excerpt(text: Column, size: int = 200) -> Column:
    return F.left(text, F.lit(size))


def _fixed2(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if pd.isna(x) else f"{x:.2f}")


def fixed2(value: Column) -> Column:
    """A number with two decimals as text, rounded by its binary value and from a tie to the even digit.

    No function of Spark's sees the binary value, so an Arrow function does it; it is meant for reports.
    """
    return F.pandas_udf(_fixed2, "string")(value.cast("double"))

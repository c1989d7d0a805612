"""Tokens with classes, as a full-text parser has them: files, urls, hosts, signed numbers, hyphenated words.

One pattern of ordered alternatives scans a text, which runs inside the JVM; urls and hyphenated words also give
their parts, behind themselves. Runs of one kind of character that can't fail behind themselves, such as words, paths and
digits, have any length. What may be scanned in vain again and again, such as an open tag or a row of labels of a host,
is bounded, so the pattern's time is linear in any text; what is longer than such a bound is split at it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bounds: of what can be of any length, of comments, of what may be scanned in vain, of parts and of labels of a host in a row.
_ANY, _COMMENT, _LONG, _PARTS, _LABELS = 999_999_999, 1_999, 255, 32, 16
_HOST = rf"(?:[A-Za-z0-9][A-Za-z0-9_-]{{0,{_LONG}}}\.){{1,{_LABELS}}}[A-Za-z][A-Za-z0-9-]{{0,{_ANY}}}(?::[0-9]{{1,{_ANY}}})?"
_PATH = rf"/[^\x00-\x20<>\x22]{{0,{_ANY}}}"
_DIGITS = rf"[0-9]{{1,{_ANY}}}"
#: The classes and what their tokens look like, first come, first served.
PATTERNS = {
    "tag": rf"<(?:!--[^>]{{0,{_COMMENT}}}|[/!?]?[A-Za-z][^<>]{{0,{_ANY}}})>",
    "entity": rf"&(?:#{_DIGITS}|#[xX][0-9A-Fa-f]{{1,{_ANY}}}|[A-Za-z][A-Za-z0-9]{{0,{_ANY}}});",
    "protocol": rf"[A-Za-z][A-Za-z0-9+]{{0,{_LONG}}}://",
    "email": rf"[A-Za-z0-9][A-Za-z0-9._+-]{{0,{_LONG}}}@{_HOST}",
    "url": _HOST + _PATH,
    "host": _HOST,
    "file": rf"(?:[A-Za-z0-9_~.][A-Za-z0-9_.-]{{0,{_LONG}}})?(?:/[A-Za-z0-9_.-]{{1,{_ANY}}}){{1,{_PARTS}}}/?",
    "version": rf"{_DIGITS}\.{_DIGITS}(?:\.{_DIGITS}){{1,{_PARTS}}}",
    "sfloat": rf"[-+]?{_DIGITS}(?:\.{_DIGITS})?[eE][-+]?{_DIGITS}",
    "float": rf"[-+]?{_DIGITS}\.{_DIGITS}",
    "hword": rf"\p{{L}}[\p{{L}}\p{{N}}]{{0,{_ANY}}}(?:-[\p{{L}}\p{{N}}]{{1,{_ANY}}}){{1,{_PARTS}}}",
    "int": rf"[-+]{_DIGITS}",
    "word": rf"[\p{{L}}\p{{N}}]{{1,{_ANY}}}",
}
#: Classes of which nothing is kept.
UNKEPT = ["tag", "entity", "protocol"]
SCAN = "|".join(PATTERNS.values())
#: The furthest place that is told apart, and the places that a token keeps.
LAST_PLACE, MOST_PLACES = 16383, 256


def _word_class(token: Column, ascii_: str, mixed: str, other: str) -> Column:
    return F.when(token.rlike("^[A-Za-z-]+$"), ascii_).when(token.rlike(r"\p{N}"), mixed).otherwise(other)


def _told(token: Column) -> Column:
    """A scanned token as (class, token), with its parts behind it."""
    pair = lambda c, t: F.struct(c.alias("class"), t.alias("token"))
    one = lambda c, t=token: F.array(pair(F.lit(c) if isinstance(c, str) else c, t))
    path = F.substr(token, F.instr(token, "/"))
    parts = F.transform(F.split(token, "-"), lambda p: pair(_word_class(p, "hword_asciipart", "hword_numpart", "hword_part"), p))
    # whether a token is of a class is asked in the order of the scan
    kinds = F.when(F.lit(False), one("tag"))
    for name, pattern in PATTERNS.items():
        hit = token.rlike(f"^(?:{pattern})$")
        if name in UNKEPT:
            kinds = kinds.when(hit, F.array().cast("array<struct<class:string,token:string>>"))
        elif name == "url":
            kinds = kinds.when(hit, F.array(pair(F.lit("url"), token), pair(F.lit("host"), F.substring_index(token, "/", 1)), pair(F.lit("url_path"), path)))
        elif name == "hword":
            kinds = kinds.when(hit, F.concat(one(_word_class(token, "asciihword", "numhword", "hword")), parts))
        elif name == "word":
            kinds = kinds.otherwise(one(F.when(token.rlike("^[0-9]+$"), "uint").otherwise(_word_class(token, "asciiword", "numword", "word"))))
        else:
            kinds = kinds.when(hit, one(name))
    return kinds


def classed_tokens(text: Column) -> Column:
    """An array of (class, token), in order, lower-cased; tags, entities and protocols are left out. Null and empty texts have none."""
    found = F.flatten(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SCAN), 0), _told))
    return F.transform(found, lambda x: F.struct(x["class"].alias("class"), F.lower(x["token"]).alias("token")))


def plain(text: Column) -> Column:
    """The tokens alone: another rule of words for search."""
    return F.transform(classed_tokens(text), lambda x: x["token"])


def classed_postings(chunks: DataFrame) -> DataFrame:
    """chunk_id, tok, pos of chunks (chunk_id, content): places from 1, all from LAST_PLACE on as one, the first MOST_PLACES of a token in a chunk."""
    rows = chunks.select("chunk_id", F.posexplode(plain(F.col("content"))).alias("pos", "tok"))
    rows = rows.select("chunk_id", "tok", F.least(F.col("pos") + 1, F.lit(LAST_PLACE)).alias("pos")).distinct()
    nth = F.row_number().over(Window.partitionBy("chunk_id", "tok").orderBy("pos"))
    return rows.withColumn("_nth", nth).filter(F.col("_nth") <= MOST_PLACES).drop("_nth")

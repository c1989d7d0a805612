"""Source files to chunks: fixed windows of lines, or function slices where a parser is at hand."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.functions import features
from sievelight.functions.text import content_hash, lines

#: A parser takes a file's text and returns (symbol, first row, row after the last) of its outermost functions.
Parser = Callable[[str], list[tuple[str, int, int]]]


def window_chunks(files: DataFrame, size: int = 200, reason: str = "tree_sitter_unavailable") -> DataFrame:
    """(path, content) to path, chunk_index, start_row, end_row (half open, from 0), content, degrade_reason.

    Windows without a visible character are left out; size is 1 at least. Lines stay in their row: a window
    is a slice of its file's line array, nothing is shuffled.
    """
    n = max(1, size)
    own = files.select("path", lines(F.col("content")).alias("own"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("own") - 1, F.lit(0)), F.lit(n))
    parts = own.filter(F.size("own") > 0).select("path", "own", F.posexplode(starts).alias("chunk_index", "start_row"))
    out = parts.select(
        "path", "chunk_index", "start_row", F.least(F.col("start_row") + n, F.size("own")).alias("end_row"),
        F.array_join(F.slice("own", F.col("start_row") + 1, F.lit(n)), "\n").alias("content"), F.lit(reason).alias("degrade_reason"),
    )
    return out.filter(F.col("content").rlike(r"\S"))


def function_chunks(files: DataFrame, parser: Parser, size: int = 200, most_bytes: int = 1 << 20) -> DataFrame:
    """Slices of functions by a parser, else windows with the reason why: too large, an error, no function.

    A file is parsed once: its slices, or the windows, are places in its array of lines; nothing is shuffled.
    """
    n, kind = max(1, size), pa.list_(pa.struct([("start_row", pa.int32()), ("end_row", pa.int32())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            reasons, found = [], []
            for text in b.column(1).to_pylist():
                reason, own = None, []
                if len((text or "").encode()) > most_bytes:
                    reason = "file_too_large"
                else:
                    try:
                        own = parser(text or "")
                        reason = None if own else "no_functions_found"
                    except ValueError:
                        reason = "tree_sitter_error_nodes"
                reasons.append(reason)
                found.append([{"start_row": a, "end_row": e} for _, a, e in own])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(reasons, pa.string()), pa.array(found, kind)], names=["path", "content", "reason", "found"])

    parsed = files.select(F.col("path").cast("string"), F.col("content").cast("string")).mapInArrow(cut, "path string, content string, reason string, found array<struct<start_row:int,end_row:int>>")
    parsed = parsed.select("path", lines(F.col("content")).alias("own"), "reason", "found")
    starts = F.sequence(F.lit(0), F.greatest(F.size("own") - 1, F.lit(0)), F.lit(n))
    windows = F.transform(starts, lambda s: F.struct(s.alias("start_row"), F.least(s + n, F.size("own")).alias("end_row")))
    parts = parsed.select("path", "own", "reason", F.posexplode(F.when(F.col("reason").isNull(), F.col("found")).otherwise(windows)).alias("chunk_index", "f"))
    content = F.array_join(F.slice("own", F.col("f.start_row") + 1, F.col("f.end_row") - F.col("f.start_row")), "\n")
    out = parts.select("path", "chunk_index", "f.start_row", "f.end_row", content.alias("content"), F.col("reason").alias("degrade_reason"))
    return out.filter(F.col("degrade_reason").isNull() | F.col("content").rlike(r"\S"))


#: One token after another: what isn't code, names, and the marks that open and close. Comments nest, so only their
#: beginning is matched; a quote before a name that no quote follows is a lifetime.
_TOKEN = re.compile(
    r"""(?P<line>//[^\n]*)|(?P<comment>/\*)|(?P<raw>\b[bc]?r(?P<hashes>\#*)")|(?P<string>\b[bc]?"|")"""
    r"""|(?P<char>\bb?'(?:\\(?:x[0-9A-Fa-f]{2}|u\{[0-9A-Fa-f_]*\}|[^\n])|[^\\'\n])'|'(?:\\(?:x[0-9A-Fa-f]{2}|u\{[0-9A-Fa-f_]*\}|[^\n])|[^\\'\n])')|(?P<lifetime>'\w+)"""
    r"""|(?P<name>r\#\w+|\w+)|(?P<mark>[{}()\[\];])|(?P<row>\n)""",
    re.X,
)
_NESTED, _STRING_END = re.compile(r"/\*|\*/"), re.compile(r'(?:[^"\\]|\\.)*+"', re.S)
#: What may stand before the name of a function's kind.
_BEFORE = {"pub", "default", "const", "async", "unsafe", "safe", "extern"}


def _tokens(text: str) -> Iterator[tuple[str, str, int]]:
    """(kind, token, row) of a source; strings come as one token of kind string. An end that is missing is an error."""
    at, row = 0, 0
    while m := _TOKEN.search(text, at):
        at, kind = m.end(), m.lastgroup if m.lastgroup != "hashes" else "raw"
        if kind == "row":
            row += 1
            continue
        if kind == "comment":
            depth = 1
            while depth:
                n = _NESTED.search(text, at)
                if not n:
                    raise ValueError("a comment doesn't end")
                depth += 1 if n[0] == "/*" else -1
                row += text.count("\n", at, n.end())
                at = n.end()
        elif kind in ("raw", "string"):
            begin = at
            if kind == "raw":
                end = text.find('"' + m["hashes"], at)
                at = end + 1 + len(m["hashes"]) if end >= 0 else -1
            else:
                n = _STRING_END.match(text, at)
                at = n.end() if n else -1
            if at < 0:
                raise ValueError("a string doesn't end")
            yield "string", text[begin:at], row
            row += text.count("\n", begin, at)
        elif kind not in ("line", "char", "lifetime"):
            yield kind, m[0], row


def rust_parser(text: str) -> list[tuple[str, int, int]]:
    """Outermost functions with a body, those of modules, traits and impls included: (symbol, first row, row after the last).

    Reads tokens, so braces and names in strings, raw strings, characters and nested comments don't count, and
    lifetimes are no characters. A function begins at its visibility and qualifiers. Brackets that don't match, and
    strings and comments without an end, are errors. Rows are parted by line feeds.
    """
    closing, found = {"}": "{", ")": "(", "]": "["}, []
    open_: list[str] = []
    own: tuple[str, int, int] | None = None  # the function that is being read: symbol, first row, brackets open before it
    body = False
    first: int | None = None  # the row where qualifiers began
    named = visible = False  # after "fn"; right after "pub", which brackets may follow
    for kind, token, row in _tokens(text):
        if kind == "mark" and token in "{([":
            if own and not body and token == "{" and len(open_) == own[2]:
                body = True
            open_.append(token)
        elif kind == "mark" and token in closing:
            if not open_ or open_.pop() != closing[token]:
                raise ValueError("brackets don't match")
            if own and body and token == "}" and len(open_) == own[2]:
                found.append((own[0], own[1], row + 1))
                own, body = None, False
        elif token == ";" and own and not body and len(open_) == own[2]:
            own = None  # a declaration
        if own:
            first, named = None, False
            continue
        if named:
            if kind == "name":
                own = (token.removeprefix("r#"), first, len(open_))
            named, first = False, None
        elif token == "fn" and kind == "name":
            named, first = True, row if first is None else first
        elif kind == "name" and token in _BEFORE:
            first = row if first is None else first
        elif not (first is not None and (kind == "string" or visible and kind in ("name", "mark") and token not in "{};")):
            first = None
        visible = first is not None and (token == "pub" or visible and not (kind == "mark" and token == ")"))
    if open_ or own:
        raise ValueError("brackets don't match")
    return found


def ingest(files: DataFrame, snapshot_id: int, *, kind: str = "rust_function_slice", lang: str = "rust", size: int = 200, parser: Parser | None = None) -> DataFrame:
    """Files to chunk rows: snapshot_id, kind, lang, content, content_hash, meta (JSON); equal chunks once, the first by path."""
    cut = function_chunks(files, parser, size) if parser else window_chunks(files, size)
    text = F.col("content")
    meta = F.to_json(
        F.struct(
            F.col("path").alias("file"), F.lit("code_slice").alias("evidence_type"), features.risk_tags(text).alias("risk_tags"), features.api_tags(text).alias("api_tags"),
            features.signature(text).alias("signature"), features.calls(text).alias("calls"),
            F.struct(F.struct(F.col("start_row").alias("row")).alias("start"), F.struct(F.col("end_row").alias("row")).alias("end")).alias("span"),
            F.col("degrade_reason").isNotNull().alias("degraded"), "degrade_reason",
        )
    )
    rows = cut.withColumn("content_hash", content_hash(text)).withColumn("meta", meta)
    first = rows.groupBy("content_hash").agg(F.min_by(F.struct("content", "meta"), F.struct(F.lower("path"), "path", "start_row")).alias("r"))
    return first.select(F.lit(snapshot_id).cast("long").alias("snapshot_id"), F.lit(kind).alias("kind"), F.lit(lang).alias("lang"), "r.content", "content_hash", "r.meta")

"""Operator 2, line dedup: content-defined chunks of lines, removed where they repeat anywhere.

A rolling hash over the hashes of neighbouring lines says where a chunk ends, so boundaries depend on the
lines around them and not on their place: a passage that is moved is cut alike. Chunks of two or more lines,
and whole texts, that occur again are removed; the first occurrence, by id and place, stays. Boundaries need
some lines to agree, so runs of RUN words or more are found without them: from every line on, and up to every
line, the least lines that hold RUN words are a window, and the windows that occur again cover just the lines
of such runs; a line that holds RUN words by itself is a run of one line.

1. Texts are put into compressed packs, which later steps read or shuffle as wholes.
2. Sieve: every distinct line of a pack, four bytes of its hash, goes to the bucket of its value; buckets tell
   the packs which lines others have too. Only chunks and windows of such lines go on.
3. Their hashes are counted, a row per pack and hash; the packs are told which occur again and where first.
4. Equal hashes only name candidates: their bytes are compared, and those that differ are put back.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.llm.packs import cuts, lean, pack_rows, runs, unpack
from sievelight.llm.scratch import Scratch

#: Lines under the rolling hash, one boundary in how many places, least lines of a chunk.
WINDOW, EVERY, LEAST_LINES = 2, 4, 2
#: Words from which a run of equal lines is a repeated passage, wherever it lies.
RUN = 50
#: Bytes of texts of a pack (compressed it stays below half a megabyte, beyond which the JVM's collector treats an
#: array as humongous), and of texts whose lines share a bucket.
PACK_BYTES, BUCKET_BYTES = 1 << 20, 512 << 20
WHOLE = -1
_MASK = (1 << 64) - 1


def _words(lines: list[str]) -> list[int]:
    return [len(x.encode().split()) for x in lines]


def chunks(lines: list[str], words: list[int] | None = None) -> list[tuple[int, int, bool]]:
    """(first line, line after the last, whether it may be removed) of each chunk, in order; they cover all lines.

    A chunk ends after a line where the rolling hash of the last WINDOW lines says so, once it has LEAST_LINES;
    a last line that is left alone joins the chunk before it. It may be removed with two lines that have words.
    """
    words = words or _words(lines)
    hashes = [xxhash.xxh3_64_intdigest(x) for x in lines]
    out: list[tuple[int, int]] = []
    start, rolling = 0, 0
    base = 0x9E3779B97F4A7C15
    drop = pow(base, WINDOW, 1 << 64)
    for i in range(len(lines)):
        rolling = (rolling * base + hashes[i]) & _MASK
        if i >= WINDOW:
            rolling = (rolling - hashes[i - WINDOW] * drop) & _MASK
        if i + 1 == len(lines) or i + 1 - start >= LEAST_LINES and (rolling >> 32) % EVERY == 0:
            out.append((start, i + 1))
            start = i + 1
    if len(out) > 1 and out[-1][1] - out[-1][0] == 1:
        out[-2:] = [(out[-2][0], out[-1][1])]
    return [(a, b, sum(w > 0 for w in words[a:b]) >= 2) for a, b in out]


def windows(lines: list[str], words: list[int] | None = None) -> list[tuple[int, int]]:
    """(first line, line after the last) of the least runs of RUN words from and up to each line that has words.

    The lines of any run of RUN words are covered by the windows inside it: the one from its first line, and
    those up to the lines after.
    """
    sums = [0]
    for n in words or _words(lines):
        sums.append(sums[-1] + n)
    out = set()
    for i in range(len(lines)):
        if sums[i + 1] > sums[i]:
            if sums[-1] - sums[i] >= RUN:
                out.add((i, bisect_left(sums, sums[i] + RUN)))
            if sums[i + 1] >= RUN:
                out.add((bisect_right(sums, sums[i + 1] - RUN) - 1, i + 1))
    return sorted(out)


def _spans(lines: list[str], words: list[int] | None = None) -> list[tuple[int, int, bool]]:
    """What may be removed, by place: chunks, then windows that aren't chunks."""
    words = words or _words(lines)
    own = chunks(lines, words)
    known = {(a, e) for a, e, may in own if may}
    return own + [(a, e, True) for a, e in windows(lines, words) if (a, e) not in known]


def _line_hashes(texts: list[str | None]) -> tuple[list[list[str]], np.ndarray]:
    """(the lines of each text, the hashes of all lines one after another)."""
    lines = [t.split("\n") if t else [] for t in texts]
    n = sum(map(len, lines))
    return lines, np.fromiter((xxhash.xxh3_64_intdigest(x) for own in lines for x in own), np.uint64, n)


def _send(buckets: int):
    """(pack, body) to (bucket, pack, low): the lower halves of the pack's distinct line hashes of a bucket, in order."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                _, hashes = _line_hashes(unpack(b.column(1)[i].as_py()).column(2).to_pylist())
                hashes = np.unique(hashes)
                at = cuts(hashes, buckets)
                used = [k for k in range(buckets) if at[k + 1] > at[k]]
                low = [hashes[at[k] : at[k + 1]].astype(np.uint32).tobytes() for k in used]
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([b.column(0)[i].as_py()] * len(used), pa.int64()), pa.array(low, pa.binary())], names=["bucket", "pack", "low"])

    return run


@lean
def _tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _send() by bucket to (pack, bucket, told): a bit for each line, whether another pack has it."""
    for rows in runs(batches):
        low = [np.frombuffer(r[2], np.uint32) for r in rows]
        every = np.sort(np.concatenate(low))
        twice = np.append(np.unique(every[1:][every[1:] == every[:-1]]), np.uint32(0xFFFFFFFF))
        told = [np.packbits(twice[np.searchsorted(twice, x)] == x).tobytes() for x in low]
        yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array(told, pa.binary())], names=["pack", "bucket", "told"])


def _occurrences(buckets: int, kind: pa.DataType):
    """Rows (pack, bucket, told, body) by pack to a row for each hash of a span whose lines repeat: (hash, pack, id, row, place, rows, places).

    rows and places name all its occurrences in the pack; id, row and place are those of the first by id.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches):
            body = unpack(next(r[3] for r in group if r[3] is not None))
            ids = body.column(0).to_pylist()
            lines, hashes = _line_hashes(body.column(2).to_pylist())
            known, at, n = np.unique(hashes, return_inverse=True, return_counts=True)
            edges, repeated = cuts(known, buckets), n > 1
            for _, bucket, told, _ in group:
                if bucket >= 0:
                    a, e = edges[bucket], edges[bucket + 1]
                    repeated[a:e] |= np.unpackbits(np.frombuffer(told, np.uint8), count=e - a).astype(bool)
            again, end = repeated[at] if len(at) else np.zeros(0, bool), 0
            met: dict[bytes, list[tuple[int, int]]] = {}
            for i, own in enumerate(lines):
                end += len(own)
                flags = again[end - len(own) : end]
                if not flags.any():
                    continue
                words = _words(own)
                run_of = np.concatenate([[0], np.cumsum(flags)])
                spans = _spans(own, words)
                raw: list[bytes] = [x.encode() for x in own]
                for place, (a, e, may) in enumerate(spans):
                    if may and run_of[e] - run_of[a] == e - a:
                        met.setdefault(hashlib.blake2b(b"\n".join(raw[a:e]), digest_size=16).digest(), []).append((i, place))
                if len(own) > 1 and flags.all() and any(may for *_, may in spans):
                    met.setdefault(hashlib.blake2b(b"\n".join(raw), digest_size=16, person=b"whole").digest(), []).append((i, WHOLE))
            first = [min(v, key=lambda x: (ids[x[0]] is not None, ids[x[0]] if ids[x[0]] is not None else 0, x)) for v in met.values()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(met), pa.binary()), pa.array([group[0][0]] * len(met), pa.int64()), pa.array([ids[i] for i, _ in first], kind),
                    pa.array([i for i, _ in first], pa.int32()), pa.array([p for _, p in first], pa.int32()),
                    pa.array([[i for i, _ in v] for v in met.values()], pa.list_(pa.int32())), pa.array([[p for _, p in v] for v in met.values()], pa.list_(pa.int32())),
                ],
                names=["hash", "pack", "id", "row", "place", "rows", "places"],
            )

    return run


def _rewrite(rest: pa.DataType):
    """Rows (pack, body, marks) to (rest, text, n_lines, n_removed_lines, pieces): pieces are the bytes to compare, compressed, once for a pack."""
    kind = pa.list_(pa.struct([("hash", pa.binary()), ("bytes", pa.binary())]))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for group in runs(batches):
            body = unpack(next(r[1] for r in group if r[1] is not None))
            texts = body.column(2).to_pylist()
            n, gone, pieces = [t.count("\n") + 1 if t else 0 for t in texts], [0] * len(texts), [None] * len(texts)
            at: dict[int, list[tuple]] = {}
            for m in [m for r in group for m in r[2] or []]:
                for k, (i, place) in enumerate(zip(m["rows"], m["places"], strict=True)):
                    here = m["first_row"] == i and m["first_place"] == place
                    at.setdefault(i, []).append((m["hash"], place, not here, k == 0))
            for i, marks in at.items():
                own = texts[i].split("\n")
                spans, out, told = _spans(own), set(), []
                for key, place, goes, tells in marks:
                    a, e = (0, len(own)) if place == WHOLE else spans[place][:2]
                    if tells:
                        told.append({"hash": key, "bytes": press.compress("\n".join(own[a:e]).encode())})
                    if goes:
                        out.update(range(a, e))
                if out:
                    gone[i], texts[i] = len(out), "\n".join(x for k, x in enumerate(own) if k not in out)
                pieces[i] = told
            yield pa.RecordBatch.from_arrays([body.column(1).cast(rest), pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(pieces, kind)], names=["rest", "text", "n_lines", "n_removed_lines", "pieces"])

    return run


@lean
def _differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (hash, bytes) by hash to the hashes whose bytes, decompressed, aren't all equal."""
    loose, key, first, out = zstandard.ZstdDecompressor(), None, None, set()
    for b in batches:
        for i in range(b.num_rows):
            h, own = b.column(0)[i].as_py(), loose.decompress(b.column(1)[i].as_py())
            if h != key:
                key, first = h, own
            elif own != first:
                out.add(h)
    yield pa.RecordBatch.from_arrays([pa.array(sorted(out), pa.binary())], names=["hash"])


def line_dedup(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: row (a struct of df's columns but the text), text without repeated chunks and runs of lines, n_lines, n_removed_lines.

    A text all of whose lines go becomes empty; a null text stays null and has no lines. The first occurrence
    is that of the smallest id (nulls first), then the earliest place; of repeated rows one counts as first. An
    empty table gives an empty result. df's own columns travel inside row, so no name can clash. A very long
    text is a pack by itself. A passage that begins or ends inside a line is found as far as its whole lines go.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "lines")
    docs = df.select(df[id_col].alias("id"), F.struct(*(df[c] for c in df.columns if c != text_col)).alias("rest"), df[text_col].cast("string").alias("text"))
    kind, rest = (docs.schema[c].dataType for c in ("id", "rest"))
    volume = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 + volume // BUCKET_BYTES
    packs = scratch.table(docs.mapInArrow(pack_rows(PACK_BYTES), "pack long, body binary"), "packs")
    told = packs.mapInArrow(_send(buckets), "bucket int, pack long, low binary").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_tell, "pack long, bucket int, told binary")
    both = packs.withColumn("bucket", F.lit(-1)).unionByName(told, allowMissingColumns=True).select("pack", "bucket", "told", "body")
    found = both.repartition("pack").sortWithinPartitions("pack").mapInArrow(
        _occurrences(buckets, to_arrow_type(kind)), f"hash binary, pack long, id {kind.simpleString()}, row int, place int, rows array<int>, places array<int>"
    )
    found = scratch.table(found, "occurrences")
    repeated = found.groupBy("hash").agg(F.sum(F.size("rows")).alias("n"), F.min(F.struct("id", "pack", "row", "place")).alias("least")).filter("n > 1").select("hash", "least")
    here = F.col("pack") == F.col("least.pack")
    marked = found.join(repeated, "hash").select("pack", F.struct("hash", "rows", "places", F.when(here, F.col("least.row")).alias("first_row"), F.when(here, F.col("least.place")).alias("first_place")).alias("mark"))
    marked = scratch.table(marked, "marked")
    scratch.drop("occurrences")

    def rewritten(marked: DataFrame, name: str) -> DataFrame:
        marks = marked.groupBy("pack").agg(F.collect_list("mark").alias("marks"))  # as many as a pack has spans, at most
        ready = packs.unionByName(marks, allowMissingColumns=True).select("pack", "body", "marks").repartition("pack").sortWithinPartitions("pack")
        return scratch.table(ready.mapInArrow(_rewrite(to_arrow_type(rest)), f"rest {rest.simpleString()}, text string, n_lines long, n_removed_lines long, pieces array<struct<hash:binary,bytes:binary>>"), name)

    out = rewritten(marked, "rewritten")
    # the comparison of bytes: all chunks of one hash must be one text
    pieces = out.select(F.explode("pieces").alias("p")).select("p.hash", "p.bytes").repartition("hash").sortWithinPartitions("hash")
    unequal = scratch.table(pieces.mapInArrow(_differ, "hash binary").distinct(), "unequal")
    if unequal.limit(1).count():  # hashes that clash prove nothing: their chunks stay
        out = rewritten(marked.join(unequal, F.col("mark.hash") == F.col("hash"), "left_anti"), "again")
    scratch.drop("packs", "marked", "unequal")
    return out.select(F.col("rest").alias("row"), "text", "n_lines", "n_removed_lines")


def op2_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return cleaned.select("row.doc_id", "n_lines", "n_removed_lines", F.crc32(F.col("text").cast("binary")).alias("text_crc32"), "text")

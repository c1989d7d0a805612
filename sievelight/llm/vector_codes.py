"""Operator 12, vector code compression: product codes of integer vectors.

Vectors become blocks of columnar NumPy parts, written once. Each round is an RDD treeAggregate over the
blocks: distances accumulate dimension by dimension, np.add.at sums the parts and counts them in int64
tensors of one entry per codebook entry, and the tensors merge through a reduction tree. What the driver
sees of a round is the codebooks' size, whatever the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelight.llm.packs import lean
from sievelight.llm.scratch import Scratch

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors in a block: its distances to a codebook are two megabytes.
BLOCK = 1024
#: Components beyond this are held at it, so that sums and squares stay within 64 bits.
MOST = 1 << 25
#: Sums of labels beyond which they aren't broadcast.
BROADCAST_ROWS = 10_000


def whole_numbers(v: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), held within MOST."""
    return np.clip(np.floor(np.asarray(v, np.float64) * SCALE), -MOST, MOST).astype(np.int64)


def in_parts(v: np.ndarray, parts: int) -> np.ndarray:
    """Vectors (n, dim) as columns (parts, width, n); the last part is filled with zeros where dim isn't a multiple."""
    n, dim = v.shape
    width = -(-dim // parts)
    full = np.zeros((n, parts * width), np.int64)
    full[:, :dim] = v
    return np.ascontiguousarray(full.T).reshape(parts, width, n)


def nearest(block: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a block (parts, width, n) and codebooks (parts, entries, width): the nearest entry (parts, n), ties to the lower, and its squared distance."""
    parts, width, n = block.shape
    code, far = np.empty((parts, n), np.int64), np.empty((parts, n), np.int64)
    for m in range(parts):
        total = np.zeros((n, books.shape[1]), np.int64)
        for j in range(width):
            apart = block[m, j][:, None] - books[m, :, j]
            apart *= apart
            total += apart
        code[m] = total.argmin(axis=1)
        far[m] = total[np.arange(n), code[m]]
    return code, far


def gathered(sums: tuple[np.ndarray, np.ndarray], block: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The tensors of sums (parts, entries, width) and counts (parts, entries) with a block's parts added."""
    code, _ = nearest(block, books)
    for m in range(len(block)):
        np.add.at(sums[0][m], code[m], block[m].T)
        np.add.at(sums[1][m], code[m], 1)
    return sums


def moved(books: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Codebooks of the floors of the means; entries that no part chose stay."""
    return np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)


@dataclass
class Codes:
    """rows: id, label, code (bytes, one a part), errors (a part each); books: (parts, entries, width)."""

    rows: DataFrame
    books: np.ndarray

    @property
    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.reshape(-1).tolist())).encode()).hexdigest()


def _blocks(parts: int, dim: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                own = b.slice(lo, BLOCK)
                v = own.column(2).flatten().to_numpy(zero_copy_only=False).reshape(own.num_rows, dim)
                body = in_parts(whole_numbers(v), parts)
                lists = [pa.ListArray.from_arrays(pa.array([0, own.num_rows], pa.int32()), pa.concat_arrays([own.column(i)])) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([body.astype(np.int32).tobytes()], pa.binary())], names=["ids", "labels", "body"])

    return run


def _loose(body: bytes, parts: int) -> np.ndarray:
    return np.frombuffer(body, np.int32).reshape(parts, -1).astype(np.int64)


def _coded(parts: int, width: int, books):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, labels = (b.column(k).slice(i, 1).flatten() for k in (0, 1))
                code, far = nearest(_loose(b.column(2)[i].as_py(), parts).reshape(parts, width, -1), books.value)
                codes = pa.array([c.tobytes() for c in np.ascontiguousarray(code.T.astype(np.uint8))], pa.binary())
                errors = pa.ListArray.from_arrays(pa.array(np.arange(0, far.size + 1, parts), pa.int32()), pa.array(np.ascontiguousarray(far.T).reshape(-1)))
                yield pa.RecordBatch.from_arrays([ids, labels, codes, errors], names=["id", "label", "code", "errors"])

    return run


def compress(
    df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> Codes:
    """Codes of the vectors, and the codebooks.

    A codebook begins as the parts of the vectors with the entries smallest ids (equal ids by components; null ids
    begin none, but are coded; fewer vectors make fewer entries; if all ids are null, by components alone). Vectors
    that are null or hold null or non-finite components are left out, and so are those of another length than the
    first of the smallest id, which have no place in its codebooks. Zeros fill up a length that isn't a multiple
    of parts. Components beyond MOST are held there. Repeated rows are coded one by one; an empty table gives no
    rows and empty codebooks; other columns aren't read. Blocks are a table, so a lost executor costs its tasks.
    At most 256 entries.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte: entries is 1 to 256")
    spark = df.sparkSession
    scratch = Scratch(spark, "codes")
    v = df.select(df[id_col].alias("id"), df[label_col].alias("label"), df[vector_col].cast("array<double>").alias("v"))
    sound = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    v = v.filter(F.col("v").isNotNull() & (F.size("v") > 0) & sound)
    first = [r["v"] for r in v.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()]  # entries rows
    kinds = dict(v.dtypes)
    schema = f"id {kinds['id']}, label {kinds['label']}, code binary, errors array<bigint>"
    if not first:
        return Codes(spark.createDataFrame([], schema), np.zeros((parts, 0, 0), np.int64))
    dim = len(first[0])
    same = v.filter(F.size("v") == dim)
    if any(len(x) != dim for x in first):
        first = [r["v"] for r in same.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()]
    ids = same.filter(F.col("id").isNotNull()).limit(entries).count()
    first = first[: ids or None]
    books = np.ascontiguousarray(in_parts(whole_numbers(np.array(first)), parts).transpose(0, 2, 1))
    width = books.shape[2]

    blocks = scratch.table(same.mapInArrow(_blocks(parts, dim), f"ids array<{kinds['id']}>, labels array<{kinds['label']}>, body binary"), "blocks")
    bodies = blocks.select("body").rdd
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(books)  # parts * entries * width numbers
        zero = (np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64))
        sums, counts = bodies.treeAggregate(
            zero,
            lambda s, r, now=now: gathered(s, _loose(r[0], parts).reshape(parts, width, -1), now.value),
            lambda a, b: (a[0] + b[0], a[1] + b[1]),
            depth=2 if bodies.getNumPartitions() < 1000 else 3,
        )
        books = moved(books, sums, counts)
        now.unpersist()
    rows = blocks.mapInArrow(_coded(parts, width, spark.sparkContext.broadcast(books)), schema)
    return Codes(scratch.table(rows, "rows"), books)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of all embeddings."""
    codes = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = codes.rows.withColumn("error", F.aggregate("errors", F.lit(0).cast("long"), lambda s, x: s + x))
    by_label = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    if by_label.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        by_label = F.broadcast(by_label)
    out = rows.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codes.digest).alias("codebooks_sha256"))

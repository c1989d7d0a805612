"""Operator 4, packing: documents in the order of a space-filling curve, cut into full sequences.

A document's token ids give a hashed count vector; a fixed random projection takes it to four
dimensions, whose cell on a Hilbert curve is its key. Whole sequences inside a document stand
alone; the tails (shorter than a sequence) are laid end to end along the curve and cut at every
`length` tokens, so that one sequence holds neighbours and only the very last is padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sievelight.llm import bpe
from sievelight.llm.packs import lean
from sievelight.llm.scratch import Scratch

TOKENIZER, LENGTH, END_ID = "byte_bpe_50k.json", 1024, 0
HASHED, DIMS, BITS = 256, 4, 8
#: Cells of the curve whose sums the driver sees, whatever the input: the first CELL_BITS bits of a key.
CELL_BITS = 16
#: Documents that one unit of work along the curve should have at least.
UNIT_DOCS = 1000


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Distance along the Hilbert curve of each row of coordinates in [0, 2**bits)."""
    x = [points[:, i].astype(np.int64) for i in range(points.shape[1])]
    n, q = len(x), 1 << (bits - 1)
    while q > 1:  # undo the excess work: rotations and reflections of sub-cubes
        low = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & low
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = np.where(high, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    gray, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        gray = np.where((x[-1] & q) != 0, gray ^ (q - 1), gray)
        q >>= 1
    x = [v ^ gray for v in x]
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for v in x:
            key = (key << 1) | ((v >> b) & 1)
    return key


def document_keys(ids: np.ndarray, n: np.ndarray, seed: int = 17) -> np.ndarray:
    """Hilbert keys of documents whose ids stand one after another in ids; without ids, the projection of zero."""
    rng = np.random.default_rng(seed)
    plane = rng.standard_normal((HASHED, DIMS))
    plane -= plane.mean(axis=0)
    slot = (ids.astype(np.uint64) * np.uint64(0x9E3779B1) >> np.uint64(16)) % np.uint64(HASHED)
    row = np.repeat(np.arange(len(n)), n)
    count = np.bincount(row * HASHED + slot.astype(np.int64), minlength=len(n) * HASHED).reshape(len(n), HASHED)
    v = np.sqrt(count)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    at = (np.tanh(v @ plane) + 1) / 2 * (1 << BITS)
    return hilbert_keys(np.clip(at.astype(np.int64), 0, (1 << BITS) - 1))


def _tokenize(path: str, length: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, ids, n in bpe.encode_texts(path, b.column(1)):
                keys, ends = document_keys(ids, n), np.cumsum(n)
                heads, tails = [], []
                for start, end in zip(ends - n, ends, strict=True):
                    own = np.append(ids[start:end], END_ID).astype("<u4")
                    full = len(own) // length * length
                    heads.append([zlib.crc32(own[k : k + length].tobytes()) for k in range(0, full, length)])
                    tails.append(own[full:].astype("<u2" if own.max() < 1 << 16 else "<u4").tobytes())
                wide = [len(t) != 2 * ((int(k) + 1) % length) for t, k in zip(tails, n, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(keys), pa.array(n + 1), pa.array(heads, pa.list_(pa.int64())), pa.array(wide), pa.array(tails, pa.binary())],
                    names=["id", "hilbert_key", "doc_tokens", "heads", "wide", "tail"],
                )

    return run


def _cut(length: int, kind: pa.DataType):
    """Pieces of documents that come sorted by unit; run_tail and run_heads go on from document to document."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, at, head = None, 0, 0
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("row", "start", "length", "crc", "seq", "offset")}

            def piece(row, start, size, crc, seq, offset, out=out):
                for k, v in zip(out, (row, start, size, crc, seq, offset), strict=True):
                    out[k].append(v)

            cols = {k: b.column(b.schema.get_field_index(k)).to_pylist() for k in ("unit", "tail_base", "head_base", "doc_tokens", "heads", "wide", "tail")}
            for i, (u, tail_base, head_base, n, heads, wide, tail) in enumerate(zip(*cols.values(), strict=True)):
                if u != unit:
                    unit, at, head = u, tail_base, head_base
                for k, crc in enumerate(heads):
                    piece(i, k * length, length, crc, head, 0)
                    head += 1
                ids, start = np.frombuffer(tail, "<u4" if wide else "<u2").astype("<u4"), len(heads) * length
                done = 0
                while done < len(ids):
                    size = min(len(ids) - done, length - at % length)
                    piece(i, start + done, size, zlib.crc32(ids[done : done + size].tobytes()), at // length, at % length)
                    done, at = done + size, at + size
            row = pa.array(out["row"], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(row).cast(kind), pa.array(out["start"], pa.int64()), pa.array(out["length"], pa.int64()), pa.array(out["crc"], pa.int64()),
                    b.column(b.schema.get_field_index("doc_tokens")).take(row), pa.array(out["seq"], pa.int64()), pa.array(out["offset"], pa.int64()),
                    b.column(b.schema.get_field_index("hilbert_key")).take(row),
                ],
                names=["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "hilbert_key"],
            )

    return run


def pack(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, length: int = LENGTH) -> DataFrame:
    """Pieces of all documents: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, hilbert_key.

    Every document ends with id 0, so an empty or null text is one token long. Repeated rows and null ids
    are packed like any other row; ties on the curve go by id, then by content; an empty table gives an
    empty result; other columns aren't read. Sequences of tails are numbered first, along the curve, then
    those that lie inside one document. A cell of the curve with very many documents (copies) is dealt
    over units by a hash of the id, so no task gets it whole. The driver sees 2**CELL_BITS cells and twice
    as many units at most.
    """
    spark, path = df.sparkSession, tokenizer or bpe.tokenizer_path(TOKENIZER)
    kind = df.schema[id_col].dataType
    scratch = Scratch(spark, "pack")
    own = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"))
    docs = scratch.table(own.mapInArrow(_tokenize(path, length), f"id {kind.simpleString()}, hilbert_key long, doc_tokens long, heads array<long>, wide boolean, tail binary"), "docs")
    shift = DIMS * BITS - CELL_BITS
    docs = docs.withColumn("cell", F.shiftright("hilbert_key", shift).cast("int"))
    cells = docs.groupBy("cell").count().collect()  # at most 2**CELL_BITS rows
    total = sum(r["count"] for r in cells)
    target = max(UNIT_DOCS, total >> CELL_BITS)
    plan, unit, held = [], 0, 0
    for r in sorted(cells, key=lambda r: r["cell"]):
        if r["count"] > 2 * target:
            unit += bool(held)
            n = -(-r["count"] // target)
            plan.append((r["cell"], unit, n))
            unit, held = unit + n, 0
        else:
            if held + r["count"] > target and held:
                unit, held = unit + 1, 0
            plan.append((r["cell"], unit, 1))
            held += r["count"]
    units = spark.createDataFrame(plan, "cell int, first int, n int")
    dealt = docs.join(F.broadcast(units), "cell").withColumn("unit", F.col("first") + F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    sums = dealt.groupBy("unit").agg(F.sum(F.pmod("doc_tokens", F.lit(length))).alias("tail"), F.sum(F.size("heads")).alias("heads")).collect()  # at most twice as many
    at, head, bases = 0, -(-sum(r["tail"] for r in sums) // length), []
    for r in sorted(sums, key=lambda r: r["unit"]):
        bases.append((r["unit"], at, head))
        at, head = at + r["tail"], head + r["heads"]
    ready = dealt.join(F.broadcast(spark.createDataFrame(bases, "unit int, tail_base long, head_base long")), "unit")
    ready = ready.select("id", "unit", "tail_base", "head_base", "hilbert_key", "doc_tokens", "heads", "wide", "tail")
    ready = ready.repartitionByRange("unit").sortWithinPartitions("unit", "hilbert_key", "id", "doc_tokens", "tail")
    out = ready.mapInArrow(
        _cut(length, to_arrow_type(kind)),
        f"id {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, hilbert_key long",
    )
    return out.withColumnRenamed("id", id_col)


def op4_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))

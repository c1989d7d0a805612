"""Operator 6, embedding near-dedup: subspace pigeonhole join.

Unit vectors with cosine >= c are at a squared distance of 2(1-c) at most. A fixed rotation is split into
blocks of few dimensions; if every block of a pair were further apart than its share of that budget, in
proportion to its dimensions, the pair would be too. So each linked pair is near in some block, and a
range join of every block, along its first coordinate or by a grid over some whose cells are as wide as the
block's reach, finds it. Candidates are checked by their cosine in double precision, in the first block in
which they are near, and nowhere else.

A label's vectors are dealt as pairs of chunks, and a task joins its two chunks block by block: each vector
travels once for each chunk of its label, whatever the number of blocks. What travels is the unit vector in
16-bit numbers and how far that is from it; a pair whose cosine is too near to the limit to tell is decided by
the exact vectors afterwards.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.llm.components import components
from sievelight.llm.packs import lean
from sievelight.llm.scratch import Scratch

LEAST, BLOCK = 0.93, 8
#: Vectors of a label beyond which one more coordinate of a block makes a grid of cells; up to the first, a label is one
#: cell of all blocks. A cell is about as wide as a coordinate's deviation, so a grid sends each vector many times over and
#: only spares comparisons, which one coordinate in order spares as well.
GRID = (5_000_000, 5_000_000, 5_000_000, 2_500_000_000)
#: Vectors of a cell that one task compares; fuller cells are dealt as pairs of chunks, which grow from here up to
#: CHUNK_BYTES of doubles once there are CHUNKS of them, or one or two fewer where many labels keep the tasks busy.
CELL_ROWS, CHUNKS, CHUNK_BYTES = 3000, 4, 32 << 20
#: What rounding to 16 bits may add to a pair's distance, half of it by each vector; one that loses more is sent exactly.
LOOSE = 5e-4
#: Rows and columns of distances at a time, and what rounding to single precision may add to one (of unit vectors).
TILE, TILE_MOST, SLACK = 256, 4096, 1e-5
#: The block of a cell that is compared in all of them.
ALL = -1


@lru_cache(maxsize=8)
def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def rotated(x: np.ndarray) -> np.ndarray:
    """Unit vectors, rotated; summed one coordinate after another, so a row's result doesn't depend on its neighbours."""
    norm = np.zeros(len(x))
    for j in range(x.shape[1]):
        norm += x[:, j] * x[:, j]
    unit, turn = x / np.sqrt(norm)[:, None], rotation(x.shape[1])
    out = np.zeros_like(unit)
    for j in range(x.shape[1]):
        out += unit[:, j, None] * turn[j]
    return out


def budgets(dim: int, least: float) -> tuple[list[slice], np.ndarray]:
    """The blocks and what each may use of the squared distance; a hair more than exact, for rounding."""
    cuts = [slice(a, min(a + BLOCK, dim)) for a in range(0, dim, BLOCK)]
    return cuts, np.array([(s.stop - s.start) / dim * 2 * (1 - least) * (1 + 1e-9) + 1e-12 for s in cuts])


def _vector(raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, {2 * dim: "<i2", 4 * dim: "<f4"}.get(len(raw), "<f8")).astype(np.float64)


def _rounded(x: np.ndarray, exact: bytes) -> tuple[bytes, float]:
    """(a vector in 16-bit numbers, how far its direction is from the unit vector at most), or its exact form and 0 if that is too far."""
    unit = x / np.sqrt(x @ x)
    q = np.rint(unit * (32767 / np.abs(unit).max()))
    off = float(np.sqrt(((q / np.sqrt(q @ q) - unit) ** 2).sum())) * (1 + 1e-6) + 1e-13
    return (q.astype("<i2").tobytes(), off) if off <= LOOSE / 2 else (exact, 0.0)


_CLASSES = "label string, key binary, dim int, raw binary, off double"


def _classes(form: str):
    """(id, label, vector) to (id, label, key, dim, raw, off); key is null where a vector links with nothing; form: none, short or exact."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, dims, raws, offs = [], [], [], []
            for label, v in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                key = dim = raw = off = None
                if label is not None and v.is_valid and len(v.values):
                    x = np.array(v.values.to_numpy(zero_copy_only=False), np.float64)  # nulls become NaN
                    if np.isfinite(x).all() and x.any():
                        x = x + 0.0  # -0.0 is 0.0
                        with np.errstate(over="ignore"):
                            short = x.astype("<f4")
                        big = np.abs(x).max()
                        if not 1e-100 < big < 1e100:  # its square would leave the range; the cosine doesn't depend on it
                            x, short = x / big, np.zeros(0)
                        dim, key = len(x), hashlib.blake2b(repr((label, len(x))).encode() + x.tobytes(), digest_size=16).digest()
                        if form != "none":
                            raw, off = (short if len(short) and (short == x).all() else x.astype("<f8")).tobytes(), 0.0
                        if form == "short":
                            raw, off = _rounded(x, raw)
                keys.append(key)
                dims.append(dim)
                raws.append(raw)
                offs.append(off)
            columns = [b.column(0), b.column(1).cast(pa.string()), pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(raws, pa.binary()), pa.array(offs, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", *(c.split()[0] for c in _CLASSES.split(", "))])

    return run


def _cells(least: float):
    """Distinct vectors (label, dim, key, copies, raw, off, grid) to a row per block and cell they are compared in."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = b.to_pydict()
            for dim in sorted(set(cols["dim"])):
                rows = [i for i, d in enumerate(cols["dim"]) if d == dim]
                at = [i for i in rows if not cols["grid"][i]]
                block, cell, home = [ALL] * len(at), [""] * len(at), [True] * len(at)
                rows = [i for i in rows if cols["grid"][i]]
                turned = rotated(np.array([_vector(cols["raw"][i], dim) for i in rows]).reshape(len(rows), dim))
                blocks, reach = budgets(dim, least)
                for k, cut in enumerate(blocks if rows else []):
                    width = np.sqrt(reach[k])
                    spot = np.floor(turned[:, cut] / width).astype(np.int64)
                    for r, i in enumerate(rows):
                        g = min(cols["grid"][i], spot.shape[1])
                        for off in itertools.product((-1, 0, 1), repeat=g):
                            if off < (0,) * g:  # the cells before it, where it is a guest
                                continue
                            at.append(i)
                            block.append(k)
                            cell.append(",".join(str(s - o) for s, o in zip(spot[r], off, strict=False)))
                            home.append(not any(off))
                index = pa.array(at, pa.int64())
                names = ["label", "dim", "key", "copies", "raw", "off"]
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)).take(index) for n in names), pa.array(block, pa.int32()), pa.array(cell, pa.string()), pa.array(home)], names=[*names, "block", "cell", "home"])

    return run


def _tiles(y: np.ndarray, reach: float, sides: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows at a squared distance of reach or less, and a few just beyond; with sides, only pairs across them.

    Rows are put in order of the first coordinate, and only those that are near by it are looked at.
    """
    order, width = np.argsort(y[:, 0], kind="stable"), np.sqrt(reach) + SLACK
    left = order if sides is None else order[~sides[order]]
    right = order if sides is None else order[sides[order]]
    norm, one = (y * y).sum(axis=1)[:, None], np.ones((len(y), 1))
    a, b = np.hstack([-2 * y, norm, one]).astype("<f4")[left], np.hstack([y, one, norm]).astype("<f4")[right]
    x0, x1 = y[left, 0], y[right, 0]
    for lo in range(0, len(left), TILE):
        part = slice(lo, min(lo + TILE, len(left)))
        begin = lo if sides is None else np.searchsorted(x1, x0[lo] - width)
        end = np.searchsorted(x1, x0[part.stop - 1] + width, side="right")
        for at in range(begin, end, TILE_MOST):
            own = b[at : min(at + TILE_MOST, end)]
            i, j = np.divmod(np.flatnonzero(a[part] @ own.T <= reach + SLACK), len(own))
            i, j = i + lo, j + at
            if sides is None:
                i, j = i[j > i], j[j > i]
            if len(i):
                yield left[i], right[j]


def near_pairs(x: np.ndarray, home: np.ndarray, sides: np.ndarray | None, block: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(Index pairs, cosines) of linked vectors of a cell that are near in this block (or in any, by turns) and in none before it; with sides, only pairs across them."""
    turned, (blocks, reach) = rotated(x), budgets(x.shape[1], least)
    length = np.sqrt((x * x).sum(axis=1))
    for own in range(len(blocks)) if block == ALL else [block]:
        for i, j in _tiles(turned[:, blocks[own]], reach[own], sides):
            ok = home[i] | home[j]
            i, j = i[ok], j[ok]
            for s in range(0, len(i), 16384):
                a, b = i[s : s + 16384], j[s : s + 16384]
                for k in [own, *range(own)]:  # most that are near by rounding only, or by an earlier block, go here
                    near = ((turned[a, blocks[k]] - turned[b, blocks[k]]) ** 2).sum(axis=1) <= reach[k]
                    a, b = (a[near], b[near]) if k == own else (a[~near], b[~near])
                cos = _cosines(x[a], x[b], length[a], length[b])
                linked = cos >= least
                yield a[linked], b[linked], cos[linked]


def _cosines(x: np.ndarray, y: np.ndarray, long_x: np.ndarray, long_y: np.ndarray) -> np.ndarray:
    return (x * y).sum(axis=1) / (long_x * long_y)


_LINKED = "key binary, root binary, links long, sure boolean"


def _linked(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[], [], [], []]
    types = [pa.binary(), pa.binary(), pa.int64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["key", "root", "links", "sure"])


def _compare(least: float):
    """Sorted rows of cells to (key, root, links, sure): of each vector with a link, one it reaches and its number of links there; and pairs that aren't sure."""

    def group(rows: list[tuple]) -> Iterator[tuple]:
        (_, dim, block, _, left, right), x = rows[0][:6], np.array([_vector(r[9], r[1]) for r in rows])
        sides = None if left == right else np.array([r[6] == right for r in rows])
        home, copies, off = np.array([r[10] for r in rows]), np.array([r[8] for r in rows]), np.array([r[11] for r in rows])
        root, links = np.arange(len(rows)), np.zeros(len(rows), np.int64)
        for a, b, cos in near_pairs(x, home, sides, block, least - LOOSE):
            slack = off[a] + off[b]
            slack += np.where(slack > 0, 1e-12, 0)
            open_ = (slack > 0) & (np.abs(cos - least) <= slack)
            for i, j in zip(a[open_], b[open_], strict=True):
                yield rows[i][7], rows[j][7], None, False
            linked = ~open_ & (cos >= least)
            a, b = a[linked], b[linked]
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            while len(apart := np.flatnonzero(root[a] != root[b])):  # roots are hung on smaller ones until all links are inside
                a, b = a[apart], b[apart]
                np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
                while (root[root] != root).any():
                    root = root[root]
        for i in np.flatnonzero(links):
            yield rows[i][7], rows[root[i]][7], int(links[i]), True

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        done: list[tuple] = []

        def out(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            for r in group(rows):
                done.append(r)
                if len(done) > 10_000:
                    yield _linked(done)
                    done.clear()

        for b in batches:
            for r in zip(*(b.column(i).to_pylist() for i in range(12)), strict=True):
                if held and held[0][:6] != r[:6]:
                    yield from out(held)
                    held = []
                held.append(r)
        if held:
            yield from out(held)
        yield _linked(done)

    return run


def _decide(least: float):
    """Pairs with their exact vectors (a, b, dim, copies and raw of each) to rows of linked ones, as _compare() has them."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for a, b, dim, m, n, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = _vector(x, dim)[None], _vector(y, dim)[None]
                if _cosines(x, y, np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1)))[0] >= least:
                    done += [(a, b, n, True), (b, a, m, True)]
            yield _linked(done)

    return run


def embedding_dedup(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = LEAST) -> DataFrame:
    """One row per row of df: id, n_links, component_id, kept.

    Vectors of equal, not null label and equal dimension link when their cosine in double precision is least
    or more. n_links is the number of other rows linked directly, component_id the smallest id reachable by
    links, itself included, kept whether that is its own. Null or zero vectors and those with null or
    non-finite components link with nothing, and so do rows without a label. Equal vectors are compared
    once and counted as often as they occur. A label's vectors beyond CELL_ROWS are compared in pairs of chunks,
    all of them: the work grows with the square of a label, and what is sent with its number of chunks. A null id
    takes part and is never a smallest id. An empty table gives an empty result; other columns aren't read.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "embeddings")
    kind = df.schema[id_col].dataType.simpleString()
    given = df.select(df[id_col].alias("id"), df[label_col].alias("label"), df[vector_col].cast("array<double>").alias("vector"))
    made = lambda form: given.mapInArrow(_classes(form), f"id {kind}, {_CLASSES}")  # noqa: E731  vectors are made anew where they are needed, and lie on disk once, in the cells
    rows = scratch.table(made("none").select("id", "label", "key", "dim"), "rows")
    valid = rows.filter("key is not null")
    classes = valid.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    grid = sum((F.when(F.col("m") > n, 1).otherwise(0) for n in GRID), F.lit(0))
    sizes = scratch.table(valid.groupBy("label", "dim").agg(F.countDistinct("key").alias("m")).withColumn("grid", grid), "sizes")
    found = sizes.agg(F.max("grid").alias("grid"), F.count_if(F.col("m") > CELL_ROWS).alias("full")).first()
    group = ["label", "dim", "block", "cell"]
    vectors = made("short").filter("key is not null").groupBy("key").agg(F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("label", "dim", "raw", "off")))
    cells = vectors.join(sizes.select("label", "dim", "grid"), ["label", "dim"]).select("label", "dim", "key", "copies", "raw", "off", "grid")
    cells = scratch.table(cells.mapInArrow(_cells(least - LOOSE), "label string, dim int, key binary, copies long, raw binary, off double, block int, cell string, home boolean"), "cells")
    # cells without two vectors to compare have no task; full ones are dealt as pairs of chunks
    full = sizes.select("label", "dim", F.lit(ALL).alias("block"), F.lit("").alias("cell"), "m").filter("m > 1")
    if found["grid"]:
        full = cells.groupBy(*group).agg(F.count("*").alias("m"), F.count_if("home").alias("homes")).filter("m > 1 and homes > 0")
    least_chunks = max(min(CHUNKS, 2), CHUNKS - (found["full"] > 2) - (found["full"] > 7))
    most = F.greatest(F.lit(CELL_ROWS), F.floor(F.lit(CHUNK_BYTES) / (8 * F.col("dim"))))
    full = scratch.table(full.select(*group, F.least(F.ceil(F.col("m") / CELL_ROWS), F.greatest(F.lit(least_chunks), F.ceil(F.col("m") / most))).cast("int").alias("k")), "full")
    dealt = cells.join(full, group)
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("k")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = dealt.select(*group, F.least("chunk", "other").alias("left"), F.greatest("chunk", "other").alias("right"), "chunk", "key", "copies", "raw", "home", "off")
    group += ["left", "right"]
    linked = scratch.table(dealt.repartition(*group).sortWithinPartitions(*group, "key").mapInArrow(_compare(least), _LINKED), "linked")
    scratch.drop("cells")
    open_ = linked.filter("not sure").select(F.col("key").alias("a"), F.col("root").alias("b"))
    if not open_.isEmpty():
        keys = open_.select(F.explode(F.array("a", "b")).alias("key")).distinct()
        exact = made("exact").join(keys, "key", "left_semi").groupBy("key").agg(F.count("*").alias("copies"), F.first("dim").alias("dim"), F.first("raw").alias("raw"))
        exact = scratch.table(exact, "exact")
        side = lambda c, n, raw, *more: exact.select(F.col("key").alias(c), F.col("copies").alias(n), F.col("raw").alias(raw), *more)
        pairs = open_.join(side("a", "m", "x", "dim"), "a").join(side("b", "n", "y"), "b").select("a", "b", "dim", "m", "n", "x", "y")
        checked = scratch.table(pairs.mapInArrow(_decide(least), _LINKED), "checked")
        scratch.drop("exact")
        linked = linked.filter("sure").union(checked)
    total = linked.groupBy("key").agg(F.sum("links").alias("links"))
    reach = components(linked.select(F.col("key").alias("a"), F.col("root").alias("b")), scratch)
    label = classes.select("key", "rep", "copies").join(reach.select(F.col("node").alias("key"), F.col("component").alias("root")), "key", "left").withColumn("root", F.coalesce("root", "key"))
    label = label.join(label.groupBy("root").agg(F.min("rep").alias("least")), "root").join(total, "key", "left")
    label = label.select("key", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    out = rows.select("id", "key").join(label, "key", "left").withColumn("component_id", F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("least")))
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def linked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings with two jittered rows of each, chains whose neighbours link and whose ends may not: the table itself has few links or none."""
    own = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")
    shift = lambda k: F.transform("embedding", lambda x, i: x + (k * 0.005 + (F.col("vec_id") % 7) * 0.004) * ((i * (7 + k) + F.col("vec_id")) % 5 - 2))
    renamed = lambda df: df.withColumn("vec_id", F.col("vec_id") + 1_000_000)  # noqa: E731  after the shift, which the old id decides
    moved = renamed(own.withColumn("embedding", shift(1)))
    again = renamed(moved.withColumn("embedding", shift(2)))
    return own.unionByName(moved).unionByName(again)


def linked_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(linked_vectors(spark, sf_dir))


def op6_subspace_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))

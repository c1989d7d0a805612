"""A stored inverted index of chunks that follows their changes, and top-k search that leaves out hopeless blocks.

Under a path there are generations, in each the tables postings/segment=<s>/part=<p> and removed/segment=<s>:

* A row of postings is a block: what one token has in a range of chunk ids, with the most places it has in any of
  these chunks. Blocks lie in folders by a hash of the token, sorted by it; the files of a folder share its ranges.
* A change writes a new segment: blocks of the new and changed chunks, and last the ids that it changed or removed,
  which hide what older segments have of them. A segment counts once that last table is there, so a job that failed
  halfway leaves nothing to be seen.
* merge() writes the live blocks as one segment of a new generation, which counts on the same terms.

Searches read the folders of their tokens only.

Tasks put the tokens of many chunks together to pieces of blocks, in five bytes a place, before anything is shuffled;
pieces are shuffled once, to the folder and file of their block, and put together there in the order of the file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievelight.functions.text import tokens

PARTS = 64
#: Ids in a block's range, and chunks for which a folder has one more file.
SPAN, SLICE_CHUNKS = 256, 1_000_000
#: Tokens, or places, that a task handles at a time.
TOKENS_AT_ONCE = 1 << 20
#: A place in a piece of a block: the chunk's number in the range, which has 256 at most, and the token's in the chunk.
_PLACE = np.dtype([("of", "u1"), ("pos", "<i4")])
_PIECE = "snapshot_id long, tok string, span long, body binary"
#: Ranges that a search looks at first, those up to which it reads all at once, and those beyond which they are joined
#: and not listed in a filter.
FIRST, WHOLE, LISTED = 16, 64, 5_000
#: Bytes of the files of a query's tokens up to which they are read without a look at the bounds.
SHORT_BYTES = 64 << 20
_BLOCK = "snapshot_id long, tok string, span long, most int, hits array<struct<chunk_id:bigint,pos:int>>, segment int, part int"


def _store(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def _numbers(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers k of the folders <name>=k under a path."""
    store, p = _store(spark, path)
    if not store.exists(p):
        return []
    found = [f.getPath().getName() for f in store.listStatus(p)]
    return sorted(int(f.split("=")[1]) for f in found if f.startswith(f"{name}="))


def _exists(spark: SparkSession, path: str) -> bool:
    store, p = _store(spark, path)
    return store.exists(p)


@dataclass(frozen=True)
class State:
    """What of an index counts: the folder of its generation and the segments in it."""

    folder: str
    generation: int
    segments: tuple[int, ...]


def state(spark: SparkSession, path: str) -> State:
    for g in reversed(_numbers(spark, path, "generation")):
        folder = f"{path}/generation={g}"
        whole = tuple(s for s in _numbers(spark, f"{folder}/removed", "segment") if _exists(spark, f"{folder}/removed/segment={s}/_SUCCESS"))
        if whole:
            return State(folder, g, whole)
    raise ValueError(f"no index at {path}")


def _hash(tok: Column, parts: int = PARTS) -> Column:
    return (F.crc32(tok.cast("binary")) % parts).cast("int")


def _bodies(places: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Places, cut at the edges, as binaries."""
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * _PLACE.itemsize).astype(np.int32)), pa.py_buffer(places)])


def _places_in(bodies: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all places of an array of binaries, places in each)."""
    n = pc.binary_length(bodies).to_numpy(zero_copy_only=False).astype(np.int64) // _PLACE.itemsize
    begin = np.frombuffer(bodies.buffers()[1], np.int32, len(bodies) + 1 + bodies.offset)[bodies.offset] if len(bodies) else 0
    return np.frombuffer(bodies.buffers()[2] or b"", _PLACE, int(n.sum()), int(begin)) if n.sum() else np.zeros(0, _PLACE), n


def _cut(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, number) of rows of TOKENS_AT_ONCE together, or one that has more."""
    lo, ends = 0, np.cumsum(sizes)
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + TOKENS_AT_ONCE, side="right")))
        yield lo, hi - lo
        lo = hi


def _as_pieces(span: int):
    """(snapshot_id, chunk_id, tokens) to pieces: what a token has in a range of a snapshot, of the chunks that come together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pc.fill_null(pc.list_value_length(b.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, n in _cut(sizes):
                snapshot, ids, lists = (c.slice(lo, n) for c in b.columns)
                chunk, snap = ids.to_numpy(zero_copy_only=False), pc.dictionary_encode(snapshot, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                order = np.lexsort([chunk, chunk // span, snap])
                lists, chunk, snap, size = lists.take(pa.array(order)), chunk[order], snap[order], sizes[lo : lo + n][order]
                range_ = np.cumsum(np.append(0, (snap[1:] != snap[:-1]) | (chunk[1:] // span != chunk[:-1] // span)))
                words = lists.flatten().dictionary_encode()
                code, row = words.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(n), size)
                if not len(code):
                    continue
                places = np.empty(len(code), _PLACE)
                places["of"], places["pos"] = (chunk % span)[row], np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + 1
                by = np.argsort(code, kind="stable")
                code, row = code[by], row[by]
                begin = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (range_[row][1:] != range_[row][:-1])))
                first = row[begin]
                yield pa.RecordBatch.from_arrays(
                    [snapshot.take(pa.array(order[first])).cast(pa.int64()), words.dictionary.take(pa.array(code[begin])), pa.array(chunk[first] // span), _bodies(places[by], np.append(begin, len(code)))], names=["snapshot_id", "tok", "span", "body"]
                )

    return run


def _as_blocks(span: int):
    """Pieces (snapshot_id, tok, span, body, part), sorted, to blocks."""
    whole = pa.schema([("snapshot_id", pa.int64()), ("tok", pa.string()), ("span", pa.int64()), ("body", pa.binary()), ("part", pa.int32())])

    def starts(t: pa.RecordBatch) -> np.ndarray:
        """Whether a row begins a block."""
        new = np.zeros(max(t.num_rows - 1, 0), bool)
        for c in (t.column(1), t.column(2), pc.is_null(t.column(0)), pc.fill_null(t.column(0), 0)):
            new |= pc.not_equal(c.slice(1), c.slice(0, len(new))).to_numpy(zero_copy_only=False)
        return np.append(True, new)

    def blocks(t: pa.RecordBatch) -> pa.RecordBatch:
        places, n = _places_in(t.column(3))
        begin = np.flatnonzero(starts(t))
        block = np.repeat(np.repeat(np.arange(len(begin)), np.diff(np.append(begin, t.num_rows))), n)
        of, pos = places["of"].astype(np.int64), places["pos"]
        if ((block[1:] == block[:-1]) & (of[1:] < of[:-1])).any():
            by = np.lexsort([pos, of, block])
            of, pos = of[by], pos[by]
        chunk = t.column(2).to_numpy(zero_copy_only=False)[begin][block] * span + of
        new = np.flatnonzero(np.append(True, (block[1:] != block[:-1]) | (of[1:] != of[:-1])))  # each chunk's places
        most = np.maximum.reduceat(np.diff(np.append(new, len(block))), np.flatnonzero(np.append(True, block[new][1:] != block[new][:-1])))
        edges = pa.array(np.searchsorted(block, np.arange(len(begin) + 1)), pa.int32())
        hits = pa.ListArray.from_arrays(edges, pa.StructArray.from_arrays([pa.array(chunk), pa.array(pos, pa.int32())], names=["chunk_id", "pos"]))
        own = t.take(pa.array(begin))
        return pa.RecordBatch.from_arrays([own.column(0), own.column(1), own.column(2), pa.array(most, pa.int32()), hits, own.column(4)], names=["snapshot_id", "tok", "span", "most", "hits", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # pieces of the block that isn't at its end, perhaps
        for b in batches:
            for lo, n in _cut(pc.binary_length(b.column(3)).to_numpy(zero_copy_only=False) // _PLACE.itemsize):
                t = pa.Table.from_batches([*held, pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(b.slice(lo, n).columns, whole, strict=True)], schema=whole)]).combine_chunks().to_batches()[0]
                last = int(np.flatnonzero(starts(t))[-1])
                if last:
                    yield blocks(t.slice(0, last))
                held = [t.slice(last)]
        if held:
            yield blocks(held[0])

    return run


def _write(pieces: DataFrame, folder: str, segment: int, gone: DataFrame, slices: int) -> None:
    """A segment of pieces; gone has the chunk ids that it hides in older ones."""
    conf, name = pieces.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    dealt = pieces.withColumn("part", _hash(F.col("tok"))).repartition("part", F.pmod("span", F.lit(slices))).sortWithinPartitions("part", "tok", "snapshot_id", "span")
    rows = dealt.mapInArrow(_as_blocks(SPAN), "snapshot_id long, tok string, span long, most int, hits array<struct<chunk_id:bigint,pos:int>>, part int")
    kept = conf.get(name, None)
    conf.set(name, str(PARTS))  # rows come in order, which the writer doesn't know and would sort again
    try:
        rows.write.mode("overwrite").partitionBy("part").parquet(f"{folder}/postings/segment={segment}")
    finally:
        conf.unset(name) if kept is None else conf.set(name, kept)
    gone.select(F.col("chunk_id").cast("long")).distinct().write.mode("overwrite").parquet(f"{folder}/removed/segment={segment}")


def _pieces(chunks: DataFrame) -> DataFrame:
    own = chunks.select(F.col("snapshot_id").cast("long"), F.col("chunk_id").cast("long"), tokens(F.col("content")).alias("toks"))
    return own.filter("chunk_id is not null").mapInArrow(_as_pieces(SPAN), _PIECE)


def _packed(span: int):
    """Blocks (snapshot_id, tok, span, hits, segment) with their places in five bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, flat = pc.list_value_length(b.column(3)).to_numpy(zero_copy_only=False).astype(np.int64), b.column(3).flatten()
            places = np.empty(len(flat), _PLACE)
            places["of"], places["pos"] = flat.field(0).to_numpy(zero_copy_only=False) % span, flat.field(1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], _bodies(places, np.append(0, np.cumsum(n))), b.column(4)], names=["snapshot_id", "tok", "span", "body", "segment"])

    return run


def _unhidden(span: int):
    """Pieces (snapshot_id, tok, span, body, segment, gone) without the places in chunks that a later segment hides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                t = b.slice(lo, 2048)
                places, n = _places_in(t.column(3))
                since, gone = np.full((t.num_rows, span), -1, np.int64), t.column(5)
                of = np.repeat(np.arange(t.num_rows), pc.fill_null(pc.list_value_length(gone), 0).to_numpy(zero_copy_only=False))
                flat = gone.flatten()
                since[of, flat.field(0).to_numpy(zero_copy_only=False) % span] = flat.field(1).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(t.num_rows), n)
                live = since[row, places["of"]] <= t.column(4).to_numpy(zero_copy_only=False)[row]
                left = np.bincount(row[live], minlength=t.num_rows)
                out = pa.RecordBatch.from_arrays([*t.columns[:3], _bodies(places[live], np.append(0, np.cumsum(left)))], names=["snapshot_id", "tok", "span", "body"])
                yield out.filter(pa.array(left > 0))

    return run


def _live_pieces(spark: SparkSession, at: State) -> DataFrame:
    """What counts of all blocks, as pieces; the hidden ids come by ranges."""
    packed = _live_blocks(spark, at, None, None).select("snapshot_id", "tok", "span", "hits", "segment").mapInArrow(_packed(SPAN), _PIECE + ", segment int")
    gone = _gone(spark, at).groupBy(F.floor(F.col("chunk_id") / SPAN).alias("span")).agg(F.collect_list(F.struct("chunk_id", "since")).alias("gone"))
    return packed.join(gone, "span", "left").select("snapshot_id", "tok", "span", "body", "segment", "gone").mapInArrow(_unhidden(SPAN), _PIECE)


def _slices(chunks: DataFrame) -> int:
    return 1 + chunks.count() // SLICE_CHUNKS


def build(chunks: DataFrame, path: str) -> None:
    """The index of chunks (chunk_id, snapshot_id, content), in place of any at that path. A null content has no tokens."""
    spark = chunks.sparkSession
    new = max(_numbers(spark, path, "generation"), default=-1) + 1
    _write(_pieces(chunks), f"{path}/generation={new}", 0, chunks.select("chunk_id").limit(0), _slices(chunks))


def apply_changes(path: str, changed: DataFrame, removed: DataFrame | None = None) -> None:
    """Lets an index follow: changed are the chunks that are new or have new content, removed (chunk_id) those that are gone.

    An id stands once among the changed; one that stands among both is changed. Work and files are of the size of the change.
    """
    spark = changed.sparkSession
    at = state(spark, path)
    new = max([*at.segments, *_numbers(spark, f"{at.folder}/postings", "segment")]) + 1
    gone = changed.select("chunk_id")
    _write(_pieces(changed), at.folder, new, gone if removed is None else gone.unionByName(removed.select("chunk_id")), _slices(changed))


def merge(spark: SparkSession, path: str) -> None:
    """All segments as one of a new generation, without what is hidden; older generations go."""
    at = state(spark, path)
    n = SPAN * _live_blocks(spark, at, None, None).select(F.count_distinct("span")).first()[0]
    _write(_live_pieces(spark, at), f"{path}/generation={at.generation + 1}", 0, _gone(spark, at).limit(0), 1 + n // SLICE_CHUNKS)
    for g in _numbers(spark, path, "generation"):
        if g <= at.generation:
            store, p = _store(spark, f"{path}/generation={g}")
            store.delete(p, True)


def _folders(spark: SparkSession, at: State, wanted: list[str]) -> list[str]:
    """The folders of these tokens, in all segments."""
    where = sorted({zlib.crc32(t.encode()) % PARTS for t in wanted})
    return [f for s in at.segments for k in where if _exists(spark, f := f"{at.folder}/postings/segment={s}/part={k}")]


def _bytes(spark: SparkSession, path: str) -> int:
    store, p = _store(spark, path)
    return store.getContentSummary(p).getLength()


def _live_blocks(spark: SparkSession, at: State, wanted: list[str] | None, snapshot_id: int | None) -> DataFrame:
    """The blocks of the wanted tokens; folders of others aren't opened."""
    if wanted is None:
        found = [f"{at.folder}/postings/segment={s}" for s in at.segments]
    else:
        found = _folders(spark, at, wanted)
    if not found:
        return spark.createDataFrame([], _BLOCK)
    own = spark.read.schema(_BLOCK).option("basePath", f"{at.folder}/postings").parquet(*found)
    own = own if wanted is None else own.filter(F.col("tok").isin(*wanted))
    return own if snapshot_id is None else own.filter(F.col("snapshot_id") == snapshot_id)


def _places_of(spark: SparkSession, blocks: DataFrame, at: State) -> DataFrame:
    """snapshot_id, chunk_id, tok, pos that no later segment hides."""
    own = blocks.select("snapshot_id", "tok", "segment", F.explode("hits").alias("h")).select("snapshot_id", "h.chunk_id", "tok", "h.pos", "segment")
    if len(at.segments) == 1:
        return own
    return own.join(_gone(spark, at), "chunk_id", "left").filter("since is null or segment >= since").drop("since")


def _gone(spark: SparkSession, at: State) -> DataFrame:
    """chunk_id, since: the ids that segments hide, with the last one that does."""
    later = [f"{at.folder}/removed/segment={s}" for s in at.segments]
    gone = spark.read.schema("chunk_id long, segment int").option("basePath", f"{at.folder}/removed").parquet(*later)
    return gone.groupBy("chunk_id").agg(F.max("segment").alias("since"))


def _bound(counts: list[Column]) -> Column:
    """The most that a chunk's rank can be, given the most places that each token has in one chunk.

    A rank sums at most 0.1 for each minimal cover, and each cover holds a place of every token. Covers that share a
    place begin at it or before at places of different tokens, as a cover's first token isn't found again in it:
    so no more of them share a place than there are tokens.
    """
    least = F.least(*counts) if len(counts) > 1 else counts[0]
    return F.when(reduce(lambda a, b: a & b, [c.isNotNull() for c in counts]), F.lit(0.1) * len(counts) * least)


@dataclass
class Found:
    """rows: chunk_id, rank, in order; of ranges that hold all tokens, those that were read, None if it wasn't asked."""

    rows: DataFrame
    ranges: int | None
    ranges_read: int | None


def search(spark: SparkSession, path: str, query: str, *, snapshot_id: int | None = None, among: DataFrame | None = None, limit: int = 50, first: int = FIRST, whole: int = WHOLE, short: int = SHORT_BYTES) -> Found:
    """The best chunks that hold every token, as lexical_search() has them; among (chunk_id) limits them before the cut.

    The ranges of ids are looked at by their bounds first, which need no places. The first ones, of the highest
    bounds, give a rank that limit chunks reach; of the rest only those whose bound reaches it are read. Up to
    whole ranges, and files up to short bytes, are read at once. The driver sees LISTED ranges' bounds at most, and
    one rank.
    """
    from sievelight.operators.search import cover_rank, query_tokens

    wanted = query_tokens(query)
    at = state(spark, path)
    empty = spark.createDataFrame([], "chunk_id long, rank double")
    if not wanted:
        return Found(empty, 0, 0)
    blocks = _live_blocks(spark, at, wanted, snapshot_id)

    def ranks(own: DataFrame) -> DataFrame:
        hits = _places_of(spark, own, at).groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("pos", "tok"))).alias("hits"))
        hits = hits if among is None else hits.join(among.select("chunk_id"), "chunk_id", "left_semi")
        return hits.select("chunk_id", cover_rank(F.col("hits"), wanted).alias("rank")).orderBy(F.desc_nulls_last("rank"), "chunk_id").limit(limit).filter("rank is not null")

    if sum(_bytes(spark, f) for f in _folders(spark, at, wanted)) <= short:
        return Found(ranks(blocks), None, None)
    heads = blocks.groupBy("span").agg(*(F.max(F.when(F.col("tok") == t, F.col("most"))).alias(f"m{i}") for i, t in enumerate(wanted)))
    heads = heads.select("span", _bound([F.col(f"m{i}") for i in range(len(wanted))]).alias("bound")).filter("bound is not null")
    best = heads.orderBy(F.desc("bound"), "span").limit(LISTED + 1).collect()
    spans = [r["span"] for r in best]
    listed = lambda own: blocks.filter(F.col("span").isin(*own))  # noqa: E731  reaches the scan
    if len(best) <= max(first, whole):
        return Found(ranks(listed(spans)) if spans else empty, len(spans), len(spans))
    reached = ranks(listed(spans[:first])).agg(F.count("*").alias("n"), F.min("rank").alias("least")).first()
    least = reached["least"] - 1e-8 if reached["n"] == limit else 0.0  # ranks are rounded to nine digits
    worth = [r["span"] for r in best if r["bound"] >= least]
    if len(worth) <= LISTED:
        total = len(best) if len(best) <= LISTED else heads.count()
        return Found(ranks(listed(worth)), total, len(worth))
    total, reach = heads.agg(F.count("*"), F.count_if(F.col("bound") >= least)).first()
    return Found(ranks(blocks.join(heads.filter(F.col("bound") >= least).select("span"), "span", "left_semi")), total, reach)


def search_all(spark: SparkSession, path: str, queries: DataFrame, *, limit: int = 50) -> DataFrame:
    """query_id, chunk_id, rank of the best chunks of every row of queries (query_id, text), at most limit each.

    One job for all of them. A query's rarest token gives its candidates, its next rarest thins them out, and only the
    places that its tokens have in what is left are folded, so common tokens don't multiply with the queries.
    Queries without a token, and null ones, find nothing; query_id is distinct. Ties go to the lower chunk.
    """
    at = state(spark, path)
    words = queries.select("query_id", F.array_distinct(tokens(F.col("text"))).alias("w")).filter(F.size("w") > 0)
    terms = words.select("query_id", F.size("w").alias("m"), F.posexplode("w").alias("t", "tok"))
    blocks = _live_blocks(spark, at, None, None)
    own = blocks.join(terms.select("tok").distinct(), "tok", "left_semi")
    weights = own.groupBy("tok").agg(F.sum(F.size("hits")).alias("n"))
    of = Window.partitionBy("query_id")
    known = terms.join(weights, "tok").withColumn("rank", F.row_number().over(of.orderBy("n", "t"))).withColumn("known", F.count("*").over(of)).filter("known = m")
    holding = lambda k: _places_of(spark, own.join(known.filter(f"rank = {k}").select("tok").distinct(), "tok", "left_semi"), at).select("tok", "chunk_id").distinct()
    found = known.filter("rank = 1").join(holding(1), "tok").select("query_id", "m", "chunk_id")
    second = known.filter("rank = 2").select("query_id", "tok")
    thinned = found.filter("m > 1").join(second, "query_id").join(holding(2), ["tok", "chunk_id"], "left_semi").select("query_id", "m", "chunk_id")
    found = found.filter("m = 1").unionByName(thinned)
    wanted = found.join(known.select("query_id", "t", "tok"), "query_id").withColumn("span", F.floor(F.col("chunk_id") / SPAN))
    there = _places_of(spark, own.join(wanted.select("tok", "span").distinct(), ["tok", "span"], "left_semi"), at)
    hits = wanted.join(there, ["tok", "chunk_id"]).groupBy("query_id", "m", "chunk_id").agg(F.sort_array(F.collect_list(F.struct("pos", "t"))).alias("hits"))
    ranked = hits.select("query_id", "chunk_id", cover_rank_of(F.col("hits"), F.col("m")).alias("rank")).filter("rank is not null")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rank"), "chunk_id"))
    return ranked.withColumn("_place", place).filter(F.col("_place") <= limit).drop("_place")


def cover_rank_of(hits: Column, m: Column) -> Column:
    """The rank by hits (pos, t) in order, t the number of one of m tokens; null unless all are there. As cover_rank(), for any m."""
    none = F.lit(None).cast("int")
    begin = F.struct(F.array_repeat(none, m).alias("p"), F.array_repeat(none, m).alias("j"), F.lit(0).alias("entry"), none.alias("start"), F.lit(0.0).alias("rank"))

    def step(s: Column, x: Column) -> Column:
        entry = s["entry"] + 1
        put = lambda old, new: F.transform(old, lambda v, i: F.when(i == x["t"], new).otherwise(v))
        p, j = put(s["p"], x["pos"]), put(s["j"], entry)
        whole = ~F.exists(p, lambda v: v.isNull())
        start = F.array_min(p)
        moved = whole & (s["start"].isNull() | (s["start"] != start))
        noise = (x["pos"] - start) - (entry - F.array_min(j))
        return F.struct(
            p.alias("p"), j.alias("j"), entry.alias("entry"), F.when(whole, start).otherwise(s["start"]).alias("start"), (s["rank"] + F.when(moved, F.lit(0.1) / (1 + noise)).otherwise(0.0)).alias("rank")
        )

    return F.aggregate(hits, begin, step, lambda s: F.when(s["start"].isNotNull(), F.round(s["rank"], 9)))

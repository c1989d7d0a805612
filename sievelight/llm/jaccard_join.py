"""Operator 10, n-gram Jaccard join with set-relation skipping.

1. Texts become sets of shingles (64-bit numbers); equal sets are one class.
2. Sieve: a set that links with another shares num/den of its shingles at least with it. Every shingle, four
   bytes of it, goes once per batch of texts to the bucket of its value; buckets tell the batches which of
   them others sent too. Sets with fewer such shingles link with nothing.
3. Candidates: the others' shingles are counted in the same way and put in order, rare ones first. Linked
   sets share one of the first |x| - ceil(t|x|) + 1 shingles in any one order. Sets that share one and are
   of near sizes are tied to one of them, a line per shingle and not a pair each; connected components of
   the ties are the groups.
4. Inside a group, index lists are sorted by set size, and the blocks of a list outside a set's size range
   are skipped by position; the overlaps of a set are derived from those of the most similar set already
   done, by the lists of only the shingles in which the two differ. Every overlap is exact.
A group over a bound is dealt as pairs of chunks, so no task holds an unbounded group. Nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sievelight.llm.components import components
from sievelight.llm.packs import cuts, lean, loose, press, runs
from sievelight.llm.scratch import Scratch
from sievelight.llm.shingles import set_key, shingle_batches

#: Shingles that a bucket gets, about, and the bytes of text that give one.
BUCKET_TOKENS, TOKEN_BYTES = 2_000_000, 5
#: Shingles of the sets that are counted together.
PACK_TOKENS = 50_000
#: Sets and shingles of a chunk; a task takes two of them.
GROUP_SETS, GROUP_TOKENS = 600, 400_000
#: Parts of a shingle's list, and of a group, that are joined apart.
SALTS = 64


def overlaps_join(sets: list[np.ndarray], sides: np.ndarray | None, num: int, den: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each set in order of size: (its number, the numbers of the later sets it links with).

    Linked: den * intersection >= num * union. With sides only pairs across them count.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    sizes = np.array([len(sets[i]) for i in order], np.int64)
    m = len(order)
    owner = np.repeat(np.arange(m), sizes)
    _, token, df = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True, return_counts=True)
    keep = df[token] > 1  # a shingle of one set overlaps nothing
    token, owner = token[keep], owner[keep]
    entries = np.sort(token * m + owner)  # the index: list after list, each in order of size
    owners = (entries % m).astype(np.int32)
    own = [np.sort(t) for t in np.split(token, np.searchsorted(owner, np.arange(1, m)))]
    side = None if sides is None else sides[order]
    last = np.searchsorted(sizes * num, sizes * den, side="right")  # larger sets can't link
    rows: dict[int, np.ndarray] = {}
    best, source, waiting = np.zeros(m, np.int32), np.full(m, -1), np.zeros(m, np.int64)

    def count(tokens: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Of each set from lo to hi, how many of these shingles it has; a list is read from lo's block to hi's."""
        if hi <= lo or not len(tokens):
            return np.zeros(max(hi - lo, 0), np.int32)
        start, end = np.searchsorted(entries, tokens * m + lo), np.searchsorted(entries, tokens * m + hi)
        n = end - start
        at = np.arange(int(n.sum())) + np.repeat(start - (np.cumsum(n) - n), n)
        return np.bincount(owners[at] - lo, minlength=hi - lo).astype(np.int32)

    def release(of: np.ndarray) -> None:
        np.subtract.at(waiting, of, 1)
        for k in np.unique(of[waiting[of] == 0]).tolist():
            del rows[k]

    for x in range(m):
        lo, hi, y = x + 1, int(last[x]), int(source[x])
        if y >= 0 and len(own[x]) + len(own[y]) - 2 * best[x] < len(own[x]):
            known = min(int(last[y]), hi)  # rows[y] begins at y + 1
            gone, more = np.setdiff1d(own[y], own[x], assume_unique=True), np.setdiff1d(own[x], own[y], assume_unique=True)
            row = rows[y][lo - y - 1 : known - y - 1] + count(more, lo, known) - count(gone, lo, known)
            row = np.concatenate([row, count(own[x], max(lo, known), hi)])
        else:
            row = count(own[x], lo, hi)
        if y >= 0:
            release(np.array([y]))
        later = np.flatnonzero(row > best[lo:hi]) + lo
        if len(later):  # they may derive theirs from this one
            old = source[later]
            rows[x], best[later], source[later], waiting[x] = row, row[later - lo], x, len(later)
            release(old[old >= 0])
        hit = np.flatnonzero(den * row.astype(np.int64) >= num * (sizes[lo:hi] + sizes[x] - row)) + lo
        if side is not None:
            hit = hit[side[hit] != side[x]]
        yield int(order[x]), order[hit]


def _low(tokens: np.ndarray) -> bytes:
    return tokens.astype(np.uint32).tobytes()


_SENT = "bucket int, pack long, counts binary, ones binary, more binary, ids array<{kind}>, text_hash array<long>, keys binary, sizes array<long>, set array<int>, shared array<int>"
_TOLD = "pack long, told binary, ids array<{kind}>, text_hash array<long>, keys binary, sizes array<long>, set array<int>, shared array<int>"


def _send(width: int, buckets: int, kind: pa.DataType):
    """(id, text_hash, text) to a row about the texts of a batch, and one for each bucket its shingles fall in.

    Shingles of two sets of the batch are told apart (more); of the others (ones) counts says how many
    each set has, set after set.
    """
    names = [c.split()[0] for c in _SENT.split(", ")]
    types = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(kind), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = TaskContext.get().partitionId() << 32
        for b in batches:
            for lo, hi, sizes, flat in shingle_batches(b.column(2), width):
                ends = np.cumsum(sizes)
                keys = [set_key(flat[e - n : e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                number: dict[bytes, int] = {}
                own = np.array([number.setdefault(k, len(number)) if n else -1 for k, n in zip(keys, sizes.tolist(), strict=True)], np.int64)
                first = np.zeros(len(own), bool)
                first[np.unique(own, return_index=True)[1]] = True
                first &= own >= 0
                m = len(number)
                token, owner = flat[np.repeat(first, sizes)], np.repeat(own[first], sizes[first])
                by = np.argsort(token, kind="stable")
                token, owner = token[by], owner[by]
                begin = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
                lengths = np.diff(np.append(begin, len(token)))
                alone = np.repeat(lengths == 1, lengths)
                shared = np.bincount(owner[~alone], minlength=m)
                one, of, more = token[alone], owner[alone], token[begin[lengths > 1]]
                at, at_more = cuts(one, buckets), cuts(more, buckets)
                out: list[tuple] = []
                for k in range(buckets):
                    a, e, a2, e2 = at[k], at[k + 1], at_more[k], at_more[k + 1]
                    if e > a or e2 > a2:
                        by = np.argsort(of[a:e], kind="stable")
                        out.append((k, pack, press(np.bincount(of[a:e], minlength=m)), _low(one[a:e][by]), _low(more[a2:e2]), *[None] * 6))
                out.append((pack % buckets, pack, None, None, None, b.column(0).slice(lo, hi - lo).to_pylist(), b.column(1).slice(lo, hi - lo).to_pylist(), b"".join(keys), sizes, own, shared))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                pack += 1

    return run


def _tell(kind: pa.DataType):
    """Rows of _send() by bucket to what each batch is told: the shingles of each of its sets that other batches have. The rows about texts go through."""
    names = [c.split()[0] for c in _TOLD.split(", ")]
    types = [pa.int64(), pa.binary(), pa.list_(kind), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches):
            out = [(r[1], None, *r[5:]) for r in rows if r[2] is None]
            rows = [r for r in rows if r[2] is not None]
            if rows:
                every = np.sort(np.concatenate([np.frombuffer(x, np.uint32) for r in rows for x in r[3:5]]))
                twice = np.unique(every[1:][every[1:] == every[:-1]])
                for r in rows if len(twice) else []:
                    ones, counts = np.frombuffer(r[3], np.uint32), loose(r[2])
                    met = twice[np.minimum(np.searchsorted(twice, ones), len(twice) - 1)] == ones
                    if met.any():
                        out.append((r[1], press(np.bincount(np.repeat(np.arange(len(counts)), counts), met, len(counts))), *[None] * 6))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return run


def _hear(kind: pa.DataType):
    """Rows of _tell() by batch to (id, text_hash, set_key, n, shared), a row per text."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches):
            _, _, ids, hashes, keys, sizes, own, shared = next(r for r in rows if r[1] is None)
            total = np.array(shared, np.int64)
            for r in rows:
                if r[1] is not None:
                    total += loose(r[1])
            own = np.array(own, np.int64)
            met = np.where(own >= 0, np.append(total, 0)[own], 0)
            keys = [keys[i : i + 16] for i in range(0, len(keys), 16)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(hashes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(met)], names=["id", "text_hash", "set_key", "n", "shared"])

    return run


def _packs(width: int):
    """(want, text) to packs of the sets wanted: (pack, keys, sizes, tokens)."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, held, n = TaskContext.get().partitionId() << 32, [], 0

        def out() -> pa.RecordBatch:
            keys, sizes = b"".join(k for k, _ in held), [len(s) for _, s in held]
            return pa.RecordBatch.from_arrays(
                [pa.array([pack]), pa.array([keys], pa.binary()), pa.array([sizes], pa.list_(pa.int64())), pa.array([np.concatenate([s for _, s in held]).tobytes()], pa.binary())],
                names=["pack", "keys", "sizes", "tokens"],
            )

        for b in batches:
            want = b.column(0).to_pylist()
            for lo, _, sizes, flat in shingle_batches(b.column(1), width):
                for i, (e, size) in enumerate(zip(np.cumsum(sizes).tolist(), sizes.tolist(), strict=True), lo):
                    s = flat[e - size : e]
                    if size and set_key(s) == want[i]:
                        held.append((want[i], s))
                        n += size
                        if n >= PACK_TOKENS:
                            yield out()
                            pack, held, n = pack + 1, [], 0
        if held:
            yield out()

    return run


def _send_counts(buckets: int):
    """(pack, tokens) to a row for each bucket: the pack's distinct shingles there, and in how many of its sets each is."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pack, tokens in zip(b.column(0).to_pylist(), (x.as_py() for x in b.column(1)), strict=True):
                token, n = np.unique(np.frombuffer(tokens, np.uint64), return_counts=True)
                at = cuts(token, buckets)
                used = [k for k in range(buckets) if at[k + 1] > at[k]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used, pa.int32()), pa.array([pack] * len(used), pa.int64()), pa.array([_low(token[at[k] : at[k + 1]]) for k in used], pa.binary()), pa.array([press(n[at[k] : at[k + 1]]) for k in used], pa.binary())],
                    names=["bucket", "pack", "low", "n"],
                )

    return run


@lean
def _tell_ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _send_counts() by bucket to (pack, bucket, ranks): eight times the logarithm of the number of sets, 0 for one set."""
    for rows in runs(batches):
        every = np.concatenate([np.frombuffer(r[2], np.uint32) for r in rows])
        low, at = np.unique(every, return_inverse=True)
        n = np.bincount(at, np.concatenate([loose(r[3]) for r in rows]), len(low))
        rank = np.ceil(np.minimum(8 * np.log2(n), 255)).astype(np.uint8)[at]
        told, a = [], 0
        for r in rows:
            told.append(press(rank[a : a + len(r[2]) // 4], "u1"))
            a += len(r[2]) // 4
        yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array(told, pa.binary())], names=["pack", "bucket", "ranks"])


def _fronts(num: int, den: int):
    """Rows (pack, bucket, ranks, keys, sizes, tokens) by pack to (set_key, n, front, tokens) of the sets that may link.

    front: those of a set's first shingles, rare ones first, that other sets have.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches):
            _, _, _, keys, sizes, tokens = next(r for r in rows if r[2] is None)
            flat = np.frombuffer(tokens, np.uint64)
            token, at = np.unique(flat, return_inverse=True)
            rank = np.concatenate([loose(r[2], "u1") for r in rows if r[2] is not None])[at]
            out: list[tuple] = []
            for i, (e, n) in enumerate(zip(np.cumsum(sizes).tolist(), sizes, strict=True)):
                s, r = flat[e - n : e], rank[e - n : e]
                if den * np.count_nonzero(r) >= num * n:
                    first = np.argsort(r, kind="stable")[: n - -(-num * n // den) + 1]
                    front = s[first[r[first] > 0]]
                    if len(front):
                        out.append((keys[16 * i : 16 * i + 16], n, front.view(np.int64), s.tobytes()))
            if out:
                types = [pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["set_key", "n", "front", "tokens"])

    return run


def _verify(num: int, den: int):
    """Sorted rows (grp, left, right, chunk, set_key, copies, tokens) to (set_key, root, links)."""

    def group(rows: list[tuple]) -> Iterator[tuple]:
        sets = [np.frombuffer(r[6], np.uint64) for r in rows]
        copies = np.array([r[5] for r in rows])
        sides = None if rows[0][1] == rows[0][2] else np.array([r[3] for r in rows])
        root, links = list(range(len(rows))), np.zeros(len(rows), np.int64)

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        for x, hits in overlaps_join(sets, sides, num, den):
            if len(hits):
                links[x] += copies[hits].sum()
                links[hits] += copies[x]
                for y in hits:
                    a, b = find(x), find(int(y))
                    if a != b:
                        root[max(a, b)] = min(a, b)
        for i, r in enumerate(rows):
            if links[i]:
                yield r[4], rows[find(i)][4], int(links[i])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []

        def out() -> pa.RecordBatch:
            cols = list(zip(*done, strict=True)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int64())], names=["set_key", "root", "links"])

        for rows in runs(batches, 3):
            if len(rows) > 1:
                done += group(rows)
            if len(done) > 10_000:
                yield out()
                done = []
        yield out()

    return run


def _ties(fronts: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) between sets (rid) that share a shingle of their fronts and whose sizes are in one class or in neighbouring ones."""
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num)) + F.lit(1e-9)).cast("int")
    posts = fronts.select(F.explode("front").alias("t"), "rid", size_class.alias("c"), F.pmod("rid", F.lit(SALTS)).cast("int").alias("salt"))
    some = posts.groupBy("t", "c", "salt").agg(F.min("rid").alias("head"), F.max("rid").alias("other"))
    heads = some.groupBy("t", "c").agg(F.min("head").alias("first"), F.max("head").alias("last"))
    own = posts.join(some.filter("head <> other").drop("other"), ["t", "c", "salt"]).select(F.col("rid").alias("a"), F.col("head").alias("b"))
    across = some.join(heads.filter("first <> last"), ["t", "c"]).select(F.col("head").alias("a"), F.col("first").alias("b"))
    near = heads.select("t", (F.col("c") + 1).alias("c"), F.col("first").alias("before")).join(heads, ["t", "c"]).select(F.col("before").alias("a"), F.col("first").alias("b"))
    return own.union(across).union(near).filter("a <> b").distinct()


def jaccard_join(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per row of df: id, n_shingles, component_id, n_links, group_key, text_hash.

    Documents link when den * intersection >= num * union of their sets of width-word shingles (A-Z in lower
    case). component_id is the smallest id reachable by links, itself included; n_links the number of other
    rows linked directly; group_key names the component (null for the empty set) and text_hash is xxhash64 of
    the text, so that a caller can pick one row of each component. A null or wordless text has the empty set and links with nothing. Repeated rows are
    copies of each other; a null id takes part and is never a smallest id; ties have no part, as all
    links count. An empty table gives an empty result; other columns aren't read.
    A table of sets' whole shingles is made only for those that pass the sieve.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "jaccard")
    kind = df.schema[id_col].dataType.simpleString()
    docs = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"))
    arrow = to_arrow_type(df.schema[id_col].dataType)
    volume = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 + volume // (TOKEN_BYTES * BUCKET_TOKENS)
    sent = docs.select("id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(_send(width, buckets, arrow), _SENT.format(kind=kind))
    told = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_tell(arrow), _TOLD.format(kind=kind))
    heard = told.repartition("pack").sortWithinPartitions("pack").mapInArrow(_hear(arrow), f"id {kind}, text_hash long, set_key binary, n long, shared long")
    found = scratch.table(heard, "found")

    rid = F.conv(F.substring(F.hex("set_key"), 1, 15), 16, 10).cast("long")  # 60 bits of the key
    classes = found.filter("n > 0").groupBy("set_key").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.min("n").alias("n"), F.max("shared").alias("shared"))
    classes = scratch.table(classes, "classes")
    open_ = classes.filter(F.col("shared") * den >= F.col("n") * num)
    wanted = open_.select("rep", F.col("set_key").alias("want")).hint("merge")
    text = docs.join(wanted, wanted["rep"].eqNullSafe(docs["id"])).select("want", "text")
    packs = scratch.table(text.mapInArrow(_packs(width), "pack long, keys binary, sizes array<long>, tokens binary"), "packs")

    volume = packs.agg(F.sum(F.octet_length("tokens"))).first()[0] or 0
    buckets = 1 + volume // (8 * BUCKET_TOKENS)
    counted = packs.select("pack", "tokens").mapInArrow(_send_counts(buckets), "bucket int, pack long, low binary, n binary")
    ranked = counted.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_tell_ranks, "pack long, bucket int, ranks binary")
    both = packs.withColumn("bucket", F.lit(-1)).withColumn("ranks", F.lit(None).cast("binary")).unionByName(ranked, allowMissingColumns=True)
    both = both.select("pack", "bucket", "ranks", "keys", "sizes", "tokens").repartition("pack").sortWithinPartitions("pack", "bucket")
    fronts = both.mapInArrow(_fronts(num, den), "set_key binary, n long, front array<long>, tokens binary")
    if found.groupBy("id").count().filter("count > 1").limit(1).count():  # an id in several rows may give its set as often
        fronts = fronts.dropDuplicates(["set_key"])
    sets = scratch.table(fronts, "sets").withColumn("rid", rid)
    scratch.drop("packs")
    groups = scratch.table(components(_ties(sets, num, den), scratch), "groups")

    # groups of bounded size; k chunks for larger ones
    member = sets.select("set_key", "rid", "n", "tokens").join(groups, F.col("rid") == F.col("node")).select("set_key", "n", "tokens", F.col("component").alias("grp"))
    member = scratch.table(member, "members")
    k = F.greatest(F.ceil(F.count("*") / GROUP_SETS), F.ceil(F.sum("n") / GROUP_TOKENS)).cast("int")
    large = member.groupBy("grp").agg(k.alias("k")).filter("k > 1")
    large = scratch.table(large.select("grp", "k", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")), "large")
    dealt = member.join(classes.select("set_key", "copies"), "set_key").withColumn("salt", F.pmod(F.xxhash64("set_key"), F.lit(SALTS)).cast("int"))
    dealt = dealt.join(large, ["grp", "salt"], "left").withColumn("k", F.coalesce("k", F.lit(1)))
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64(F.lit(1), "set_key"), F.col("k")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = dealt.select("grp", F.least("chunk", "other").alias("left"), F.greatest("chunk", "other").alias("right"), "chunk", "set_key", "copies", "tokens")
    dealt = dealt.repartition("grp", "left", "right").sortWithinPartitions("grp", "left", "right", "set_key")
    linked = scratch.table(dealt.mapInArrow(_verify(num, den), "set_key binary, root binary, links long"), "linked")
    scratch.drop("sets", "groups", "members", "large")

    total = linked.groupBy("set_key").agg(F.sum("links").alias("links"))
    joined = components(linked.select(F.col("set_key").alias("a"), F.col("root").alias("b")), scratch, "linked-by")
    label = classes.select("set_key", "rep", "copies").join(joined.select(F.col("node").alias("set_key"), F.col("component").alias("root")), "set_key", "left").withColumn("root", F.coalesce("root", "set_key"))
    least = label.groupBy("root").agg(F.min("rep").alias("component_id"))
    label = label.join(least, "root").join(total, "set_key", "left").select("set_key", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "root")
    out = found.select("id", "n", "set_key", "text_hash").join(label, "set_key", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("root").alias("group_key"), "text_hash")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, num=90, den=100)
    return joined.select("doc_id", "n_shingles", "component_id", "n_links")

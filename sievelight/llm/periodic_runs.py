"""Operator 11, periodic run detection: stretches of words that repeat with a period.

A run of period q and length 4q or more has 3q places or more where a word equals the one q further on, so
one of the places 0, 3q, 6q, ... is among them: a harmonic grid, n/3q places for each period. For all (period,
place) pairs of a batch of texts whose words are equal, the extension of the equality to both sides is found
by binary search over prefix hashes, for all pairs at once. Words are then compared themselves, so a result
never rests on a hash, and pairs that met the same run are one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.llm.bpe import byte_batches
from sievelight.llm.packs import lean

#: Bytes of texts in a batch, and pairs looked at together.
BATCH_BYTES, PAIRS = 1 << 20, 1 << 19
#: A run has at least so many words, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
WHITE = " \t\n\x0b\x0c\r"
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Prefixes:
    """Prefix hashes of word codes: equal stretches have equal differences, once moved to the same power."""

    def __init__(self, codes: np.ndarray):
        self.power = np.cumprod(np.full(len(codes) + 1, _BASE)) * np.uint64(0xF1357AEA2E62A9C5)  # odd, wraps
        self.shift = np.concatenate(([np.uint64(1)], np.cumprod(np.full(len(codes), _BASE))))
        h = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
        self.sums = np.concatenate(([np.uint64(0)], np.cumsum(h * self.power[:-1])))

    def equal(self, i: np.ndarray, p: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n words from i on have the hash of those from i + p on."""
        return (self.sums[i + n] - self.sums[i]) * self.shift[p] == self.sums[i + p + n] - self.sums[i + p]

    def reach(self, i: np.ndarray, p: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How many words from i on (back: before i) equal those p further on, at most most; all pairs at once."""
        lo, hi = np.zeros_like(most), most.copy()
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_] + 1) // 2
            at = i[open_]
            same = self.equal(at - mid if back else at, p[open_], mid)
            lo[open_], hi[open_] = np.where(same, mid, lo[open_]), np.where(same, hi[open_], mid - 1)
        return lo


def _grid(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(place, period, begin of text, end of text) of all pairs, some PAIRS at a time."""
    stride = LEAST_PERIODS - 1
    periods = sizes // LEAST_PERIODS
    text = np.repeat(np.arange(len(sizes)), periods)
    period = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    points = -(-(sizes[text] - period) // (stride * period))  # places below size - period
    ends = np.cumsum(points)
    lo = 0
    while lo < len(text):
        before = int(ends[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, before + PAIRS, "right")))
        n = points[lo:hi]
        of = np.repeat(np.arange(lo, hi), n)
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        p = period[of]
        begin = starts[text[of]]
        yield begin + k * (stride * p), p, begin, begin + sizes[text[of]]
        lo = hi


def _stretch(codes: np.ndarray, i: int, p: int, begin: int, end: int) -> tuple[int, int]:
    """The stretch around i where words p apart are equal, word by word."""
    a = b = i
    while a > begin and codes[a - 1] == codes[a - 1 + p]:
        a -= 1
    while b + p < end and codes[b] == codes[b + p]:
        b += 1
    return a, b + p


def runs_of(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Runs (place of the first word, length, period) in texts that lie one after another, by place, then period."""
    hashes = Prefixes(codes)
    found = []
    for i, p, begin, end in _grid(starts, sizes):
        keep = codes[i] == codes[i + p]
        i, p, begin, end = i[keep], p[keep], begin[keep], end[keep]
        # a run has three equal places or more, so one beside this
        after, before = np.minimum(i + 1, end - p - 1), np.maximum(i - 1, begin)
        keep = ((after > i) & (codes[after] == codes[after + p])) | ((before < i) & (codes[before] == codes[before + p]))
        i, p, begin, end = i[keep], p[keep], begin[keep], end[keep]
        a = i - hashes.reach(i, p, i - begin, True)
        b = i + p + hashes.reach(i, p, end - i - p, False)
        keep = b - a >= np.maximum(LEAST_WORDS, LEAST_PERIODS * p)
        found.append(np.stack([a, b, p, i, begin, end])[:, keep])
    pairs = np.concatenate(found, axis=1) if found else np.zeros((6, 0), np.int64)
    pairs = pairs[:, np.lexsort((pairs[2], pairs[1], pairs[0]))]
    out: dict[tuple[int, int], int] = {}
    last = None
    for a, b, p, i, begin, end in pairs.T.tolist():
        if last == (a, b) and p % out[last] == 0:
            continue  # a multiple of a period that was compared word by word
        if not (codes[a : b - p] == codes[a + p : b]).all():  # two stretches share a hash
            a, b = _stretch(codes, i, p, begin, end)
            if b - a < max(LEAST_WORDS, LEAST_PERIODS * p):
                continue
        if p < out.get((a, b), p + 1):
            out[a, b] = p
        last = (a, b)
    return np.array([(a, b - a, p) for (a, b), p in sorted(out.items(), key=lambda r: (r[0][0], r[1]))], np.int64).reshape(-1, 3)


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = pc.fill_null(b.column(1).cast(pa.string()), "")
        for lo, hi in byte_batches(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64), BATCH_BYTES):
            part = texts.slice(lo, hi - lo)
            lists = pc.split_pattern_regex(pc.ascii_trim_whitespace(part), r"[\x20\x09-\x0D]+")
            words = lists.flatten()
            sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            hole = pc.equal(words, "").to_numpy(zero_copy_only=False)  # texts without a word have one empty piece
            sizes -= np.add.reduceat(hole.astype(np.int64), np.cumsum(sizes) - sizes)
            words = words.filter(pa.array(~hole))
            coded = words.dictionary_encode()
            codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            starts = ends - sizes
            runs = runs_of(codes, starts, sizes)

            marks = np.zeros(len(codes) + 1, np.int64)  # words after the first period of a run go
            np.add.at(marks, runs[:, 0] + runs[:, 2], 1)
            np.add.at(marks, runs[:, 0] + runs[:, 1], -1)
            kept = np.cumsum(marks[:-1]) == 0
            left = np.concatenate(([0], np.cumsum(kept)))[np.concatenate(([0], ends))]
            kept_words = pa.ListArray.from_arrays(pa.array(left, pa.int32()), words.filter(pa.array(kept)))
            text = np.searchsorted(ends, runs[:, 0], "right")
            offsets = pa.array(np.searchsorted(text, np.arange(len(sizes) + 1)), pa.int32())
            fields = [pa.array(runs[:, 0] - starts[text] if len(runs) else runs[:, 0]), pa.array(runs[:, 1]), pa.array(runs[:, 2])]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).slice(lo, hi - lo),
                    pa.array(sizes),
                    pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, ["start", "length", "period"])),
                    pc.binary_join(kept_words, " "),
                ],
                names=["id", "n_words", "runs", "collapsed"],
            )


def periodic_runs(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id, n_words, runs (start, length, period; by start, then period), collapsed.

    collapsed is the text's words without those that any run holds after its first period, joined by one space.
    A null text has no words, no runs and an empty collapsed text, like an empty one. Repeated rows and null ids are
    rows like others; an empty table gives none; other columns aren't read. Each text is looked at whole, however
    long, and by itself: nothing is shuffled.
    """
    own = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text"))
    kind = dict(own.dtypes)["id"]
    out = own.mapInArrow(lean(_found), f"id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    return out.withColumnRenamed("id", id_col)


def planted(id_: Column, text: Column) -> Column:
    """The text, or for one id in ten its words with a period from some word on, as the contract of op11 has it."""
    h = F.crc32(id_.cast("string").cast("binary"))
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    words = F.split(trimmed, r"[\x20\x09-\x0D]+")
    n, g = F.size(words), F.floor(h / 10).cast("long")
    a = (g % n).cast("int")
    p = 1 + F.floor((n - a) / (3 + g % 8)).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    odd = F.concat(F.slice(words, F.lit(1), a), F.slice(again, F.lit(1), n - a))
    return F.when((h % 10 == 0) & (trimmed != ""), F.array_join(odd, " ")).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of all documents, some of them with planted ones; digests of the runs and of the collapsed text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = periodic_runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text")))
    # greatest length first; ties by start, then period
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period"))))
    told = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.n")).alias("length"), F.col("best.period").alias("period"),
        F.floor(-1000 * F.col("best.n") / F.col("best.period")).cast("long").alias("exponent_milli"), F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

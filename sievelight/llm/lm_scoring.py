"""Operator 7, LM scoring: online logistic context mixing over binary decisions.

A text is its words (A-Z in lower case) and one end. The first decision of a token is whether it is the one that
most often followed its two predecessors in the training texts; contexts are hashed and know nothing of word
borders in the text before. Predictors of this bit are what the context has seen, how many tokens before were
foretold, and the plain share; they are mixed in the logistic domain by weights that a gate selects, learned
online, and refined by what was seen of each case. A token that isn't foretold is known to the training texts, or
is spelled, byte by byte and bit by bit, by hashed tables of the last one to four bytes, mixed and refined in the
same way. A known one is spelled by the bits of its hash, as a path in a tree of all known words: the first six,
its class, are mixed from the shares among all words, after the class before and after the two classes before; the
others from the shares of training tokens and of distinct words. A training token is taken out of the counts of its context where it is itself decided, in learning and
in scoring, so that a text isn't foretold by itself, but by its copies.

Words and contexts grow with the corpus and stay distributed: packs of texts send them, four to eight bytes each,
to buckets, and get counts in return. Tables of bytes, weights and cases have fixed sizes. Buckets depend on the
amount of text only, and sums are added in their order, so scores don't depend on partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.llm.packs import cuts, lean, loose, pack_rows, press, runs, unpack
from sievelight.llm.scratch import Scratch
from sievelight.llm.shingles import words_of

#: Bytes of texts of a pack, and of texts whose words and contexts share a bucket.
PACK_BYTES, BUCKET_BYTES = 4 << 20, 8 << 20
#: Bits of the slots of the tables of the last one to four bytes.
TABLE_BITS = (16, 18, 18, 18)
#: Numbers in one block of a vector that tasks add up.
VECTOR_BLOCK = 16384
#: Bytes of words that are looked up together, and those between which the weights of spelling move; the rate, the
#: buckets of the adaptive map, and the curvature with which the first weights are held. Every word met once
#: teaches spelling.
PART_BYTES, STEP_BYTES, RATE, BUCKETS, FIRM = 100_000, 5_000, 0.5, 33, 20.0
GATES, INPUTS = 8 * 4 * 4, 5
#: What a context has seen: bounds of its tokens, and parts of the share of the favourite; runs of foretold tokens.
SEEN, SHARES, RUNS = np.array([1, 2, 3, 4, 8, 16, 64]), 5, np.array([1, 2, 4, 8, 16])
STATES = 1 + len(SEEN) * SHARES
#: Bits of a hash that are a word's class, and those whose counts the driver knows; bits beyond belong to one bucket.
CLASS_BITS, PREFIX_BITS = 6, 16
CLASSES, PREFIXES = 1 << CLASS_BITS, 1 << PREFIX_BITS
#: What is added to both counts of a word's bit, of which none is 0.
SMALL = 0.05
END = xxhash.xxh3_64_intdigest(b"") >> (64 - CLASS_BITS)
_OFFSETS = np.concatenate([[0], np.cumsum([1 << b for b in TABLE_BITS])])
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


# -- spelling


def _spelt(words: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(all bytes of the words and their closing spaces, the last one to four bytes before each, where words begin); 0 before a word."""
    flat = np.frombuffer(b" ".join([*words, b""]), np.uint8).astype(np.int64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    start = np.cumsum(size) - size
    place = np.arange(len(flat)) - np.repeat(start, size)
    last = []
    for k in (1, 2, 3, 4):
        before = np.concatenate([np.zeros(min(k, len(flat)), np.int64), flat[:-k]])
        last.append(np.where(place >= k, before, 0))
    return flat, last, start


def _slots(last: list[np.ndarray], node: np.ndarray) -> list[np.ndarray]:
    """Slots of the tables, one after another, for the last bytes and the node of the present byte's bits."""
    key, out = node.astype(np.uint64), []
    for t, byte in enumerate(last):
        key = key | (byte.astype(np.uint64) << np.uint64(8 + 8 * t))
        at = key if t == 0 else ((key + np.uint64(t << 48)) * _MIX) >> np.uint64(64 - TABLE_BITS[t])
        out.append(at.astype(np.int64) + _OFFSETS[t])
    return out


def _bits(words: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]]:
    """(bit number, bits, last byte, slots, where words begin) of each bit of all bytes."""
    flat, last, start = _spelt(words)
    for k in range(8):
        node, bit = (1 << k) | (flat >> (8 - k)), (flat >> (7 - k)) & 1
        yield k, bit, last[0], _slots(last, node), start


def _parts(words: list[bytes], size: int) -> Iterator[list[bytes]]:
    """The words, about size bytes at a time."""
    ends = np.cumsum([len(w) + 1 for w in words])
    edges = np.searchsorted(ends, np.arange(0, (ends[-1] if len(ends) else 0) + size, size))
    for a, e in zip(edges, edges[1:], strict=False):
        if e > a:
            yield words[a:e]


def count_tables(words: list[bytes]) -> np.ndarray:
    """(2, slots): how often each bit followed, over distinct training words."""
    out = np.zeros((2, _OFFSETS[-1]))
    for part in _parts(words, PART_BYTES):
        for _, bit, _, slots, _ in _bits(part):
            for slot in slots:
                for v in (0, 1):
                    at, n = np.unique(slot[bit == v], return_counts=True)
                    out[v, at] += n
    return out


def _inputs(tables: np.ndarray, k: int, bit: np.ndarray, slots: list[np.ndarray], own: float) -> tuple[np.ndarray, np.ndarray]:
    """(inputs of the mixer, gates); own: 1 where the word is itself in the tables and is taken out."""
    out, seen = np.empty((len(bit), INPUTS)), []
    for t, slot in enumerate(slots):
        a, b = np.maximum(tables[0, slot] - own * (1 - bit), 0), np.maximum(tables[1, slot] - own * bit, 0)
        seen.append(a + b)
        out[:, t] = _stretch((b + 0.1) / (a + b + 0.2))
    out[:, 4] = 0.3
    return out, (k * 4 + np.searchsorted([0.5, 3.5, 31.5], seen[3])) * 4 + np.searchsorted([0.5, 3.5, 31.5], seen[2])


def start_weights() -> np.ndarray:
    """Weights before learning: longer contexts count for more where they have been seen."""
    w = np.zeros((GATES, INPUTS))
    four, three = np.arange(GATES) // 4 % 4, np.arange(GATES) % 4
    w[:, 0], w[:, 1] = 0.1, 0.3
    w[:, 2], w[:, 3] = np.array([0.0, 0.3, 0.5, 0.6])[three], np.array([0.0, 0.2, 0.4, 0.6])[four]
    return w


def _bucket(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(_stretch(np.clip(p, 1e-7, 1 - 1e-7)) * 2 + BUCKETS // 2), 0, BUCKETS - 1).astype(np.int64)


def learn(words: list[bytes], tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights, adaptive map as (2, 256 * BUCKETS) counts of bits and of ones) after these training words, by online steps.

    A step is the slope over the curvature met so far, so weights settle as words go by; each is left out of the tables.
    """
    w, seen, bend = start_weights(), np.zeros((2, 256 * BUCKETS)), np.full((GATES, INPUTS), FIRM)
    for part in _parts(words, STEP_BYTES):
        for k, bit, last, slots, _ in _bits(part):
            x, gate = _inputs(tables, k, bit, slots, 1.0)
            q = _squash((w[gate] * x).sum(axis=1))
            err, curve = bit - q, q * (1 - q)
            for i in range(INPUTS):
                bend[:, i] += np.bincount(gate, curve * x[:, i] ** 2, GATES)
                w[:, i] += RATE * np.bincount(gate, err * x[:, i], GATES) / bend[:, i]
            at = last * BUCKETS + _bucket(q)
            seen[0] += np.bincount(at, minlength=256 * BUCKETS)
            seen[1] += np.bincount(at, bit, 256 * BUCKETS)
    return w, seen


def refinement(seen: np.ndarray) -> np.ndarray:
    """The adaptive map: what was seen in a bucket, drawn to the bucket's own middle where little was."""
    middle = _squash((np.arange(BUCKETS) - BUCKETS // 2) / 2)
    return (seen[1] + 20 * np.tile(middle, 256)) / (seen[0] + 20)


def bit_probabilities(part: list[bytes], tables: np.ndarray, w: np.ndarray, refine: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bits, probability of a one, where words begin) of each bit of all bytes of the words, none of which the tables hold."""
    for k, bit, last, slots, start in _bits(part):
        x, gate = _inputs(tables, k, bit, slots, 0.0)
        p = _squash((w[gate] * x).sum(axis=1))
        yield bit, np.clip((3 * p + refine[last * BUCKETS + _bucket(p)]) / 4, 1e-7, 1 - 1e-7), start


def spell(words: list[bytes], tables: np.ndarray, w: np.ndarray, refine: np.ndarray) -> np.ndarray:
    """log10 probability of each word, spelled."""
    out = []
    for part in _parts(words, PART_BYTES):
        total = 0.0
        for bit, p, start in bit_probabilities(part, tables, w, refine):
            total = total + np.add.reduceat(np.log10(np.where(bit == 1, p, 1 - p)), start)
        out.append(total)
    return np.concatenate(out) if out else np.zeros(0)


# -- known words


def _share(one: np.ndarray, n: np.ndarray, more: float = 0.4) -> np.ndarray:
    n = np.maximum(n, 0)
    return _stretch((np.clip(one, 0, n) + more) / (n + 2 * more))


def _gate(n: np.ndarray) -> np.ndarray:
    return np.searchsorted(SEEN, n, side="right")


def _learn_bits(w: np.ndarray, bend: np.ndarray, x: np.ndarray, gate: np.ndarray, bit: int, times: np.ndarray) -> None:
    """An online step of the weights for decisions (inputs in the last axis) that were bit so many times."""
    x, gate, times = x.reshape(-1, x.shape[-1]), gate.ravel(), times.ravel()
    q = _squash((w[gate] * x).sum(axis=1))
    for i in range(x.shape[1]):
        bend[:, i] += np.bincount(gate, q * (1 - q) * times * x[:, i] ** 2, len(w))
        w[:, i] += RATE * np.bincount(gate, (bit - q) * times * x[:, i], len(w)) / bend[:, i]


def _log_bit(w: np.ndarray, x: np.ndarray, gate: np.ndarray, bit) -> np.ndarray:
    p = np.clip(_squash((w[gate] * x).sum(axis=-1)), 1e-7, 1 - 1e-7)
    return np.log10(np.where(bit == 1, p, 1 - p))


def path(h: np.ndarray, c: np.ndarray, again: np.ndarray, types: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """log10 probabilities of the bits from begin on, of items in order of their hash, and those without one of the item's own tokens.

    A bit that all items below a node share is no decision. The two shares are mixed by weights that the node's count
    selects, learned level after level from the tokens of words that came again; each is left out where it is learned.
    """
    levels = []
    for level in range(begin, end):
        node, bit = h >> np.uint64(64 - level), ((h >> np.uint64(63 - level)) & np.uint64(1)).astype(np.int64)
        start = np.flatnonzero(np.append(True, node[1:] != node[:-1]))[: len(h)]
        if len(start) == len(h):
            break
        n, n1, t, t1, m, m1 = (np.add.reduceat(v, start) for v in (c, c * bit, types, types * bit, again, again * bit))
        both = (t1 > 0) & (t1 < t)
        at = np.repeat(np.where(both, np.cumsum(both) - 1, -1), np.diff(np.append(start, len(h))))
        levels.append((at, bit, n[both], n1[both], _share(t1[both], t[both], SMALL), m[both], m1[both]))
    w = np.repeat(np.minimum(1, 0.5 + 0.08 * np.arange(len(SEEN) + 1))[:, None], 2, axis=1)
    w[:, 1] = 1 - w[:, 0]
    bend = np.full_like(w, FIRM)
    for _, _, n, n1, kinds, m, m1 in levels:
        for b, times in ((1, m1), (0, m - m1)):
            _learn_bits(w, bend, np.stack([_share(n1 - b, n - 1, SMALL), kinds], axis=-1), _gate(n - 1), b, times)
    full, without = np.zeros(len(h)), np.zeros(len(h))
    for at, bit, n, n1, kinds, _, _ in levels:
        i = np.flatnonzero(at >= 0)
        n, n1, kinds, bit = n[at[i]], n1[at[i]], kinds[at[i]], bit[i]
        for out, own in ((full, 0), (without, 1)):
            out[i] += _log_bit(w, np.stack([_share(n1 - own * bit, n - own, SMALL), kinds], axis=-1), _gate(n - own), bit)
    return full, without


def class_probabilities(counts: np.ndarray) -> np.ndarray:
    """(2, classes, classes, classes): log10 probability of a class after the two classes before it, from how often they followed, and that without one of its own tokens."""
    n = counts.reshape(CLASSES, CLASSES, CLASSES).astype(float)
    out = np.zeros((2, *n.shape))
    w = np.tile([0.2, 0.4, 0.4], ((len(SEEN) + 1) ** 2, 1))
    w[: len(SEEN) + 1] = [0.6, 0.4, 0.0]  # two classes that were never met
    bend = np.full_like(w, FIRM)

    def inputs(two: np.ndarray, one: np.ndarray, all_: np.ndarray, bit: int, own: int) -> tuple[np.ndarray, np.ndarray]:
        """Counts end in axes (node, bit); own: 1 where a token with this bit is left out."""
        sums = [v.sum(axis=-1) - own for v in (two, one, all_)]
        x = [np.broadcast_to(_share(v[..., 1] - own * bit, s), two.shape[:-1]) for v, s in zip((all_, one, two), sums[::-1], strict=True)]
        return np.stack(x, axis=-1), _gate(sums[0]) * (len(SEEN) + 1) + np.broadcast_to(_gate(sums[1]), two.shape[:-1])

    levels = [n.reshape(CLASSES, CLASSES, 1 << k, 2, -1).sum(axis=-1) for k in range(CLASS_BITS)]
    for two in levels:
        one, all_ = two.sum(axis=0), two.sum(axis=(0, 1))
        for a in range(CLASSES):
            for bit in (0, 1):
                _learn_bits(w, bend, *inputs(two[a], one, all_, bit, 1), bit, two[a, ..., bit])
    own = np.arange(CLASSES)
    for k, two in enumerate(levels):
        one, all_ = two.sum(axis=0), two.sum(axis=(0, 1))
        node, bits = own >> (CLASS_BITS - k), own >> (CLASS_BITS - 1 - k) & 1
        for kind in (0, 1):
            p = np.stack([_log_bit(w, *inputs(two, one, all_, bit, kind), bit) for bit in (0, 1)], axis=-1)
            out[kind] += p[:, :, node, bits]
    return out


def _triples(h: np.ndarray, token: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The numbers of each token's class after the two before it; a text begins after ends."""
    own = (h >> np.uint64(64 - CLASS_BITS)).astype(np.int64)[token]
    first, second = np.full(len(own), END), np.full(len(own), END)
    first[1:] = np.where(row[1:] == row[:-1], own[:-1], END)
    second[2:] = np.where(row[2:] == row[:-2], own[:-2], END)
    return (second * CLASSES + first) * CLASSES + own


def _prefix(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - PREFIX_BITS)).astype(np.int64)


# -- contexts


def _tokens(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words in order of their hash, the hashes, the number of each token's word, the text of each token, tokens in each text).

    Texts end with the empty word, which is always among the words.
    """
    code, words, counts = words_of(texts)
    spelt = [*(w.encode() for w in words), b""]
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in spelt), np.uint64, len(spelt))
    order = np.argsort(h, kind="stable")
    at = np.empty(len(order), np.int64)
    at[order] = np.arange(len(order))
    size = counts + 1
    ends = np.cumsum(size) - 1
    token = np.full(int(size.sum()), at[-1])
    inner = np.ones(len(token), bool)
    inner[ends] = False
    token[inner] = at[code]
    return [spelt[i] for i in order], h[order], token, np.repeat(np.arange(len(size)), size), size


def _pairs(h: np.ndarray, token: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct numbers of context and token, the place of each token's): 44 bits of the hash of the two tokens before, 20 of the token's."""
    own = h[token]
    first, second = np.full(len(own), 1, np.uint64), np.full(len(own), 2, np.uint64)
    first[1:] = np.where(row[1:] == row[:-1], own[:-1], first[1:])
    second[2:] = np.where(row[2:] == row[:-2], own[:-2], second[2:])
    key = (second * _MIX + first) * _MIX
    key ^= key >> np.uint64(31)
    key = (key * np.uint64(0xBF58476D1CE4E5B9)) & ~np.uint64(0xFFFFF) | (own >> np.uint64(44))
    return np.unique(key, return_inverse=True)


def _send(buckets: int):
    """(pack, body) to rows (kind, bucket, pack, a, b, c): 0, the pack's distinct words; 1, its contexts with their tokens; c counts training tokens; 3, the classes of a task's training tokens that followed the class of the bucket."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        thin = zstandard.ZstdCompressor(level=1)
        followed, pack = np.zeros(CLASSES**3, np.int64), None
        for b in batches:
            for i in range(b.num_rows):
                pack, body = b.column(0)[i].as_py(), unpack(b.column(1)[i].as_py())
                words, h, token, row, _ = _tokens(body.column(2))
                live = ~body.column(1).to_numpy(zero_copy_only=False)[row]
                c = np.bincount(token[live], minlength=len(words))
                key, at = _pairs(h, token, row)
                c2 = np.bincount(at[live], minlength=len(key))
                followed += np.bincount(_triples(h, token, row)[live], minlength=len(followed))
                e, e2 = cuts(h >> np.uint64(64 - PREFIX_BITS) << np.uint64(64 - PREFIX_BITS), buckets), cuts(key, buckets)
                out = []
                for k in range(buckets):
                    s, s2 = slice(e[k], e[k + 1]), slice(e2[k], e2[k + 1])
                    if s.stop > s.start:
                        out.append((0, k, pack, thin.compress(b"".join(words[s])), press([len(w) for w in words[s]]), press(c[s])))
                    if s2.stop > s2.start:
                        low = key[s2]
                        out.append((1, k, pack, (low >> np.uint64(16)).astype(np.uint32).tobytes(), low.astype(np.uint16).tobytes(), press(c2[s2])))
                yield _rows(out)
        if followed.any():
            yield _rows([(3, a, pack, press(v), b"", press([])) for a, v in enumerate(followed.reshape(CLASSES, -1)) if v.any()])

    return run


_MESSAGE = "kind int, bucket int, pack long, a binary, b binary, c binary"


def _rows(out: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=[c.split()[0] for c in _MESSAGE.split(", ")])


def _unjoin(a: bytes, lens: np.ndarray) -> list[bytes]:
    """The words of _send()'s column a."""
    flat, ends = zstandard.ZstdDecompressor().decompress(a), np.cumsum(lens).tolist()
    return [flat[x:y] for x, y in zip([0, *ends], ends, strict=False)]


def _state(n: np.ndarray, m: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """What a context has seen (n tokens, m of them its favourite; 0 for nothing), doubled, and whether the favourite came."""
    cls = 1 + (np.searchsorted(SEEN, n, side="right") - 1) * SHARES + np.minimum((SHARES - 1) * m // np.maximum(n, 1), SHARES - 1)
    return np.where(n > 0, 2 * cls + hit, 0).astype(np.uint8)


def contexts(key: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For (context, token) numbers, sorted, with their counts: the state of each, and that without one of its own tokens.

    Of equally frequent tokens the smaller number is the favourite; without its own token, a token must be more
    frequent than all others to be foretold.
    """
    begin = np.flatnonzero(np.append(True, key[1:] >> np.uint64(20) != key[:-1] >> np.uint64(20)))
    size = np.diff(np.append(begin, len(key)))
    n, most = np.add.reduceat(c, begin), np.maximum.reduceat(c, begin)
    of = np.repeat(np.arange(len(begin)), size)
    at = np.flatnonzero(c == most[of])
    top = at[np.unique(of[at], return_index=True)[1]]
    rest = c.copy()
    rest[top] = 0
    next_ = np.maximum.reduceat(rest, begin)
    is_top = np.zeros(len(key), bool)
    is_top[top] = True
    n, most, next_ = n[of], most[of], next_[of]
    without = np.where(is_top, np.maximum(c - 1, next_), most)
    return _state(n, most, is_top & (c > 0)), _state(n - 1, without, is_top & (c - 1 > next_))


@lean
def _tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _send() by kind and bucket to the answers to each pack, and a row of kind 2, the training words of a bucket; sums of the rows of kind 3.

    Answers to words have their counts, and what the bits of their hashes beyond the prefix cost, in thousandths, rounded up.
    """
    thin = zstandard.ZstdCompressor(level=1)
    for rows in runs(batches, 2):
        kind, bucket = rows[0][:2]
        if kind == 3:
            total = np.zeros(CLASSES * CLASSES, np.int64)
            for r in rows:
                total += loose(r[3])
            yield _rows([(3, bucket, None, press(total, "<u8"), None, None)])
            continue
        out, edges = [], np.cumsum([0, *(len(loose(r[5])) for r in rows)])
        counts = np.concatenate([loose(r[5]) for r in rows]).astype(np.int64)
        if kind == 0:
            number: dict[bytes, int] = {}
            at = np.fromiter((number.setdefault(w, len(number)) for r in rows for w in _unjoin(r[3], loose(r[4]))), np.int64, len(counts))
            c = np.bincount(at, counts, len(number)).astype(np.int64)
            told = c[at]
            h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in number), np.uint64, len(number))
            order = np.argsort(h, kind="stable")
            order = order[c[order] > 0]
            cost = np.zeros((2, len(number)))
            cost[:, order] = path(h[order], c[order], c[order] * (c[order] > 1), np.ones(len(order), np.int64), PREFIX_BITS, 64)
            cost = np.minimum(np.ceil(-1000 * cost), 65535)[:, at]
            for r, a, e in zip(rows, edges, edges[1:], strict=False):
                out.append((0, bucket, r[2], press(told[a:e], "<u8"), press(cost[:, a:e], "<u2"), None))
            known = sorted(w for w, k in number.items() if c[k])
            if known:
                out.append((2, bucket, None, thin.compress(b"".join(known)), press([len(w) for w in known]), press([c[number[w]] for w in known], "<u8")))
        else:
            low = np.concatenate([np.frombuffer(r[3], np.uint32).astype(np.uint64) << np.uint64(16) | np.frombuffer(r[4], np.uint16) for r in rows])
            key, at = np.unique(low, return_inverse=True)
            full, without = (x[at] for x in contexts(key, np.bincount(at, counts, len(key)).astype(np.int64)))
            for r, a, e in zip(rows, edges, edges[1:], strict=False):
                out.append((1, bucket, r[2], press(full[a:e], "u1"), press(without[a:e], "u1"), None))
        yield _rows(out)


def case_of(state: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The case of each token: its state, and how many tokens of its text right before it were foretold."""
    hit = (state & 1).astype(bool)
    place = np.arange(len(state))
    missed = np.where(hit, -1, place)
    missed = np.maximum(missed, np.where(np.append(True, row[1:] != row[:-1]), place - 1, -1))  # a text's begin
    before = place - 1 - np.maximum.accumulate(np.append(-1, missed[:-1])) if len(state) else place
    first = np.append(True, row[1:] != row[:-1]) if len(state) else np.zeros(0, bool)
    before = np.where(first, 0, np.minimum(before, place))
    return (state >> 1).astype(np.int64) * (2 * (len(RUNS) + 1)) + 2 * np.searchsorted(RUNS, before, side="right") + hit


def case_probabilities(counts: np.ndarray) -> np.ndarray:
    """log10 probability of each case from the counts of the training tokens' cases (without their own).

    Mixed online, case after case, from three predictors: the context's state, the run of foretold tokens, and
    the share of all; the gate is what the context has seen. Refined by what was seen of the case itself.
    """
    n = counts.reshape(STATES, len(RUNS) + 1, 2).astype(float)
    rate = lambda x: (x[..., 1] + 0.4) / (x.sum(axis=-1) + 0.8)
    p = [np.broadcast_to(rate(n.sum(axis=1))[:, None], n.shape[:2]), np.broadcast_to(rate(n.sum(axis=0))[None, :], n.shape[:2]), np.full(n.shape[:2], rate(n.sum(axis=(0, 1))))]
    x = np.stack([_stretch(v) for v in p], axis=-1)
    gate = np.maximum(np.arange(STATES) - 1, 0) // SHARES
    w = np.tile([0.7, 0.3, 0.0], (len(SEEN), 1))
    bend = np.full_like(w, FIRM)
    for _ in range(20):
        for s in range(1, STATES):
            for r in range(n.shape[1]):
                total = n[s, r].sum()
                if total:
                    q = _squash(w[gate[s]] @ x[s, r])
                    bend[gate[s]] += q * (1 - q) * total * x[s, r] ** 2
                    w[gate[s]] += RATE * (n[s, r, 1] - q * total) * x[s, r] / bend[gate[s]]
    mixed = _squash((w[gate][:, None] * x).sum(axis=-1))
    refined = np.clip((n[..., 1] + 20 * mixed) / (n.sum(axis=-1) + 20), 1e-7, 1 - 1e-7)
    out = np.log10(np.stack([1 - refined, refined], axis=-1))
    out[0] = 0.0  # a context that has seen nothing foretells nothing
    return out.ravel()


def _score(total: int, distinct: int, once: int, model, kind: pa.DataType):
    """Rows (pack, kind, bucket, a, b, body) by pack to a row per text, with the cases of its tokens."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (tables, w, refine), known = model.value
        escape = (once + 0.5) / (total + 1.0)
        for rows in runs(batches):
            body = unpack(next(r[5] for r in rows if r[5] is not None))
            ids, held, texts = body.columns
            words, h, token, row, size = _tokens(texts)
            answers = sorted((r for r in rows if r[5] is None), key=lambda r: (r[1], r[2]))
            c = np.concatenate([loose(r[3], "<u8") for r in answers if r[1] == 0]).astype(np.int64)
            _, at = _pairs(h, token, row)
            full, without = (np.concatenate([loose(r[k], "u1") for r in answers if r[1] == 1]) for k in (3, 4))
            out = held.to_numpy(zero_copy_only=False)
            case = case_of(np.where(out[row], full[at], without[at]), row)
            missed = np.log10((1 - escape) * np.maximum(c, 1) / max(total, 1))
            new = np.flatnonzero(c == 0)
            missed[new] = np.log10(escape) + spell([words[i] for i in new], tables, w, refine)
            missed = missed[token]
            if known is not None:
                own = np.concatenate([loose(r[4], "<u2").reshape(2, -1) for r in answers if r[1] == 0], axis=1) / -1000 + known[1][:, _prefix(h)]
                side = (~out).astype(np.int64)[row]  # 1: without the token's own
                mixed = np.log10(1 - escape) + known[0].reshape(2, -1)[side, _triples(h, token, row)] + own[side, token]
                missed = np.where(c[token] > 0, mixed, missed)
            base = np.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))
            add = lambda v: np.bincount(row, v, len(size))
            spelled = add(np.where(case & 1, 0.0, missed))
            span = STATES * 2 * (len(RUNS) + 1)
            met, times = np.unique(row * span + case, return_counts=True)
            edges = pa.array(np.append(0, np.cumsum(np.bincount(met // span, minlength=len(size)))), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    ids.cast(kind), held, pa.array(size), pa.array(add((c > 0)[token].astype(float)).astype(np.int64)), pa.array(add(base[token])), pa.array(spelled),
                    pa.ListArray.from_arrays(edges, pa.array(met % span, pa.int32())), pa.ListArray.from_arrays(edges, pa.array(times, pa.int64())),
                    pa.array(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)),
                ],
                names=["id", "held_out", "n_tokens", "n_known", "base_score", "spelled", "cases", "times", "n_bytes"],
            )

    return run


def _vectors(part: int, rows: dict[int, np.ndarray]) -> pa.RecordBatch:
    """Vectors (by number) in blocks; zero blocks are left out."""
    block, data = [], []
    for k, v in rows.items():
        for i in range(0, len(v), VECTOR_BLOCK):
            if v[i : i + VECTOR_BLOCK].any():
                block.append(k * 10_000 + i // VECTOR_BLOCK)
                data.append(press(v[i : i + VECTOR_BLOCK], "<f8"))
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array([part] * len(block), pa.int64()), pa.array(data, pa.binary())], names=["block", "part", "data"])


def _add_up(vectors: DataFrame, sizes: dict[int, int]) -> dict[int, np.ndarray]:
    """Sums of the parts' vectors, in order of the parts; one at a time is in memory, and the driver gets the sums only."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = None, np.zeros(0)
        for b in batches:
            for k, data in zip(b.column(0).to_pylist(), (x.as_py() for x in b.column(2)), strict=True):
                if k != block:
                    if block is not None:
                        yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "data": pa.array([press(total, "<f8")], pa.binary())})
                    block, total = k, loose(data, "<f8").copy()
                else:
                    total += loose(data, "<f8")
        if block is not None:
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "data": pa.array([press(total, "<f8")], pa.binary())})

    out = {k: np.zeros(n) for k, n in sizes.items()}
    for r in vectors.repartition("block").sortWithinPartitions("block", "part").mapInArrow(run, "block int, data binary").collect():
        v, at = loose(r["data"], "<f8"), r["block"] % 10_000 * VECTOR_BLOCK
        out[r["block"] // 10_000][at : at + len(v)] = v
    return out


def spelling(dictionary: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tables, weights, adaptive map) of the training words (rows of kind 2)."""
    session, size, cells = dictionary.sparkSession, int(_OFFSETS[-1]), 256 * BUCKETS

    @lean
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part = None, 0
        for b in batches:
            for i in range(b.num_rows):
                own = count_tables(_unjoin(b.column(1)[i].as_py(), loose(b.column(2)[i].as_py())))
                total, part = own if total is None else total + own, b.column(0)[i].as_py()
        if total is not None:
            yield _vectors(part, {0: total[0], 1: total[1]})

    own = dictionary.select("bucket", "a", "b", "c")
    sums = _add_up(own.mapInArrow(counted, "block int, part long, data binary"), {0: size, 1: size})  # whole numbers: any order will do
    tables = np.stack([sums[0], sums[1]]).astype(np.float32)
    shared = session.sparkContext.broadcast(tables)

    @lean
    def learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                words, c = _unjoin(b.column(1)[i].as_py(), loose(b.column(2)[i].as_py())), loose(b.column(3)[i].as_py(), "<u8")
                new = [x for x, k in zip(words, c.tolist(), strict=True) if k == 1]
                if new:
                    new.sort(key=lambda x: xxhash.xxh3_64_intdigest(x, 2))
                    w, seen = learn(new, shared.value)
                    n = float(sum(len(x) + 1 for x in new))
                    yield _vectors(b.column(0)[i].as_py(), {0: w.ravel() * n, 1: seen[0], 2: seen[1], 3: np.array([n])})

    sums = _add_up(own.mapInArrow(learned, "block int, part long, data binary"), {0: GATES * INPUTS, 1: cells, 2: cells, 3: 1})
    w = sums[0].reshape(GATES, INPUTS) / sums[3][0] if sums[3][0] else start_weights()
    return tables, w, refinement(np.stack([sums[1], sums[2]]))


def known_words(dictionary: DataFrame, classes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """log10 probabilities (full, and without an own token) of classes after two others and of the other bits of prefixes; classes: rows of kind 3."""

    @lean
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                words, c = _unjoin(b.column(1)[i].as_py(), loose(b.column(2)[i].as_py())), loose(b.column(3)[i].as_py(), "<u8")
                at = _prefix(np.fromiter((xxhash.xxh3_64_intdigest(x) for x in words), np.uint64, len(words)))
                yield _vectors(b.column(0)[i].as_py(), {0: np.bincount(at, c, PREFIXES), 1: np.bincount(at, minlength=PREFIXES).astype(float), 2: np.bincount(at, c * (c > 1), PREFIXES)})

    sums = _add_up(dictionary.select("bucket", "a", "b", "c").mapInArrow(counted, "block int, part long, data binary"), dict.fromkeys(range(3), PREFIXES))
    at = np.flatnonzero(sums[1])
    paths = np.zeros((2, PREFIXES))
    paths[:, at] = path(at.astype(np.uint64) << np.uint64(64 - PREFIX_BITS), *(sums[k][at].astype(np.int64) for k in (0, 2, 1)), CLASS_BITS, PREFIX_BITS)
    counts = np.zeros((CLASSES, CLASSES * CLASSES))
    for r in classes.select("bucket", "a").collect():  # one for each class
        counts[r["bucket"]] = loose(r["a"], "<u8")
    return class_probabilities(counts), paths


def lm_score(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", mixed_words: bool = False) -> DataFrame:
    """One row per row of df: id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Rows whose crc32(id as text) mod 5 is 1 are held out, all others train; a null id counts as the empty
    string and so trains. A known word that isn't foretold is decided bit by bit, mixed, with mixed_words, and
    has its plain share of the training tokens otherwise. A null text counts as empty: one token, its end. Repeated rows are counted and
    scored like any other. Without training rows all counts are 0 and texts are spelled by even bits. An empty
    table gives an empty result; other columns aren't read.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "lm")
    kind = df.schema[id_col].dataType
    own = F.coalesce(df[id_col].cast("string"), F.lit(""))
    docs = df.select(df[id_col].alias("id"), (F.crc32(own.cast("binary")) % 5 == 1).alias("held_out"), df[text_col].cast("string").alias("text"))
    volume = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 + volume // BUCKET_BYTES
    packs = scratch.table(docs.mapInArrow(pack_rows(PACK_BYTES), "pack long, body binary"), "packs")
    sent = packs.mapInArrow(_send(buckets), _MESSAGE).repartition("kind", "bucket").sortWithinPartitions("kind", "bucket", "pack")
    told = scratch.table(sent.mapInArrow(_tell, _MESSAGE), "told")
    dictionary = told.filter("kind = 2")

    @lean
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0):
                c = loose(x.as_py(), "<u8")
                yield pa.RecordBatch.from_pydict({"n": pa.array([int(c.sum())]), "v": pa.array([len(c)]), "once": pa.array([int((c == 1).sum())])})

    sums = dictionary.select("c").mapInArrow(summed, "n long, v long, once long").agg(F.sum("n").alias("n"), F.sum("v").alias("v"), F.sum("once").alias("once")).first()
    total, distinct, once = (sums[k] or 0 for k in ("n", "v", "once"))
    model = spark.sparkContext.broadcast((spelling(dictionary), known_words(dictionary, told.filter("kind = 3")) if mixed_words else None))
    answers = told.filter("kind < 2").select("pack", "kind", "bucket", "a", "b")
    both = packs.unionByName(answers, allowMissingColumns=True).select("pack", "kind", "bucket", "a", "b", "body").repartition("pack").sortWithinPartitions("pack")
    scored = both.mapInArrow(
        _score(total, distinct, once, model, to_arrow_type(kind)),
        f"id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, base_score double, spelled double, cases array<int>, times array<long>, n_bytes long",
    )
    scored = scratch.table(scored, "scored")
    scratch.drop("packs", "told")
    seen = scored.filter("not held_out").select(F.explode(F.arrays_zip("cases", "times")).alias("z")).groupBy("z.cases").agg(F.sum("z.times").alias("n")).collect()  # as many as there are cases
    counts = np.zeros(STATES * 2 * (len(RUNS) + 1))
    for r in seen:
        counts[r["cases"]] = r["n"]
    value = F.array(*(F.lit(float(x)) for x in case_probabilities(counts)))
    foretold = F.aggregate(F.zip_with("cases", "times", lambda k, n: value[k] * n), F.lit(0.0), lambda a, x: a + x)
    out = scored.withColumn("score", F.col("spelled") + foretold).withColumn("train_tokens", F.lit(total).cast("long"))
    out = out.withColumn("bits_per_byte", -F.col("score") * float(np.log2(10)) / F.greatest("n_bytes", F.lit(1)))
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op7_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(spark.read.parquet(f"{sf_dir}/documents.parquet"), mixed_words=True)

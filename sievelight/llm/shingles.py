"""Sets of word shingles as sorted 64-bit numbers, over Arrow string arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from sievelight.llm.bpe import byte_batches

BATCH_BYTES = 8 << 20


def words_of(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(number of each word in order, the distinct words, words in each text); A-Z in lower case, nulls as empty."""
    texts = pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), ""))
    lists = pc.split_pattern_regex(pc.ascii_trim_whitespace(texts), r"[\x20\x09-\x0D]+")
    coded = lists.flatten().dictionary_encode()
    code, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    counts = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    if "" in words:  # texts without a word
        hole = words.index("")
        row = np.repeat(np.arange(len(counts)), counts)
        counts -= np.bincount(row[code == hole], minlength=len(counts))
        code = code[code != hole]
    return code, words, counts


def _mixed(h: np.ndarray, width: int) -> np.ndarray:
    """The number of the width words from every place on."""
    m = len(h) - width + 1
    out = np.zeros(max(m, 0), np.uint64)
    for k in range(width if m > 0 else 0):
        out = (out ^ h[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def shingle_batches(texts: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first text, end text, set sizes, the sorted distinct shingles of one text after another).

    A shingle is a 64-bit hash. Texts with fewer words than width have their whole sequence as one; those
    without a word have the empty set.
    """
    texts = texts.cast(pa.string())
    bytes_ = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for lo, hi in byte_batches(bytes_, BATCH_BYTES):
        code, words, counts = words_of(texts.slice(lo, hi - lo))
        h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))[code]
        mixed, ends = _mixed(h, width), np.cumsum(counts)
        sets = []
        for n, b in zip(counts.tolist(), ends.tolist(), strict=True):
            a = b - n
            sets.append(np.unique(mixed[a : b - width + 1]) if n >= width else _mixed(h[a:b], n) if n else h[:0])
        yield lo, hi, np.fromiter(map(len, sets), np.int64, len(sets)), np.concatenate(sets)


def set_key(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()

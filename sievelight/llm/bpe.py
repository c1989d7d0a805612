"""Byte-level BPE over Arrow string arrays: each distinct marked word is encoded once.

A pre-token of this tokenizer never spans a change from non-white-space to white space, so a
text cut at such places encodes piece by piece. A batch of texts is cut there, its pieces are
dictionary-encoded by Arrow, and only pieces not met before reach the tokenizer's BPE model.
"""

from __future__ import annotations

import os
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pre-tokens kept by one Python worker; beyond it the memory is given back and filled anew.
CACHE_WORDS = 300_000
#: Bytes of text handled at once.
BATCH_BYTES = 8 << 20
#: Texts over this are cut at safe places before they are handled.
LONG_BYTES = 1 << 20

#: Where cutting by single spaces and line feeds would not give independent pieces.
_IRREGULAR = (
    r"[\x{00}-\x{08}\t\r\x{0b}\x{0c}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    r"|  | \n|\n |\n\n"
)
_SAFE = regex.compile(r"(?<=\S)(?=\s)")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes pieces with one tokenizers file; equal to encode(add_special_tokens=False)."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        pre = spec.get("pre_tokenizer") or {}
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        # only this plain set-up is encoded word by word; any other file goes text by text
        self.by_piece = (
            pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space")
            and pre.get("use_regex", True)
            and not spec.get("normalizer")
            and not any(c.isspace() for t in self.special for c in t)
            and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", []))
        )
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(keep)]
        self.table = {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.model = self.whole.model
        self.words: dict[str, int] = {}
        self.flat, self.ends = array("H" if self.whole.get_vocab_size() <= 1 << 16 else "L"), array("q", [0])

    def text(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def codes(self, words: list[str]) -> np.ndarray:
        """The number of each pre-token in this worker's store; new ones go through the BPE model."""
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
            del self.flat[:], self.ends[1:]
        known, flat, ends = self.words, self.flat, self.ends
        found = list(map(known.get, words))
        if None in found:
            tokenize, table = self.model.tokenize, self.table
            for i, code in enumerate(found):
                if code is None:
                    code = known.get(words[i])
                    if code is None:
                        flat.extend([t.id for t in tokenize(words[i].encode().decode("latin-1").translate(table))])
                        ends.append(len(flat))
                        code = known[words[i]] = len(ends) - 2
                    found[i] = code
        return np.array(found, np.int64)

    def store(self) -> tuple[np.ndarray, np.ndarray]:
        """(lengths of the pre-tokens' ids, these ids one after another); copies, as the store may grow."""
        return np.diff(np.array(self.ends, np.int64)), np.array(self.flat, np.uint32)

    def chunk(self, text: str) -> np.ndarray:
        """Ids of a text that is cut nowhere."""
        if any(s in text for s in self.special):
            return self.text(text)
        code = self.codes(self.pattern.findall(text))
        return gather(code, *self.store())

    def marked(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, flat ids) of pieces: a first piece begins with U+0001, one after a line feed with it, others lost a space."""
        special = "".join(self.special)
        apart = {i for i, p in enumerate(pieces) if p in ("", "\x01", "\n")}
        if special and any(s in "".join(pieces) for s in self.special):
            apart |= {i for i, p in enumerate(pieces) if any(s in p for s in self.special)}
        plain = [p for i, p in enumerate(pieces) if i not in apart] if apart else pieces
        words = self.pattern.findall("".join(["\n" + p[1:] if p[0] < "\x0b" else " " + p for p in plain]))
        code = self.codes(words)
        wlen, wflat = self.store()
        begins = np.fromiter((w[0] in " \n" for w in words), bool, len(words))
        at = np.flatnonzero(begins)
        if len(at) != len(plain):
            raise ValueError("pieces of a text aren't independent")
        n = wlen[code] if len(code) else code
        first = np.fromiter((p[0] == "\x01" for p in plain), bool, len(plain))
        kept = np.ones(len(code), bool)
        kept[at[first]] = False  # the line feed that stands for the begin of a text
        lens = np.add.reduceat(n * kept, at) if len(at) else at
        flat = gather(code[kept], wlen, wflat)
        if not apart:
            return lens, flat
        own = [self.chunk({"": " ", "\x01": "", "\n": "\n"}.get(p, p[1:] if p[0:1] == "\x01" else p if p[0:1] == "\n" else " " + p)) for p in (pieces[i] for i in sorted(apart))]
        where = np.concatenate([np.setdiff1d(np.arange(len(pieces)), sorted(apart)), sorted(apart)]).astype(np.int64)
        sizes = np.concatenate([lens, [len(x) for x in own]]).astype(np.int64)
        order = np.argsort(where)
        return sizes[order], gather(order, sizes, np.concatenate([flat, *own]))

    def irregular(self, text: str) -> np.ndarray:
        if regex.search(r"[\x1c-\x1f]", text):
            return self.text(text)
        return self.chunk(text)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def byte_batches(sizes: np.ndarray, limit: int = BATCH_BYTES) -> list[tuple[int, int]]:
    """Ranges of rows of about limit bytes each."""
    if not len(sizes):
        return []
    group = np.cumsum(sizes) // limit
    cuts = np.flatnonzero(np.diff(group)) + 1
    return list(zip([0, *cuts], [*cuts, len(sizes)], strict=True))


def safe_parts(text: str, limit: int = LONG_BYTES) -> list[str]:
    """Cuts a long text where white space follows something else, at the first such place after each limit characters."""
    parts, at = [], 0
    while len(text) - at > limit:
        m = _SAFE.search(text, at + limit)
        if not m:
            break
        parts.append(text[at : m.start()])
        at = m.start()
    return [*parts, text[at:]]


def encode_batch(enc: Encoder, texts: pa.Array) -> tuple[np.ndarray | None, np.ndarray, np.ndarray, np.ndarray]:
    """For texts without nulls: (piece number of each piece in order, lengths of pieces, flat ids, pieces in each text).

    The ids of text i are those of its pieces in order; ids_of() and lengths_of() use this.
    """
    odd = pc.match_substring_regex(texts, _IRREGULAR).to_numpy(zero_copy_only=False)
    marked = pc.binary_join_element_wise(pa.scalar("\x01"), pc.replace_substring(texts, "\n", " \n"), "")
    if odd.any():
        marked = pc.if_else(pa.array(odd), "\x01", marked)
    lists = pc.split_pattern(marked, " ")
    coded = lists.flatten().dictionary_encode()
    plens, flat = enc.marked(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    counts = np.diff(lists.offsets.to_numpy())
    if odd.any():  # each has one piece so far, its first
        first, rows = np.concatenate([[0], np.cumsum(counts)[:-1]]), np.flatnonzero(odd)
        own = [enc.irregular(texts[int(i)].as_py()) for i in rows]
        code[first[rows]] = len(plens) + np.arange(len(rows))
        plens, flat = np.concatenate([plens, [len(x) for x in own]]).astype(np.int64), np.concatenate([flat, *own])
    return code, plens, flat, counts


def gather(code: np.ndarray, lens: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The runs of flat, whose lengths are lens, in the order of code."""
    if not len(code):
        return flat[:0]
    starts, n = np.cumsum(lens) - lens, lens[code]
    return flat[np.arange(int(n.sum())) + np.repeat(starts[code] - (np.cumsum(n) - n), n)]


def lengths_of(code: np.ndarray, lens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Ids in each text."""
    ends = np.concatenate([[0], np.cumsum(lens[code])])
    at = np.concatenate([[0], np.cumsum(counts)])
    return ends[at[1:]] - ends[at[:-1]]


def ids_of(code: np.ndarray, lens: np.ndarray, flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ids, text after text, and the ids in each text."""
    return gather(code, lens, flat), lengths_of(code, lens, counts)


def _encoded(path: str, texts: pa.Array):
    """Yields (first row, end row, row of each part, encode_batch() of the parts), about BATCH_BYTES at a time."""
    enc = encoder(path)
    texts = pc.fill_null(texts.cast(pa.string()), "")
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    for lo, hi in byte_batches(sizes):
        part, rows = texts.slice(lo, hi - lo), np.arange(hi - lo)
        if not enc.by_piece:
            got = [enc.text(t) for t in part.to_pylist()]
            lens = np.fromiter(map(len, got), np.int64, len(got))
            yield lo, hi, rows, (rows, lens, np.concatenate(got), np.ones(hi - lo, np.int64))
            continue
        if (sizes[lo:hi] > LONG_BYTES).any():
            parts = [safe_parts(t) for t in part.to_pylist()]
            rows = np.repeat(rows, [len(p) for p in parts])
            part = pa.array([p for own in parts for p in own], pa.string())
        yield lo, hi, rows, encode_batch(enc, part)


def count_texts(path: str, texts: pa.Array):
    """Yields (first row, end row, ids in each text): lengths only, no ids are put together. Nulls count as empty."""
    for lo, hi, rows, (code, lens, _, counts) in _encoded(path, texts):
        yield lo, hi, np.bincount(rows, lengths_of(code, lens, counts), hi - lo).astype(np.int64)


def encode_texts(path: str, texts: pa.Array):
    """Yields (first row, end row, ids of these texts one after another, ids in each text). Nulls count as empty."""
    for lo, hi, rows, coded in _encoded(path, texts):
        ids, n = ids_of(*coded)
        yield lo, hi, ids, np.bincount(rows, n, hi - lo).astype(np.int64)

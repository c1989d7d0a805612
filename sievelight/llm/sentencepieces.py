"""Operator 5, SentencePiece encoding and decoding by shared-prefix Viterbi.

Normalised texts are cut into marked words (a run of U+2581, then other characters), no piece spans two of
them. The distinct words of a batch are sorted, which is a depth-first walk of their trie, and the forward
states of a word's characters are kept on a stack: the next word goes on from the longest prefix it
shares. For a unigram model a state is the best score and the piece that ends there. For a BPE model the best
scoring path isn't the library's result; there the state is the last piece of the prefix's own encoding,
which is unique: the piece whose merges with the piece before it give just these two again.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from sievelight.llm.packs import lean
from pyspark.sql import functions as F

from sievelight.llm.bpe import byte_batches, gather, tokenizer_path

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Words kept by one Python worker; beyond it the memory is given back and filled anew.
CACHE_WORDS = 500_000
BATCH_BYTES = 8 << 20
UNIGRAM, BPE = 1, 2


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""

    def varint(i: int) -> tuple[int, int]:
        n = shift = 0
        while True:
            n |= (raw[i] & 127) << shift
            shift += 7
            i += 1
            if raw[i - 1] < 128:
                return n, i

    i = 0
    while i < len(raw):
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(i)
        else:
            size, i = varint(i) if kind == 2 else (4 if kind == 5 else 8, i)
            value, i = raw[i : i + size], i + size
        yield tag >> 3, value


class Encoder:
    """Encodes and decodes with one sentencepiece model; equal to the library's encode() and decode()."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            raw = f.read()
        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
        spec = dict(_fields(raw))
        trainer, normalizer = dict(_fields(spec.get(2, b""))), dict(_fields(spec.get(3, b"")))
        self.kind = trainer.get(3, UNIGRAM)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.scores = {i: sp.get_score(i) for i in plain}
        self.bytes = [next((i for i in range(n) if sp.is_byte(i) and self.pieces[i] == f"<0x{b:02X}>"), -1) for b in range(256)]
        held = set("".join(self.ids))
        self.cut = next(c for c in "\x1f\x1e\x1d\ue000\ue001\ue002" if c not in held)  # goes between words
        # kinds of models that are encoded word by word; any other goes text by text
        self.by_word = (
            self.kind in (UNIGRAM, BPE)
            and min(self.bytes) >= 0
            and not normalizer.get(2)
            and normalizer.get(4, 1) == 0
            and normalizer.get(3, 1) == 1
            and not trainer.get(24, 0)
            and not any(sp.is_unused(i) for i in range(n))
            and not any(MARK in p.lstrip(MARK) for p in self.ids)
            and not "\n" in held
        )
        self.longest = max(map(len, self.ids), default=1)
        self.unknown = min(self.scores.values(), default=0.0) - 10
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words: dict[str, int] = {}
        self.flat, self.ends = array("L"), array("q", [0])

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by the merges themselves: always the pair with the best score, the leftmost of equals."""
        parts = list(text)
        while True:
            found = [(-self.scores[self.ids[a + b]], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.ids]
            if not found:
                return parts
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def follows(self, before: str, piece: str) -> bool:
        """Whether the merges of before + piece end with just these two (of piece alone: with it)."""
        got = self.pairs.get((before, piece))
        if got is None:
            if len(self.pairs) > CACHE_WORDS:
                self.pairs.clear()
            got = self.pairs[before, piece] = self.merged(before + piece) == ([before, piece] if before else [piece])
        return got

    def walk(self, words: list[str]) -> Iterator[tuple[str, list[str]]]:
        """(word, its pieces) for distinct words in sorted order; states of shared prefixes are computed once."""
        last = ""
        ends: list[int] = [0]  # where the last piece of each prefix begins
        best: list[float] = [0.0]
        ids, scores, bpe = self.ids, self.scores, self.kind == BPE
        for word in words:
            shared = len(commonprefix((last, word)))
            del ends[shared + 1 :], best[shared + 1 :]
            for i in range(shared + 1, len(word) + 1):
                if bpe:
                    for j in range(max(0, i - self.longest), i):
                        piece = word[j:i]
                        if (j == i - 1 or piece in ids) and self.follows(word[ends[j] : j], piece):
                            ends.append(j)
                            break
                    else:
                        raise ValueError(f"no encoding of {word[:i]!r}")
                else:
                    top, at = -np.inf, i - 1
                    for j in range(max(0, i - self.longest), i):
                        k = ids.get(word[j:i])
                        score = best[j] + (scores[k] if k is not None else self.unknown if j == i - 1 else -np.inf)
                        if score > top:
                            top, at = score, j
                    ends.append(at)
                    best.append(top)
            pieces, i = [], len(word)
            while i:
                pieces.append(word[ends[i] : i])
                i = ends[i]
            yield word, pieces[::-1]
            last = word

    def codes(self, words: list[str]) -> np.ndarray:
        """The number of each distinct word in this worker's store; new ones are encoded together."""
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
            del self.flat[:], self.ends[1:]
        for word, pieces in self.walk(sorted(w for w in words if w not in self.words)):
            for p in pieces:
                k = self.ids.get(p)
                if k is None:
                    self.flat.extend([self.bytes[b] for b in p.encode()])
                else:
                    self.flat.append(k)
            self.ends.append(len(self.flat))
            self.words[word] = len(self.ends) - 2
        return np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Yields (first row, end row, ids of these texts one after another, ids in each); nulls count as empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        for lo, hi in byte_batches(sizes, BATCH_BYTES):
            part = texts.slice(lo, hi - lo)
            if not self.by_word:
                got = [np.array(x, np.uint32) for x in self.library.encode(part.to_pylist(), num_threads=1)]
                yield lo, hi, np.concatenate(got), np.fromiter(map(len, got), np.int64, len(got))
                continue
            odd = pc.match_substring(part, self.cut).to_numpy(zero_copy_only=False)
            empty = sizes[lo:hi] == 0
            marked = pc.binary_join_element_wise(pa.scalar(MARK), pc.replace_substring(part, " ", MARK), "")
            marked = pc.if_else(pa.array(odd | empty), "", marked)
            marked = pc.replace_substring_regex(pc.replace_substring(marked, "\n", f"{self.cut}\n{self.cut}"), f"([^{MARK}{self.cut}]){MARK}", f"\\1{self.cut}{MARK}")
            lists = pc.split_pattern(marked, self.cut)
            coded = lists.flatten().dictionary_encode()
            own = self.codes(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
            code = own[coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)]
            lens, flat, counts = np.diff(np.array(self.ends, np.int64)), np.array(self.flat, np.uint32), np.diff(lists.offsets.to_numpy())
            if odd.any():  # each has one empty word so far
                first, rows = np.cumsum(counts) - counts, np.flatnonzero(odd)
                more = [np.array(self.library.encode(part[int(i)].as_py()), np.uint32) for i in rows]
                code[first[rows]] = len(lens) + np.arange(len(rows))
                lens, flat = np.concatenate([lens, [len(x) for x in more]]).astype(np.int64), np.concatenate([flat, *more])
            ends = np.concatenate([[0], np.cumsum(lens[code])])
            at = np.concatenate([[0], np.cumsum(counts)])
            yield lo, hi, gather(code, lens, flat), ends[at[1:]] - ends[at[:-1]]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes that aren't UTF-8 become U+FFFD, the mark of the first word goes."""
        if not self.by_word:
            return self.library.decode(ids)
        table = self.table()
        raw = b"".join(map(table.__getitem__, ids))
        text = raw.decode(errors="replace")
        return text[1:] if ids and self.pieces[ids[0]].startswith(MARK) else text

    @lru_cache(maxsize=1)  # noqa: B019  encoders live as long as the worker
    def table(self) -> list[bytes]:
        out = [p.replace(MARK, " ").encode() for p in self.pieces]
        for i in range(len(out)):
            if self.library.is_control(i):
                out[i] = b""
            elif self.library.is_unknown(i):
                out[i] = " ⁇ ".encode()
        for b, i in enumerate(self.bytes):
            out[i] = bytes([b])
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, digest: bool = False) -> DataFrame:
    """Whole texts to ids: id and ids (array of int), or with digest id, n_tokens, ids_crc32, text_crc32, decoded_crc32.

    A null text counts as empty and has no ids; repeated rows and null ids are handled like any other; an
    empty table gives an empty result; other columns aren't read. The crc32 of ids is over little-endian
    unsigned 32-bit numbers, those of the texts over UTF-8. A narrow map: no shuffle.
    """
    path = model or tokenizer_path(MODEL)
    kind = df.schema[id_col].dataType.simpleString()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            enc = encoder(path)
            for lo, hi, ids, n in enc.encode(b.column(1)):
                own = np.split(ids.astype("<u4"), np.cumsum(n)[:-1])
                names = b.column(0).slice(lo, hi - lo)
                if not digest:
                    offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([names, pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))], names=["id", "ids"])
                    continue
                texts = [t or "" for t in b.column(1).slice(lo, hi - lo).to_pylist()]
                cols = [n, [zlib.crc32(x.tobytes()) for x in own], [zlib.crc32(t.encode()) for t in texts], [zlib.crc32(enc.decode(x.tolist()).encode()) for x in own]]
                yield pa.RecordBatch.from_arrays([names, *(pa.array(c, pa.int64()) for c in cols)], names=["id", "n_tokens", "ids_crc32", "text_crc32", "decoded_crc32"])

    schema = f"id {kind}, n_tokens long, ids_crc32 long, text_crc32 long, decoded_crc32 long" if digest else f"id {kind}, ids array<int>"
    out = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)


def decode(df: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """Ids to texts: id, text. Null ids give a null text, an empty list the empty text."""
    path = model or tokenizer_path(MODEL)
    kind = df.schema[id_col].dataType.simpleString()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            enc = encoder(path)
            texts = [None if x is None else enc.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    out = df.select(df[id_col].alias("id"), df[ids_col].cast("array<int>").alias("ids")).mapInArrow(run, f"id {kind}, text string")
    return out.withColumnRenamed("id", id_col)


def op5_shared_prefix_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)
    return coded.withColumn("round_trip", F.col("text_crc32") == F.col("decoded_crc32"))

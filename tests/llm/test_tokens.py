"""Token counts, packing and SentencePiece against the libraries."""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa

from sievelight.llm import bpe, packing, sentencepieces, token_counts


def library():
    enc = bpe.encoder(bpe.tokenizer_path("byte_bpe_50k.json"))
    return lambda t: enc.whole.encode(t or "", add_special_tokens=False).ids


def test_counts_equal_the_library(docs, empty, edge_rows):
    ids = library()
    want = sorted((r[0] if r[0] is not None else -1, len((r[1] or "").encode()), len(ids(r[1])), len(ids(r[1])) > 1024) for r in edge_rows)
    got = token_counts.token_counts(docs)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got.collect()) == want
    assert token_counts.token_counts(empty).count() == 0


def test_long_texts_are_cut_at_safe_places(monkeypatch, edge_rows):
    monkeypatch.setattr(bpe, "LONG_BYTES", 300)
    monkeypatch.setattr(bpe, "BATCH_BYTES", 2000)
    texts = [r[1] for r in edge_rows]
    found = []
    for _, _, ids, n in bpe.encode_texts(bpe.tokenizer_path("byte_bpe_50k.json"), pa.array(texts)):
        found += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    assert found == [library()(t) for t in texts]


def test_packing_with_ids_of_other_types(spark):
    import datetime
    from decimal import Decimal

    for kind, ids in {"decimal(10,2)": [Decimal("1.50"), None], "date": [datetime.date(2024, 1, 2)], "double": [0.5], "binary": [bytearray(b"a")], "smallint": [3]}.items():
        df = spark.createDataFrame([(i, f"text of {i}") for i in ids], f"doc_id {kind}, text string")
        assert {r.doc_id if kind != "binary" else bytearray(r.doc_id) for r in packing.pack(df).collect()} == set(ids) if kind != "binary" else packing.pack(df).count() == 1


def test_every_control_character_and_others_in_every_place():
    path = bpe.tokenizer_path("byte_bpe_50k.json")
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x500 or 0x2000 <= c < 0x2070 or c % 389 == 0)]
    texts = [f.format(chr(c)) for f in ("{0}", "{0}y z", "x {0} y", "x {0}y", "x y{0}", "x\n{0}y", "x\n{0}", "x\t{0} y", "a{0}b c", "x  {0}z", "{0}{0} a") for c in points]
    got = [n for _, _, lengths in bpe.count_texts(path, pa.array(texts)) for n in lengths.tolist()]
    own = [x.tolist() for _, _, ids, n in bpe.encode_texts(path, pa.array(texts)) for x in np.split(ids, np.cumsum(n)[:-1])]
    want = [e.ids for e in bpe.encoder(path).whole.encode_batch(texts, add_special_tokens=False)]
    assert got == list(map(len, want)) and own == want


def test_counts_with_pieces(unique):
    enc = sentencepieces.encoder(bpe.tokenizer_path(sentencepieces.MODEL))
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(unique, tokenizer=bpe.tokenizer_path(sentencepieces.MODEL)).collect()}
    assert all(got[r.doc_id] == len(enc.library.encode(r.text or "")) for r in unique.collect())


def test_packing(docs, empty, edge_rows):
    ids = library()
    length = 128
    pieces = packing.pack(docs, length=length).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    want = defaultdict(list)
    for r in edge_rows:
        want[r[0]].append([*ids(r[1]), 0])
    for d, rows in want.items():
        pool = sorted((p.start, p.length, p.ids_crc32, p.doc_tokens) for p in by_doc[d])
        assert sum(p[1] for p in pool) == sum(map(len, rows))
        for r in rows:  # every piece is a cut of one of the id's rows
            assert {p[2] for p in pool if p[3] == len(r)} & {zlib.crc32(np.array(r[p[0] : p[0] + p[1]], "<u4").tobytes()) for p in pool}
        if len(rows) == 1:
            at = 0
            for start, size, crc, total in pool:
                assert start == at and total == len(rows[0]) and crc == zlib.crc32(np.array(rows[0][start : start + size], "<u4").tobytes())
                at += size
            assert at == len(rows[0])
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= length
    short = [s for s, own in by_seq.items() if sum(p.length for p in own) < length]
    assert len(short) <= 1 and sorted(by_seq) == list(range(len(by_seq)))
    assert packing.pack(empty).count() == 0


def test_hilbert_neighbours_touch():
    side = 8
    grid = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    keys = packing.hilbert_keys(grid, 3)
    assert sorted(keys) == list(range(side**3))
    walk = grid[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_similar_documents_are_near():
    r = np.random.default_rng(0)
    a, b = r.integers(0, 300, 400), r.integers(30_000, 30_300, 400)
    keys = packing.document_keys(np.concatenate([a, np.append(a[:-3], [9, 9, 9]), b]), np.array([400, 400, 400]))
    assert abs(keys[0] - keys[1]) < abs(keys[0] - keys[2])


def test_pieces_equal_the_library(docs, empty, edge_rows):
    enc = sentencepieces.encoder(bpe.tokenizer_path(sentencepieces.MODEL))
    assert enc.by_word
    got = sorted(((-1 if r[0] is None else r[0]), list(r[1])) for r in sentencepieces.encode(docs).collect())
    assert got == sorted(((-1 if r[0] is None else r[0]), enc.library.encode(r[1] or "")) for r in edge_rows)
    assert sentencepieces.encode(empty).count() == 0


def test_pieces_decode(spark, unique):
    enc = sentencepieces.encoder(bpe.tokenizer_path(sentencepieces.MODEL))
    texts = {r.doc_id: r.text or "" for r in unique.collect()}
    back = {r.doc_id: r.text for r in sentencepieces.decode(sentencepieces.encode(unique)).collect()}
    assert all(back[d] == enc.library.decode(enc.library.encode(t)) for d, t in texts.items())
    odd = spark.createDataFrame([(1, None), (2, []), (3, [1, 200, 3, 2])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in sentencepieces.decode(odd).collect()} == {1: None, 2: "", 3: enc.library.decode([1, 200, 3, 2])}


def test_unigram_walk_is_the_best_path():
    enc = sentencepieces.Encoder.__new__(sentencepieces.Encoder)
    enc.kind, enc.longest, enc.unknown = sentencepieces.UNIGRAM, 3, -20.0
    scores = {"a": -2.0, "b": -2.5, "ab": -3.0, "ba": -3.5, "aba": -5.5, "c": -1.0, "bc": -6.0}
    enc.ids, enc.scores = {p: i for i, p in enumerate(scores)}, dict(enumerate(scores.values()))

    def best(w):
        ways = [(0.0, [])] if not w else []
        for i in range(1, min(3, len(w)) + 1):
            if w[:i] in scores or i == 1:
                s, rest = best(w[i:])
                ways.append((scores.get(w[:i], -20.0) + s, [w[:i], *rest]))
        return max(ways, key=lambda x: x[0])

    words = sorted(["a", "ab", "aba", "abab", "ababc", "abx", "b", "bab", "cab", "x"])
    for w, pieces in enc.walk(words):
        assert sum(scores.get(p, -20.0) for p in pieces) == best(w)[0] and "".join(pieces) == w

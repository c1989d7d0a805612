"""Line dedup against brute force over runs of equal lines."""

import random
from collections import defaultdict

import xxhash

from sievelight.llm import line_dedup

R = random.Random(3)


def line(n):
    return " ".join("".join(R.choices("abcdefgh", k=4)) for _ in range(n))


def runs(texts):
    """(document, place) of the lines in runs of equal lines with 50 words or more that occur before; blank edges don't count."""
    lines = [t.split("\n") for t in texts]
    at, gone = defaultdict(list), set()
    for d, own in enumerate(lines):
        for i, x in enumerate(own):
            at[x].append((d, i))
    for places in at.values():
        for p in places:
            for q in places:
                if p < q and lines[p[0]][p[1]].split():
                    a, b = lines[p[0]][p[1] :], lines[q[0]][q[1] :]
                    n = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: B905
                    while not b[n - 1].split():
                        n -= 1
                    if sum(len(x.split()) for x in b[:n]) >= 50:
                        gone |= {(q[0], q[1] + k) for k in range(n)}
    return gone


def boundaries(lines):
    """The rule of the chunks, written out: a chunk of two lines or more ends where the hash of its last two lines says so."""
    h = [xxhash.xxh3_64_intdigest(x) for x in lines]
    ends = [i + 1 for i in range(len(lines)) if ((h[i] + (h[i - 1] * 0x9E3779B97F4A7C15 if i else 0)) % 2**64 >> 32) % 4 == 0]
    out, start = [], 0
    for e in [*ends, len(lines)]:
        if e - start >= 2 or e == len(lines) and e > start:
            out.append((start, e))
            start = e
    if len(out) > 1 and out[-1][1] - out[-1][0] == 1:
        out[-2:] = [(out[-2][0], out[-1][1])]
    return out


def by_chunks(texts):
    """(document, place) of the lines of chunks with two lines that have words, and of whole texts with one, met before."""
    seen, gone = set(), set()
    for d, t in enumerate(texts):
        own = t.split("\n") if t else []
        spans = [(a, b) for a, b in boundaries(own) if sum(bool(x.split()) for x in own[a:b]) >= 2]
        whole = len(own) > 1 and (spans or len(t.split()) >= 50 and any(runs([t, t])))
        for kind, a, b in [*(("chunk", a, b) for a, b in spans), *([("whole", 0, len(own))] if whole else [])]:
            if (key := (kind, *own[a:b])) in seen:
                gone |= {(d, k) for k in range(a, b)}
            seen.add(key)
    return gone


def plain_dedup(rows):
    """rows (id, text) in order of the id; what is left of each."""
    texts = [t or "" for _, t in rows]
    gone = runs(texts) | by_chunks(texts)
    return {d: t and "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, (d, t) in enumerate(rows)}


def test_runs_go_exactly(spark):
    passages = [[line(n) for _ in range(k)] for k, n in ((3, 20), (4, 15), (5, 12), (6, 10), (10, 24), (5, 11), (9, 6)) for _ in range(4)]
    passages += [["one two three", line(24), line(24), "", line(3)], [line(24), line(24)]]  # the last has 48 words
    texts = []
    for p in passages:
        for _ in range(3):
            before, after = ([line(R.randint(3, 20)) for _ in range(R.randint(1, 5))] for _ in range(2))
            texts.append("\n".join(before + p + after))
    chunked = by_chunks(texts)
    assert len(runs(texts) | chunked) > len(chunked)  # what boundaries alone don't find
    assert all(line_dedup.chunks(t.split("\n"))[k][:2] == x for t in texts for k, x in enumerate(boundaries(t.split("\n"))))
    got = {r.row.doc_id: r.text for r in line_dedup.line_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    assert got == plain_dedup(list(enumerate(texts)))

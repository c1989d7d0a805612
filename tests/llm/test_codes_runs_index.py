"""Operators 11 to 13 against brute force and SQL, on awkward rows too."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelight.llm import decontamination, periodic_runs, queries, vector_codes

R = random.Random(5)


def brute_runs(c):
    out = {}
    for p in range(1, len(c) // 4 + 1):
        i = 0
        while i + p < len(c):
            if c[i] != c[i + p]:
                i += 1
                continue
            s = i
            while i + p < len(c) and c[i] == c[i + p]:
                i += 1
            if i + p - s >= max(6, 4 * p):
                out.setdefault((s, i + p), p)
    return sorted(((s, e - s, p) for (s, e), p in out.items()), key=lambda r: (r[0], r[2]))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def collapsed(w, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def periodic_texts():
    out = []
    for _ in range(300):
        n, k = R.choice([0, 1, 5, 6, 7, 20, 60, 150]), R.choice([1, 2, 3, 50])
        c = [R.randrange(k) for _ in range(n)]
        for _ in range(R.randint(0, 3) if n else 0):
            a, p = R.randrange(n), R.randint(1, max(1, n // 4))
            for i in range(a, R.randint(a, n)):
                c[i] = c[a + (i - a) % p]
        out.append(R.choice(["", " ", "\n"]) + R.choice([" ", "\t", " \n"]).join(f"w{x}" for x in c))
    return out


def test_runs_equal_brute_force():
    codes = [[int(x[1:]) for x in words(t)] for t in periodic_texts()]
    sizes = np.array([len(c) for c in codes])
    starts = np.cumsum(sizes) - sizes
    want = [(s + int(st), n, p) for c, st in zip(codes, starts, strict=True) for s, n, p in brute_runs(c)]
    got = periodic_runs.runs_of(np.array([x for c in codes for x in c]), starts, sizes)
    assert list(map(tuple, got.tolist())) == want
    assert len(want) > 50


def test_runs_when_hashes_agree(monkeypatch):
    """Words decide, though all stretches look equal to the hashes."""
    texts = periodic_texts()[:60]
    monkeypatch.setattr(periodic_runs.Prefixes, "equal", lambda self, i, p, n: np.ones(len(i), bool))
    for t in texts:
        c = [int(x[1:]) for x in words(t)]
        got = periodic_runs.runs_of(np.array(c, np.int64), np.array([0]), np.array([len(c)]))
        assert set(map(tuple, got.tolist())) == set(brute_runs(c))


def test_runs_of_awkward_rows(spark, docs, edge_rows, empty):
    got = periodic_runs.periodic_runs(docs).collect()
    want = []
    for r in edge_rows:
        w = words(r[1])
        runs = brute_runs(w) if len(w) < 3500 else [(0, len(w), 1)] if len(set(w)) == 1 else []
        want.append((r[0], len(w), runs, collapsed(w, runs)))
    shown = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got]
    assert sorted(map(repr, shown)) == sorted(map(repr, want))
    assert periodic_runs.periodic_runs(empty).count() == 0


def test_op11_equals_brute_force(spark, sf):
    got = {r.doc_id: tuple(r)[1:] for r in periodic_runs.op11_periodic_runs(spark, sf).collect()}
    planted = 0
    for doc_id, text in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        w = words(text)
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            planted += 1
        runs = brute_runs(w)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join("%d,%d,%d\n" % r for r in runs), collapsed(w, runs))]
        assert got[doc_id] == (len(runs), *first, *sha), doc_id
    assert planted > 5


def test_planted_rows_without_words(spark):
    rows = [(i, t) for i in range(40) for t in (None, "", " \t", "one")] + [(None, "a b"), (None, None)]
    got = spark.createDataFrame(rows, "d long, t string").select("t", periodic_runs.planted(F.col("d"), F.col("t")).alias("p")).collect()
    assert all(words(r.p) == words(r.t) for r in got)


def brute_codes(rows, parts=4, entries=256, rounds=4):
    """rows: (id, label, vector) in order of ids."""
    x = [(i, lab, [math.floor(1024 * a) for a in v]) for i, lab, v in rows]
    w = len(x[0][2]) // parts
    cut = lambda v, m: v[m * w : (m + 1) * w]
    books = [[cut(v, m) for i, _, v in x if i is not None][:entries] for m in range(parts)]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    for k in range(rounds + 1):
        near = [[min((far(cut(v, m), e), j) for j, e in enumerate(books[m])) for m in range(parts)] for _, _, v in x]
        for m in range(parts if k < rounds else 0):
            for j in range(len(books[m])):
                own = [cut(v, m) for (_, _, v), n in zip(x, near, strict=True) if n[m][1] == j]
                if own:
                    books[m][j] = [math.floor(sum(c) / len(own)) for c in zip(*own, strict=True)]
    return [(i, lab, bytes(j for _, j in n).hex(), [d for d, _ in n]) for (i, lab, _), n in zip(x, near, strict=True)], books


@pytest.mark.parametrize("entries", [3, 7, 256])
def test_codes_equal_brute_force(spark, entries):
    good = [(i, R.choice([1, 2, None]), [R.uniform(-1, 1) for _ in range(8)]) for i in range(60)]
    good += [(60, 1, good[3][2]), (61, None, [0.0] * 8), (None, 2, [0.5] * 8)]
    bad = [(70, 1, None), (71, 1, []), (72, 1, [float("nan")] * 8), (73, 1, [1.0, None, *[0.0] * 6]), (74, 1, [float("inf"), *[0.0] * 7]), (75, 1, [1.0] * 7)]
    df = spark.createDataFrame([(*r, 9, "x") for r in good + bad], "vec_id long, label int, embedding array<double>, id int, code string").repartition(5)
    got = vector_codes.compress(df, entries=entries)
    want, books = brute_codes(good, entries=entries)
    assert sorted(((r.id, r.label, r.code.hex(), list(r.errors)) for r in got.rows.collect()), key=repr) == sorted(want, key=repr)
    assert got.books.tolist() == books
    again = vector_codes.compress(df.repartition(1), entries=entries)
    assert again.digest == got.digest


def test_codes_of_awkward_tables(spark):
    schema = "vec_id long, label int, embedding array<float>"
    assert vector_codes.compress(spark.createDataFrame([], schema)).rows.count() == 0
    assert vector_codes.compress(spark.createDataFrame([(1, 1, None)], schema)).rows.count() == 0
    same = vector_codes.compress(spark.createDataFrame([(1, 1, [0.5] * 6)] * 4 + [(2, None, [1e30] * 6)], schema))  # filled up to eight
    assert [r.code.hex() for r in same.rows.orderBy("id").collect()] == ["00000000"] * 4 + ["04040404"[:6] + "00"]
    assert same.books.shape == (4, 5, 2)
    nameless = vector_codes.compress(spark.createDataFrame([(None, 1, [0.5] * 4), (None, 1, [0.25] * 4)], schema))
    assert sorted(r.code.hex() for r in nameless.rows.collect()) == ["00000000", "01010101"]


def w13(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_hits(docs, items, slack=0, counts=None):
    out = []
    windows = {}
    for item, text in items:
        w = w13(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(item)
    for doc_id, text in docs:
        w = w13(text)
        hit, named = set(), set()
        for win, of in windows.items():
            n = len(win)
            if slack == 0:
                starts = [i for i in range(len(w) - n + 1) if tuple(w[i : i + n]) == win]
            else:
                at = min(range(n), key=lambda j: (counts.get(win[j], 0), j))
                first = [i - at for i, x in enumerate(w) if x == win[at]]
                starts = [s for s in first if all(any(0 <= k < len(w) and w[k] == x for k in range(s + j - slack, s + j + slack + 1)) for j, x in enumerate(win))]
            for s in starts:
                hit |= {k for k in range(s, s + n) if 0 <= k < len(w)}
                named |= {str(i) for i in of if i is not None}
        out.append((doc_id, len(w), len(hit), sorted(named)))
    return out


def phrases_and_texts():
    vocab = ["the", "of", "and", *(f"w{i}" for i in range(12)), "Été", "été", "ÀB", "x1"]
    say = lambda n: [R.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(say(R.choice([1, 2, 9, 10, 11, 14])))) for i in range(14)]
    items += [(3, items[0][1]), (20, items[1][1]), (None, " ".join(say(12))), (21, None), (22, ""), (23, " -- !"), (24, "the"), (25, "Zz the")]
    texts = []
    for k in range(60):
        w = say(R.randint(0, 40))
        for _ in range(R.randint(0, 2)):
            own = w13(R.choice(items)[1])
            if k % 3 == 0 and len(own) > 3:  # in another order, or with a word between
                j = R.randrange(len(own) - 1)
                own[j : j + 2] = R.choice([[own[j + 1], own[j]], [own[j], "zzz", own[j + 1]]])
            at = R.randint(0, len(w))
            w[at:at] = own
        texts.append(R.choice([" ", ", ", "\n-"]).join(x.upper() if R.random() < 0.1 and x.isascii() else x for x in w))
    return items, texts


@pytest.mark.parametrize("slack", [0, 1, 2])
def test_matches_equal_brute_force(spark, slack):
    items, texts = phrases_and_texts()
    docs = list(enumerate(texts)) + [(None, texts[1]), (2, texts[2]), (2, texts[3]), (900, None), (901, ""), (902, "x" * 100_000)]
    df = spark.createDataFrame([(i, t, 1, "w", 0) for i, t in docs], "doc_id long, text string, row int, words string, start int").repartition(3)
    tests = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, phrase int").repartition(2)
    got = [(r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in decontamination.decontaminate(df, tests, slack=slack).collect()]
    counts = {}
    for _, t in docs:
        for x in w13(t):
            counts[x] = counts.get(x, 0) + 1
    want = brute_hits(docs, items, slack, counts)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(r[2] > 0 for r in want) > 10


def test_index_of_awkward_tables(spark, docs, edge_rows, empty):
    items = spark.createDataFrame([(1, edge_rows[0][1])], "item_id long, text string")
    got = {(r.doc_id, r.n_words): r.n_hit for r in decontamination.decontaminate(docs, items).collect()}
    assert got[0, len(w13(edge_rows[0][1]))] == len(w13(edge_rows[0][1]))
    assert decontamination.decontaminate(empty, items).count() == 0
    none = decontamination.decontaminate(docs, items.limit(0)).agg(F.sum("n_hit"), F.count("*")).first()
    assert tuple(none) == (0, len(edge_rows))


def test_index_of_all_terms(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, "b")], "doc_id long, text string")
    index = decontamination.build_index(df)
    assert sorted(tuple(r) for r in index.postings.groupBy("term").count().collect()) == [("a", 2), ("b", 2)]


def test_linked_vectors_link(spark, sf):
    """The derived table has chains: more components than none, links that end at the limit, and ends that don't link themselves."""
    got = queries.QUERIES["linked_dedup"](spark, sf).collect()
    sizes = {}
    for r in got:
        sizes.setdefault(r.component_id, []).append(r.n_links)
    assert sum(len(n) == 3 for n in sizes.values()) > 50 and any(len(n) < 3 for n in sizes.values())
    assert any(sorted(n) == [1, 1, 2] for n in sizes.values()) and any(n == [2, 2, 2] for n in sizes.values())


@pytest.mark.parametrize("name", ["op12_vector_codes", "op13_benchmark_index", "linked_dedup", "op6_subspace_dedup"])
def test_query_equals_sql(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    got = queries.QUERIES[name](spark, sf)
    want = c.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(r) for r in got.select(*names).collect()) == sorted(want.fetchall())

"""Jaccard join, embedding dedup and components against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelight.llm import embedding_dedup, jaccard_join
from sievelight.llm.components import components
from sievelight.llm.scratch import Scratch

UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    w = (text or "").encode().translate(UPPER).split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def groups(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def brute(rows, width, num, den):
    """(n_shingles, component id, links) of each row (id, text)."""
    sets = [shingles(t, width) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    root = groups(len(rows), links)
    least = {}
    for i, r in enumerate(root):
        least[r] = min([x for x in (least.get(r), rows[i][0]) if x is not None], default=None)
    return [(len(s), least[root[i]], sum(i in x for x in links)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("settings", [{}, {"GROUP_SETS": 2, "BUCKET_TOKENS": 100, "PACK_TOKENS": 50, "SALTS": 3}, {"GROUP_TOKENS": 500}])
def test_jaccard_join(docs, edge_rows, monkeypatch, settings):
    for k, v in settings.items():
        monkeypatch.setattr(jaccard_join, k, v)
    rows = [(r[0], r[1]) for r in edge_rows]
    width, num, den = (3, 90, 100) if settings.get("SALTS") else (5, 80, 100)
    want = sorted((-1 if r[0] is None else r[0], *x[:1], -1 if x[1] is None else x[1], x[2]) for r, x in zip(rows, brute(rows, width, num, den), strict=True))
    got = jaccard_join.jaccard_join(docs, width=width, num=num, den=den).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id, r.n_links) for r in got) == want


def test_jaccard_join_of_nothing(empty):
    assert jaccard_join.jaccard_join(empty).count() == 0


def test_overlaps_are_exact():
    r = random.Random(5)
    base = [sorted(r.sample(range(400), 60)) for _ in range(6)]
    sets = [np.array(sorted(set(b) - set(r.sample(b, k % 5)) | set(r.sample(range(400, 900), k % 4))), np.uint64) for k in range(60) for b in [base[k % 6]]]
    found = {tuple(sorted((x, int(y)))) for x, ys in jaccard_join.overlaps_join(sets, None, 9, 10) for y in ys}
    want = {(i, j) for j in range(60) for i in range(j) if 10 * len(set(sets[i]) & set(sets[j])) >= 9 * len(set(sets[i]) | set(sets[j]))}
    assert found == want and want
    sides = np.arange(60) % 2
    across = {tuple(sorted((x, int(y)))) for x, ys in jaccard_join.overlaps_join(sets, sides, 9, 10) for y in ys}
    assert across == {p for p in want if sides[p[0]] != sides[p[1]]}


def test_components(spark):
    r = random.Random(2)
    links = [(r.randint(0, 150), r.randint(0, 150)) for _ in range(90)] + [(1000, i) for i in range(1001, 1060)] + [(i, i + 1) for i in range(2000, 2040)] + [(None, 3), (7, 7)]
    got = {x.node: x.component for x in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t")).collect()}
    nodes = sorted({x for p in links for x in p if x is not None})
    at = {n: i for i, n in enumerate(nodes)}
    root = groups(len(nodes), [(at[a], at[b]) for a, b in links if a is not None])
    linked = {x for a, b in links if a is not None and a != b for x in (a, b)}
    assert got == {n: nodes[root[at[n]]] for n in linked}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def vectors():
    r = np.random.default_rng(4)
    rows = []
    for c in range(8):
        centre = r.standard_normal(16)
        for _ in range(9):
            rows.append((len(rows), (centre + r.standard_normal(16) * 0.09 * (c + 1) / 2).astype(np.float32).tolist(), c % 3))
    rows += [(len(rows) + i, rows[i][1], rows[i][2]) for i in range(4)]  # equal vectors
    rows += [(200, [2 * x for x in rows[0][1]], 0), (201, rows[0][1], None), (202, None, 0), (203, [0.0] * 16, 0), (204, [None] + [1.0] * 15, 0), (205, [float("nan")] * 16, 0), (206, rows[0][1][:8], 0), (207, [], 0), (208, [1e30] * 16, 0), (209, [1e38] * 16, 0)]
    return rows


def test_embedding_dedup_of_many_vectors_of_a_label(spark):
    r = np.random.default_rng(8)
    centres = r.standard_normal((400, 64))
    spread = r.uniform(0.15, 0.35, 400)
    x = [*(centres[i % 400] + r.standard_normal(64) * spread[i % 400] for i in range(4000)), *r.standard_normal((6000, 64))]
    x = np.array(x, np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = [np.flatnonzero(unit[i] @ unit.T >= 0.93) for i in range(len(x))]
    root = groups(len(x), [(i, int(j)) for i, own in enumerate(near) for j in own if j < i])
    assert sum(map(len, near)) > len(x) + 5000 and embedding_dedup.CELL_ROWS * 3 < len(x)  # many links, cells in chunks
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>, label int").repartition(4)
    got = {g.vec_id: (g.n_links, g.component_id) for g in embedding_dedup.embedding_dedup(df).collect()}
    assert got == {i: (len(near[i]) - 1, root[i]) for i in range(len(x))}


@pytest.mark.parametrize("settings", [{}, {"GRID": (0, 0), "CELL_ROWS": 3}])
def test_embedding_dedup(spark, monkeypatch, settings):
    for k, v in settings.items():
        monkeypatch.setattr(embedding_dedup, k, v)
    rows = vectors()
    full = rows + [rows[0], (None, rows[5][1], rows[5][2])]

    def linked(a, b):
        x, y = a[1], b[1]
        if a[2] is None or a[2] != b[2] or not x or not y or len(x) != len(y) or None in x or None in y:
            return False
        x, y = np.array(x, np.float32).astype(float), np.array(y, np.float32).astype(float)
        if not (np.isfinite(x).all() and np.isfinite(y).all() and x.any() and y.any()):
            return False
        return x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.93

    links = [(i, j) for i in range(len(full)) for j in range(i) if linked(full[i], full[j])]
    root = groups(len(full), links)
    least = {}
    for i, r in enumerate(root):
        least[r] = min(x for x in (least.get(r), full[i][0]) if x is not None)
    want = sorted((-1 if r[0] is None else r[0], sum(i in x for x in links), least[root[i]]) for i, r in enumerate(full))
    df = spark.createDataFrame(full, "vec_id long, embedding array<float>, label int").withColumn("key", F.lit("x")).withColumn("raw", F.lit(1))
    got = embedding_dedup.embedding_dedup(df).collect()
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert embedding_dedup.embedding_dedup(df.limit(0)).count() == 0


def test_embedding_dedup_sends_a_vector_once_a_chunk(spark, monkeypatch):
    """Blocks are compared inside a task: a label's vectors aren't sent once for each block and cell."""
    sizes, table = {}, embedding_dedup.Scratch.table

    def kept(self, df, name):
        out = table(self, df, name)
        sizes[name] = out.count() if name == "cells" else None
        return out

    monkeypatch.setattr(embedding_dedup.Scratch, "table", kept)
    x = np.random.default_rng(3).standard_normal((50, 64)).tolist()
    df = spark.createDataFrame([(i, v, i % 2) for i, v in enumerate([*x, *x])], "vec_id long, embedding array<double>, label int")
    got = embedding_dedup.embedding_dedup(df).collect()
    assert sizes["cells"] == 50 and sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(i, 1, i % 50) for i in range(100)]


def test_embedding_dedup_decides_pairs_at_the_limit_exactly(spark, monkeypatch):
    """A vector is sent in two bytes a component and lies on disk once; cosines within its rounding of the limit are decided by the exact vectors."""
    kept, table = {}, embedding_dedup.Scratch.table

    def seen(self, df, name):
        out = table(self, df, name)
        kept[name] = sum(len(r.raw) for r in out.select("raw").collect()) if "raw" in out.columns else [tuple(r)[2:] for r in out.collect()] if name == "linked" else 0
        return out

    monkeypatch.setattr(embedding_dedup.Scratch, "table", seen)
    r, rows = np.random.default_rng(6), []
    for i in range(60):
        x, y = r.standard_normal((2, 64))
        x, y = x / np.sqrt(x @ x), y - y @ x * x / (x @ x)
        cos = 0.93 + [-1e-3, -1e-5, -1e-7, 1e-7, 1e-5, 1e-3][i % 6]
        rows += [(2 * i, x.tolist(), i), (2 * i + 1, (3 * (cos * x + np.sqrt(1 - cos**2) * y / np.sqrt(y @ y))).tolist(), i)]
    rows += [(200 + i, rows[6 + i][1], rows[6 + i][2]) for i in range(2)]  # copies of a pair at the limit
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    got = {g.vec_id: (g.n_links, g.component_id) for g in embedding_dedup.embedding_dedup(df).collect()}
    unit = np.array([np.array(v) / np.sqrt(np.dot(v, v)) for _, v, _ in rows])
    near = [[rows[j][0] for j in range(len(rows)) if rows[j][2] == rows[i][2] and unit[i] @ unit[j] >= 0.93] for i in range(len(rows))]
    assert got == {row[0]: (len(own) - 1, min(own)) for row, own in zip(rows, near, strict=True)}
    assert kept["rows"] == 0 and kept["cells"] == 120 * 64 * 2 and sum(not sure for _, sure in kept["linked"]) >= 30

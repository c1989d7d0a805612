import math

import pytest
from pyspark.sql import functions as F

from sievelight.operators import search, text_index, vector_index

CHUNKS = "chunk_id long, snapshot_id long, kind string, lang string, content string, meta string"


def chunks(spark, *texts, kinds=None):
    return spark.createDataFrame([(i + 1, 1, (kinds or ["a"] * len(texts))[i], "rust", t, '{"file":"f"}') for i, t in enumerate(texts)], CHUNKS)


def covers(positions: dict[str, list[int]]) -> float:
    """Cover density by enumeration: minimal spans that hold every token."""
    marks = sorted((p, t) for t, ps in positions.items() for p in ps)
    spans = set()
    for i in range(len(marks)):
        seen = set()
        for j in range(i, len(marks)):
            seen.add(marks[j][1])
            if len(seen) == len(positions):
                spans.add((i, j))
                break
    least = {(i, j) for i, j in spans if not any((a, b) != (i, j) and a >= i and b <= j for a, b in spans)}
    return sum(0.1 / (1 + (marks[j][0] - marks[i][0]) - (j - i)) for i, j in least)


def test_lexical_tie_goes_to_lower_id(spark):
    found = search.lexical_search(chunks(spark, "borrow checker error unsafe", "borrow checker", "something else"), "borrow checker", limit=2).collect()
    assert [(r.chunk_id, r["rank"]) for r in found] == [(1, 0.1), (2, 0.1)]


def test_cover_rank_against_enumeration(spark):
    import random

    r = random.Random(3)
    texts = [" ".join(r.choice("abcx") for _ in range(r.randint(1, 14))) for _ in range(60)]
    got = {x.chunk_id: x["rank"] for x in search.lexical_search(chunks(spark, *texts), "a b c", limit=100).collect()}
    for i, t in enumerate(texts):
        places = {w: [p for p, x in enumerate(t.split()) if x == w] for w in "abc"}
        if all(places.values()):
            assert math.isclose(got[i + 1], covers(places), abs_tol=1e-8)
        else:
            assert i + 1 not in got


def test_empty_query_and_kinds(spark):
    c = chunks(spark, "a b", "a b", kinds=["x", "y"])
    assert search.lexical_search(c, "  ").count() == 0
    assert [r.chunk_id for r in search.lexical_search(c, "a", kinds=["y"]).collect()] == [2]
    with pytest.raises(TypeError):
        search.kind_filter(c, "x")


def test_prebuilt_postings(spark):
    c = chunks(spark, "a b", "b a c")
    posts = search.postings(c)
    assert [r.chunk_id for r in search.lexical_search(c, "a b", posts=posts).collect()] == [1, 2]


def test_stored_index(spark, tmp_path):
    import random

    r = random.Random(5)
    c = chunks(spark, *(" ".join(r.choice(["a", "b", "c", "x", "Ünsafe"]) for _ in range(r.randint(1, 20))) for _ in range(80)), kinds=["k", "l"] * 40)
    text_index.build(c, str(tmp_path / "index"))
    for q, kinds in (("a b", None), ("c", ["l"]), ("ünsafe a", ["k"]), ("b nowhere", None), ("", None)):
        want = [tuple(x) for x in search.lexical_search(c, q, snapshot_id=1, kinds=kinds, limit=9).collect()]
        assert [tuple(x) for x in search.lexical_search(c, q, snapshot_id=1, kinds=kinds, limit=9, index=str(tmp_path / "index")).collect()] == want
    assert search.lexical_search(c, "a", snapshot_id=2, index=str(tmp_path / "index")).count() == 0


def test_vector_search_zero_and_cap(spark):
    v = spark.createDataFrame([(1, 1, "m", [1.0, 0.0]), (2, 1, "m", [0.0, 0.0]), (3, 2, "m", [1.0, 1.0]), (4, 1, "n", [1.0, 0.0]), (5, 1, "m", [1.0])], "chunk_id long, snapshot_id long, model_id string, embedding array<float>")
    got = search.vector_search(v, [1.0, 0.0], snapshot_id=1).collect()
    assert [r.chunk_id for r in got] == [1, 4, 2] and math.isnan(got[-1].dist)
    assert [r.chunk_id for r in search.vector_search(v, [1.0, 0.0], model_id="m", max_dist=0.5).collect()] == [1, 3]


def test_rrf_formula(spark):
    lex = spark.createDataFrame([(10, 1), (20, 2), (20, 5)], "chunk_id long, rank int")
    vec = spark.createDataFrame([(10, 3), (30, 1)], "chunk_id long, rank int")
    got = {r.chunk_id: r for r in search.rrf(lex, vec).collect()}
    assert math.isclose(got[10].rrf, 0.5 / 61 + 0.5 / 63, rel_tol=1e-12)
    assert math.isclose(got[20].rrf, 0.5 / 62, rel_tol=1e-12) and got[20].vector_rank is None
    assert math.isclose(got[30].rrf, 0.5 / 61, rel_tol=1e-12) and got[30].lexical_rank is None


def test_hybrid_excerpt_and_risk(spark):
    rows = [(1, 1, "k", "r", "a " * 300, '{"file":"f","risk_tags":["unsafe"," raw_ptr","unsafe"]}'), (2, 1, "k", "r", "b", '{"file":"f"}')]
    c = spark.createDataFrame(rows, CHUNKS)
    v = spark.createDataFrame([(1, 1, "m", [1.0, 0.0]), (2, 1, "m", [0.0, 1.0])], "chunk_id long, snapshot_id long, model_id string, embedding array<float>")
    got = search.hybrid_retrieve(c, v, "a", [1.0, 0.0], snapshot_id=1).collect()
    assert [r.chunk_id for r in got] == [1, 2] and len(got[0].excerpt) == 200 and got[0].risk_score == 9 and got[1].risk_score == 0


def test_prioritize_reverses_ties(spark):
    items = spark.createDataFrame([(0, "code", 1), (1, "code", 1), (2, "rule", 9)], "idx int, evidence_type string, risk_score int")
    assert [r.idx for r in search.prioritize(items).collect()] == [1, 0, 2]


def test_top_k_plan_takes_ordered(spark, sf):
    from sievelight.plans import views

    plan = search.vector_search(views.vectors(spark, sf), [0.1] * 64, limit=5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "label" not in plan.split("ReadSchema")[1]
    assert F.col("x") is not None


WORDS = ["a", "b", "c", "x", "y", "Ünsafe", "z"]


def said(r, most=20):
    return " ".join(r.choice(WORDS) for _ in range(r.randint(0, most)))


def test_index_follows_any_changes(spark, tmp_path):
    """After each of many changes, merges among them, the index finds what a scan of the chunks finds."""
    import random

    r, path = random.Random(7), str(tmp_path / "i")
    now = {i: said(r) for i in range(40)}
    frame = lambda d: spark.createDataFrame([(i, 1 + i % 2, "k", "l", t, "{}") for i, t in d.items()], CHUNKS)
    text_index.build(frame(now), path)
    for round_ in range(4):
        gone = r.sample(sorted(now), 6)
        new = {i: said(r) for i in [*r.sample(sorted(now), 5), 100 + round_, *gone[:2]]}  # two of the removed come again
        text_index.apply_changes(path, frame(new), spark.createDataFrame([(i,) for i in gone], "chunk_id long"))
        now = {i: t for i, t in now.items() if i not in gone} | new
        if round_ == 2:
            text_index.merge(spark, path)
            assert text_index.state(spark, path).segments == (0,)
        for q, snapshot in (("a b", None), ("c", 1), ("ünsafe a x", None)):
            want = [tuple(x) for x in search.lexical_search(frame(now), q, snapshot_id=snapshot, limit=12).collect()]
            assert [tuple(x) for x in text_index.search(spark, path, q, snapshot_id=snapshot, limit=12).rows.collect()] == want, (round_, q)


def test_tokens_travel_as_pieces_of_blocks(spark, monkeypatch):
    """What is shuffled is a row for each token of a range of chunks, not for each place; pieces in any cut make whole blocks."""
    import random

    import pyarrow as pa

    r = random.Random(6)
    c = chunks(spark, *(said(r) for _ in range(64)), *[None, ""]).coalesce(1)
    kinds = {(x.snapshot_id, w) for x in c.collect() for w in (x.content or "").lower().split()}
    assert text_index._pieces(c).count() == len(kinds)  # one range, one task
    monkeypatch.setattr(text_index, "TOKENS_AT_ONCE", 5)
    rows = [(r.choice([1, 2, None]), i - 20, [r.choice("abc") for _ in range(r.randint(0, 7))] or None) for i in range(60)]
    batches = [pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[k : k + 20], strict=True), (pa.int64(), pa.int64(), pa.list_(pa.string())), strict=True)], names=["s", "c", "t"]) for k in (40, 0, 20)]
    pieces = [x | {"part": 0} for b in text_index._as_pieces(16)(batches) for x in b.to_pylist()]
    pieces.sort(key=lambda x: (x["tok"], x["snapshot_id"] or 0, x["span"]))
    cut = [pa.RecordBatch.from_pylist(pieces[k : k + 7]) for k in range(0, len(pieces), 7)]
    got = [x for b in text_index._as_blocks(16)(cut) for x in b.to_pylist()]
    assert len({(x["snapshot_id"], x["tok"], x["span"]) for x in got}) == len(got) < len(pieces)
    assert all(x["most"] == max(sum(h["chunk_id"] == g["chunk_id"] for h in x["hits"]) for g in x["hits"]) for x in got)
    want = sorted(((s or 0, w, i // 16, i, p + 1) for s, i, t in rows for p, w in enumerate(t or [])), key=str)
    assert sorted(((x["snapshot_id"] or 0, x["tok"], x["span"], h["chunk_id"], h["pos"]) for x in got for h in x["hits"]), key=str) == want
    assert all(x["hits"] == sorted(x["hits"], key=lambda h: (h["chunk_id"], h["pos"])) for x in got)


def test_failed_change_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "i")
    text_index.build(chunks(spark, "a b", "a c"), path)
    bad = chunks(spark, "a a a").withColumn("content", F.raise_error(F.lit("stop")).cast("string"))
    with pytest.raises(Exception, match="stop"):
        text_index.apply_changes(path, bad)
    assert [r.chunk_id for r in text_index.search(spark, path, "a").rows.collect()] == [1, 2]
    (tmp_path / "i" / "generation=0" / "postings" / "segment=1").mkdir(parents=True, exist_ok=True)  # a half-written one
    text_index.apply_changes(path, chunks(spark, "b").limit(0), chunks(spark, "x").select("chunk_id"))
    assert [r.chunk_id for r in text_index.search(spark, path, "a").rows.collect()] == [2]


def test_deleted_chunks_of_a_stale_index(spark, tmp_path):
    c = chunks(spark, "a b", "a c")
    text_index.build(c, str(tmp_path / "i"))
    assert [r.chunk_id for r in search.lexical_search(c.filter("chunk_id > 1"), "a", index=str(tmp_path / "i")).collect()] == [2]


@pytest.mark.parametrize("limit", [1, 3, 1000])
def test_hopeless_blocks_are_not_read(spark, tmp_path, monkeypatch, limit):
    import random

    monkeypatch.setattr(text_index, "SPAN", 4)
    r = random.Random(limit)
    texts = [" ".join([*(r.choice("xyz") for _ in range(10)), *["a b"] * (30 if i in (17, 90) else r.randint(0, 2))]) for i in range(160)]
    c = chunks(spark, *texts)
    text_index.build(c, str(tmp_path / "i"))
    for q in ("a b", "a", "a b x"):
        got = text_index.search(spark, str(tmp_path / "i"), q, limit=limit, first=3, whole=3, short=0)
        assert [tuple(x) for x in got.rows.collect()] == [tuple(x) for x in search.lexical_search(c, q, limit=limit).collect()]
        assert got.ranges > 30
        if limit == 1 and "x" not in q:  # two chunks have thirty places and the others two at most
            assert got.ranges_read <= 2
        if limit == 1000:
            assert got.ranges_read == got.ranges
        monkeypatch.setattr(text_index, "LISTED", 5)  # more ranges than are listed: they are joined
        many = text_index.search(spark, str(tmp_path / "i"), q, limit=limit, first=3, whole=3, short=0)
        assert (many.ranges, many.ranges_read, [tuple(x) for x in many.rows.collect()]) == (got.ranges, got.ranges_read, [tuple(x) for x in got.rows.collect()])
        monkeypatch.setattr(text_index, "LISTED", 5000)


def test_bound_holds(spark):
    """No rank is over the bound of its chunk's own counts, and one comes near it."""
    import random

    r = random.Random(2)
    for m in (1, 2, 3, 4):
        tight = 0
        for _ in range(400):
            t = [r.choice("abcdefg"[: m + r.randint(0, 1)]) for _ in range(r.randint(1, 24))]
            places = {w: [p for p, x in enumerate(t) if x == w] for w in "abcd"[:m]}
            if all(places.values()):
                bound = 0.1 * m * min(map(len, places.values()))
                assert covers(places) <= bound + 1e-9
                tight = max(tight, covers(places) / bound)
        assert tight > 0.5


def test_many_queries_at_once(spark, tmp_path):
    import random

    r = random.Random(11)
    c = chunks(spark, *(said(r) for _ in range(60)))
    text_index.build(c, str(tmp_path / "i"))
    asked = ["a b", "ünsafe", "c a x y", "nowhere a", "", None, "a a b"]
    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, text string")
    got = sorted(tuple(x) for x in text_index.search_all(spark, str(tmp_path / "i"), q, limit=7).collect())
    assert got == sorted((i, x.chunk_id, x["rank"]) for i, t in enumerate(asked) for x in search.lexical_search(c, t or "", limit=7).collect())


def vectors_around(spark, n, dim=16, groups=12):
    import random

    r = random.Random(4)
    middle = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(groups)]
    rows = [(i, i % 3, "m", [m + r.gauss(0, 0.5) for m in middle[i % groups]]) for i in range(n)]
    rows += [(n, 1, "m", [0.0] * dim), (n + 1, 1, "m", None), (n + 2, 1, "m", [float("nan")] * dim), (n + 3, 1, "m", [1.0])]
    return spark.createDataFrame(rows, "chunk_id long, snapshot_id long, model_id string, embedding array<float>"), rows


def test_inverted_lists(spark, tmp_path):
    v, rows = vectors_around(spark, 900)
    path = str(tmp_path / "v")
    vector_index.build(v, path, lists=16)
    q = rows[5][3]
    exact = [tuple(x) for x in search.vector_search(v, q, limit=20).filter("not isnan(dist)").collect()]
    assert [tuple(x) for x in vector_index.search(spark, path, q, probes=16, limit=20).collect()] == exact
    few = vector_index.search(spark, path, q, probes=2, limit=20, snapshot_id=2, model_id="m", max_dist=0.9)
    assert {x.chunk_id % 3 for x in few.collect()} == {2}
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in plan.replace("isnotnull(list", "list").replace("[list#", "[list#") and "TakeOrderedAndProject" in plan
    asked = v.filter("chunk_id % 30 = 0 and chunk_id < 900").select(F.col("chunk_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("vector"))
    probes = vector_index.enough_probes(spark, path, asked)
    assert probes < 16 and vector_index.recall(spark, path, asked, probes=probes) >= 0.9
    want = [(x.query_id, y.chunk_id, y.dist) for x in asked.collect() for y in search.vector_search(v, x.vector, limit=10).collect()]
    assert sorted(tuple(x) for x in vector_index.search_all(spark, path, asked, probes=16, limit=10).collect()) == sorted(want)
    vector_index.add(path, spark.createDataFrame([(5000, 1, "m", [2 * x for x in q])], v.schema))
    assert {x.chunk_id for x in vector_index.search(spark, path, q, probes=1, limit=2).collect()} == {5, 5000}


def test_inverted_lists_of_awkward_tables(spark, tmp_path):
    v, _ = vectors_around(spark, 1)
    vector_index.build(v.filter("chunk_id = 2"), str(tmp_path / "none"))
    assert vector_index.search(spark, str(tmp_path / "none"), [1.0] * 16).count() == 0
    vector_index.build(v, str(tmp_path / "one"), lists=4)
    assert vector_index.search(spark, str(tmp_path / "one"), [1.0] * 16).count() == 1
    assert vector_index.search(spark, str(tmp_path / "one"), [0.0] * 16).count() == 0
    assert vector_index.search(spark, str(tmp_path / "one"), [1.0]).count() == 0


def test_sql_table_functions(spark):
    from sievelight.operators import sql_functions

    rows = [(1, 1, "k", "r", "a b c", '{"file":"f"}'), (2, 1, "l", "r", "b a", '{"file":"f"}'), (3, 2, "k", "r", "a x b", '{"file":"f"}'), (4, 1, "k", "r", None, '{"file":"f"}')]
    c = spark.createDataFrame(rows, CHUNKS)
    v = spark.createDataFrame([(1, 1, "m", [1.0, 0.0]), (2, 1, "m", [0.0, 0.0]), (3, 2, "n", [1.0, 1.0]), (4, 1, "m", [0.5])], "chunk_id long, snapshot_id long, model_id string, embedding array<float>")
    sql_functions.register(spark, c, v)
    told = lambda text: sorted(tuple(r) for r in spark.sql(text).collect())
    for q, snapshot, kinds, limit in (("a b", None, None, 9), ("A b", 1, ["k"], 9), ("", None, None, 9), ("a b", None, [], 1), ("b a c", 1, None, 9)):
        want = sorted(tuple(r) for r in search.lexical_search(c, q, snapshot_id=snapshot, kinds=kinds, limit=limit).collect())
        listed = "NULL" if kinds is None else "CAST(array() AS ARRAY<STRING>)" if not kinds else f"array('{kinds[0]}')"
        assert told(f"SELECT * FROM lexical_search({snapshot or 'NULL'}, '{q}', {listed}, {limit})") == want, q
    want = [tuple(r) for r in search.vector_search(v, [1.0, 0.0], max_dist=0.9).collect()]
    assert told("SELECT * FROM vector_search(NULL, NULL, array(1.0D, 0.0D), 0.9, 5)") == sorted(want)
    assert [r[0] for r in told("SELECT * FROM vector_search(1, 'm', array(1.0D, 0.0D), NULL, 5)")] == [1, 2]
    for kinds, listed in ((None, "NULL"), (["k"], "array('k')")):
        want = {r.chunk_id: (r.excerpt, r.lexical_rank, r.vector_rank, r.rrf) for r in search.hybrid_retrieve(c, v, "a b", [1.0, 0.0], kinds=kinds, top_k=3).collect()}
        got = spark.sql(f"SELECT * FROM hybrid_retrieve(NULL, 'a b', array(1.0D, 0.0D), {listed}, NULL, 3)")
        assert {r.chunk_id: (r.excerpt, r.lexical_rank, r.vector_rank, r.rrf) for r in got.collect()} == want
        assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    plan = spark.sql("SELECT * FROM lexical_search(1, 'a b', NULL, 5)")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan

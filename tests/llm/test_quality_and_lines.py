"""Quality rules, line dedup and sharding against plain Python."""

import re
import zlib
from collections import defaultdict

import numpy as np

from sievelight.llm import line_dedup, quality_rules, sharding
from test_line_runs import plain_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    places = defaultdict(list)
    for i in range(len(words) - 2):
        places[tuple(words[i : i + 3])].append(i)
    covered = {j for at in places.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n, rep = len(words), len(covered)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), rep, n < 50 or 100 * rep > 50 * n


def test_base_counts(docs, empty, edge_rows):
    got = quality_rules.quality_rules(docs).collect()
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted((tuple(r)[:7] for r in got), key=key) == sorted(((r[0], *base(r[1])) for r in edge_rows), key=key)
    assert all(not (r.base_failed and r.kept) for r in got)
    assert quality_rules.quality_rules(empty).count() == 0


def test_distance_is_jensen_shannon(spark):
    from pyspark.sql import functions as F

    p, q = np.array([0.5, 0.5, 0.0]), np.array([0.1, 0.3, 0.6])
    m = (p + q) / 2
    kl = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m, strict=True) if x)
    got = spark.createDataFrame([(p.tolist(), q.tolist())], "p array<double>, q array<double>").select(quality_rules.js_distance(F.col("p"), F.col("q"))).first()[0]
    assert abs(got - np.sqrt((kl(p) + kl(q)) / 2)) < 1e-12


def brute_verdicts(rows):
    """(doc_id, char distance, word distance, kept) of rows (doc_id, text, lang), by the rules as the module states them."""
    q = quality_rules

    def shares(counts, total):
        return [c / max(total, 1) for c in [*counts, total - sum(counts)]]

    def js(p, r):
        m = [(a + b) / 2 for a, b in zip(p, r, strict=True)]
        kl = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m, strict=True) if x > 0)
        return np.sqrt(max((kl(p) + kl(r)) / 2, 0))

    seen = []
    for d, text, lang in rows:
        n, chars, symbols, *_, failed = base(text)
        own = [len(re.findall(c, text or "")) for c in ("[A-Z]", "[0-9]", r"[.,;:!?'\"()\-]")]
        wide = min(len(re.findall(r"[^\x00-\x7F]", text or "")), chars - sum(own) - symbols)
        words = WORD.findall(text or "")
        common = [sum(w in (c, c.capitalize()) for w in words) for c in q.COMMON[lang]] if lang in q.COMMON else None
        seen.append((d, lang, n, chars, failed, shares([*own, symbols, wide], chars), common and shares(common, n)))
    refs = {}
    for lang in {s[1] for s in seen if s[1] is not None}:
        good = [s for s in seen if s[1] == lang and not s[4]]
        if good:
            middle = lambda k: [float(np.median([np.floor(s[k][i] * q.STEPS + 0.5) / q.STEPS for s in good])) for i in range(len(good[0][k]))]  # noqa: B023, E731
            whole = lambda v: [x / sum(v) for x in v] if sum(v) > 0 else None
            refs[lang] = (len(good), whole(middle(5)), whole(middle(6)) if good[0][6] else None)
    plain = lambda p: [x / max(1 - p[4], 1e-9) for i, x in enumerate(p) if i != 4]
    nearest = [plain(r[1]) for r in refs.values() if r[1] and r[0] >= 5]
    out = []
    for d, lang, n, chars, failed, c, w in seen:
        count, rc, rw = refs.get(lang) or (0, None, None)
        settled = bool(rc) and count >= 5
        own = js(c, rc) if rc and chars >= 100 else None
        ascii_chars = chars * (1 - c[4])
        near = min((js(plain(c), r) for r in nearest), default=None) if not settled and c[4] <= 0.5 and ascii_chars >= 100 else None
        word = js(w, rw) if rw and w and settled and n >= 50 else None
        over = lambda x, limit, size, slack=3.0: x is not None and x > limit + slack / np.sqrt(max(size, 1))
        far = over(own, 0.085, chars) if settled else over(near, 0.085, ascii_chars) and (own is None or over(own, 0.085, chars))
        both = [x for x in (own, near) if x is not None]
        out.append((d, min(both) if both else None, word, not failed and not far and not over(word, 0.15, n, 1.5)))
    return out


def test_verdicts_by_brute_force(spark, docs, edge_rows, sf):
    tables = [(docs, [(r[0], r[1], r[2]) for r in edge_rows])]
    real = spark.read.parquet(f"{sf}/documents.parquet")
    tables.append((real.repartition(7), [(r.doc_id, r.text, r.lang) for r in real.collect()]))
    shown = lambda rows: sorted((d is None, d or 0, *(-1 if x is None else round(float(x), 6) for x in (c, w)), k) for d, c, w, k in rows)
    for df, rows in tables:
        got = quality_rules.quality_rules(df).select("doc_id", "char_distance", "word_distance", "kept").collect()
        assert shown(map(tuple, got)) == shown(brute_verdicts(rows))


def test_verdicts(spark, sf):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in quality_rules.op3_quality_divergence(spark, sf).collect() if not r.base_failed]
    good = [r.kept for r in got if labels.get(r.doc_id) == 1]
    bad = [r.kept for r in got if labels.get(r.doc_id) == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_no_python_on_the_main_path(docs):
    plan = quality_rules.measures(docs, id_col="doc_id", text_col="text", lang_col="lang")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_chunks_follow_the_content():
    lines = [f"line number {i} with some words" for i in range(40)]
    cut = lambda own: {"\n".join(own[a:b]) for a, b, _ in line_dedup.chunks(own)}
    whole = cut(lines)
    moved = cut(["another", "beginning here", *lines])
    assert len(whole & moved) >= len(whole) - 2  # only the first chunks change
    spans = line_dedup.chunks(lines)
    assert [a for a, *_ in spans] == [0, *(b for _, b, _ in spans[:-1])] and spans[-1][1] == 40
    assert line_dedup.chunks(["w " * 60]) == [(0, 1, False)] and line_dedup.windows(["w " * 60]) == [(0, 1)] and not line_dedup.windows(["w " * 49])


def test_line_dedup(unique, docs, empty):
    want = plain_dedup(sorted((r.doc_id, r.text) for r in unique.select("doc_id", "text").collect()))
    got = {r.row.doc_id: r.text for r in line_dedup.line_dedup(unique).collect()}
    assert got == want and any(got[d] != t for d, t in want.items()) is False
    assert sum(1 for d, t in got.items() if t == "" and d is not None) >= 2
    every = line_dedup.line_dedup(docs)
    assert every.count() == docs.count()  # repeated and null ids: a row for each row
    assert line_dedup.line_dedup(empty).count() == 0


def test_passage_stays_once(unique):
    out = line_dedup.line_dedup(unique)
    texts = [r.text for r in unique.select("text").collect() if r.text and r.text.count("\n") == 4]
    inner = [set(t.split("\n")[1:-1]) for t in texts]
    shared = set.intersection(*[i for i in inner if any(i == j for j in inner if j is not i)][:2])
    left = [r.text for r in out.collect() if r.text]
    assert shared and all(sum(line in t.split("\n") for t in left) < 3 for line in shared)


def test_sharding(docs, empty, edge_rows):
    got = sharding.shard(docs, shards=5).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted((r[0] is None, r[0] or 0, len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in edge_rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(5))
    assert sharding.shard(empty).count() == 0


def test_placement_balances_and_splits_a_hot_group(spark):
    rows = [(i, "same text of a hot group" if i % 3 == 0 else f"text {i} " * (1 + i % 9)) for i in range(3000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=6).collect()
    sums = np.zeros((6, 3))
    for r in got:
        sums[r.shard] += (r.size, r.tokens, 1)
    assert (sums.max(axis=0) / sums.mean(axis=0) < 1.05).all()
    items = np.array([[8, 1, 1], [1, 8, 1], [1, 1, 8], [8, 1, 1], [1, 8, 1], [1, 1, 8]], float)
    assert sorted(sharding.place(items, 2).tolist()) == [0, 0, 0, 1, 1, 1]

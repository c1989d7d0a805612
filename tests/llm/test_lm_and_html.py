"""LM scoring and HTML extraction."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from sievelight.llm import html_extract, lm_scoring


def tokens(text):
    return [*(text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split(), b""]


def test_base_score(docs, empty, edge_rows):
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    counts = Counter(t for r in edge_rows if not held(r[0]) for t in tokens(r[1]))
    n, v = sum(counts.values()), len(counts)
    want = sorted((r[0] is None, r[0] or 0, held(r[0]), len(tokens(r[1])), sum(counts[t] > 0 for t in tokens(r[1])), n, round(sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens(r[1])), 6)) for r in edge_rows)
    got = lm_scoring.lm_score(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    same = {}
    for r in got:
        same.setdefault(r.doc_id, set()).add(round(r.score, 9))
    assert all(len(s) == 1 for s in same.values())
    assert lm_scoring.lm_score(empty).count() == 0


def fitted(words):
    tables = lm_scoring.count_tables(sorted(words))
    w, seen = lm_scoring.learn(sorted(words), tables)
    return tables, w, lm_scoring.refinement(seen)


def test_probabilities_of_bytes_sum_to_one():
    model = fitted([b"", b"the", b"then", b"a", b"an"])
    every = [b"th" + bytes([b]) for b in range(256)]
    bits = [(np.where(bit == 1, p, 1 - p), start) for bit, p, start in lm_scoring.bit_probabilities(every, *model)]
    third = [math.prod(q[start[i] + 2] for q, start in bits) for i in range(256)]
    assert abs(sum(third) - 1) < 1e-9
    lp = lm_scoring.spell(every, *model)
    assert np.allclose(lp, [sum(math.log10(q[start[i] + k]) for q, start in bits for k in range(4)) for i in range(256)])


def test_tables_count_what_followed():
    words = [b"ab", b"abc", b"b"]
    tables, want = lm_scoring.count_tables(words), Counter()
    for w in words:
        spelt = w + b" "
        for i, byte in enumerate(spelt):
            for k in range(8):
                want[(spelt[i - 1] if i else 0) << 8 | 1 << k | byte >> (8 - k), byte >> (7 - k) & 1] += 1
    got = {(int(s), v): int(tables[v, s]) for v in (0, 1) for s in np.flatnonzero(tables[v, : 1 << lm_scoring.TABLE_BITS[0]])}
    assert got == want and tables.sum() == 4 * sum(want.values())


def brute_scores(rows):
    """Each row's score, by counts of plain pairs and words; spelling and the probability of a case by the module's functions, tested apart."""
    lm = lm_scoring
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1 for d, _ in rows]
    texts = [tokens(t) for _, t in rows]
    place = lambda w: lm.xxhash.xxh3_64_intdigest(w) >> 44  # noqa: E731  the order among equally frequent tokens
    after = [list(zip([(-2, -1), (-1, t[0])][: len(t)] + list(zip(t, t[1:])), t, strict=False)) for t in texts]
    words, seen = Counter(), {}
    for h, t, pairs in zip(held, texts, after, strict=True):
        if not h:
            words.update(t)
            for c, w in pairs:
                seen.setdefault(c, Counter())[w] += 1

    def state(context, word, own):
        n = Counter(seen.get(context, {}))
        n[word] -= own
        total = sum(n.values())
        if not total:
            return 0
        most = max(n.values())
        best = [w for w, k in n.items() if k == most]
        hit = n[word] == most and (best == [word] if own else min(best, key=place) == word) if n[word] > 0 else False
        size = sum(total >= x for x in (1, 2, 3, 4, 8, 16, 64))
        return 2 * (1 + (size - 1) * 5 + min(4, 4 * most // total)) + hit

    cases = []
    for h, pairs in zip(held, after, strict=True):
        run, own = 0, []
        for c, w in pairs:
            s = state(c, w, int(not h))
            own.append(s // 2 * 12 + 2 * sum(run >= x for x in (1, 2, 4, 8, 16)) + s % 2)
            run = run + 1 if s % 2 else 0
        cases.append(own)
    met = Counter(k for h, own in zip(held, cases, strict=True) if not h for k in own)
    p = lm.case_probabilities(np.array([met[k] for k in range(lm.STATES * 12)]))
    known = sorted(words)
    tables = lm.count_tables(known).astype(np.float32)
    once = [w for w in known if words[w] == 1]
    new = sorted(once, key=lambda w: lm.xxhash.xxh3_64_intdigest(w, 2))
    w, adapted = lm.learn(new, tables)
    unknown = sorted({w for t in texts for w in t} - set(words))
    spelt = dict(zip(unknown, lm.spell(unknown, tables, w, lm.refinement(adapted)), strict=True))
    total = sum(words.values())
    escape = (len(once) + 0.5) / (total + 1)
    missed = lambda w: math.log10((1 - escape) * words[w] / total) if words[w] else math.log10(escape) + spelt[w]
    return [sum(p[k] + (0 if k % 2 else missed(w)) for k, w in zip(own, t, strict=True)) for own, t in zip(cases, texts, strict=True)]


def test_scores_by_brute_force(docs, edge_rows):
    rows = [(r[0], r[1]) for r in edge_rows]
    got = lm_scoring.lm_score(docs).collect()
    shown = lambda rows: sorted((d is None, d or 0, round(s, 4)) for d, s in rows)
    assert shown((r.doc_id, r.score) for r in got) == shown((d, s) for (d, _), s in zip(rows, brute_scores(rows), strict=True))


def test_scores_do_not_depend_on_partitions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    for n in (2, 16):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append({r.doc_id: r.score for r in lm_scoring.lm_score(docs.repartition(n)).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert found[0].keys() == found[1].keys() and all(abs(s - found[1][d]) < 1e-6 for d, s in found[0].items())


def test_states_of_contexts():
    key = np.array([(c << 20) + w for c, w in ((1, 5), (1, 7), (2, 5), (3, 1), (3, 2))], np.uint64)
    full, without = lm_scoring.contexts(key, np.array([3, 1, 1, 2, 2]))
    assert (full % 2).tolist() == [1, 0, 1, 1, 0] and (without % 2).tolist() == [1, 0, 0, 0, 0] and without[2] == 0


def test_blocks():
    page = "<p>a<b>b</p>  c &amp;&lt;<br>d<script>x<p>y</p></script><!-- no --><ul><li>e<li>f</ul><p>g<div>h</p>"
    assert [b[0] for b in html_extract.blocks(page)] == ["ab", "c &< d", "e", "f", "g", "h"]
    assert html_extract.blocks("") == [] and html_extract.blocks("no tags <")[0][0] == "no tags <"


def test_nothing_of_an_article_is_dropped():
    w, t = (x.tolist() for x in html_extract.model())
    start = "<article><p>The energy of a body at rest is "
    for inner, text in {"<math><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></math>": "E=mc2", "<object data=x>a picture</object>": "a picture", "<canvas>a drawing</canvas>": "a drawing", "<noscript>no script</noscript>": "no script"}.items():
        assert html_extract.main_text(f"{start}{inner}, as has long been known.</p></article>", w, t).replace(" ", "") == f"The energy of a body at rest is {text}, as has long been known.".replace(" ", "")
    headless = "<html><head><title>T</title><meta charset=utf-8><article><p>A page that leaves out the end of its head, and the body.</p></article>"
    assert html_extract.main_text(headless, w, t) == "A page that leaves out the end of its head, and the body."
    assert [b[0] for b in html_extract.blocks("<head><title>T</title>text at once<p>x")] == ["text at once", "x"]


@pytest.mark.parametrize(
    "page",
    [
        lambda n: "<div>a" * n, lambda n: "<div>a" * n + "</p>" * n, lambda n: "<b>" * n + "<div>x</div>" * n, lambda n: "<b><div>" * n + "</b>" * n, lambda n: "<li>a" * n, lambda n: "</div>" * n, lambda n: "<p>a<b>" * n,
        lambda n: "<a " * n + "'", lambda n: "<a " * n + '"', lambda n: "<p x='" * n + '"', lambda n: '<p x="' * n + "'", lambda n: "<p x=" * n, lambda n: "<p x=  " * n, lambda n: "<" * n, lambda n: "</ " * n, lambda n: "<!x " * n, lambda n: "<!-- " * n,
        lambda n: "<script>" + "</script " * n, lambda n: "<title>" + "</titl" * n, lambda n: "<a class='" + "id=" * n, lambda n: "<![CDATA[" * n, lambda n: "&amp" * n, lambda n: "<p " + "class " * n + ">x",
    ],
)
def test_time_is_linear_in_the_page(page):
    """Twice the page takes about twice the time; a quadratic step would take four times as long."""
    import time

    def took(text):
        best = float("inf")
        for _ in range(3):
            start = time.process_time()
            [html_extract.features(b) for b in html_extract.blocks(text)]
            best = min(best, time.process_time() - start)
        return best

    n = 2000
    while took(page(n)) < 0.02 and n < 200_000:
        n *= 2
    assert took(page(2 * n)) < 3.2 * took(page(n)) + 0.02


@pytest.mark.parametrize(("page", "texts"), [('<p>a</p><p x="b>c</p>', ["a"]), ("<p>a</p><p title='it>s'>b</p>", ["a", "b"]), ("<p>a</p><p don't>b</p>", ["a", "b"]), ("<p>a</p></ b>c", ["a", "c"]), ("<p>a<a href=x'y>b</a></p>", ["ab"])])
def test_quotes_as_in_browsers(page, texts):
    assert [b[0] for b in html_extract.blocks(page)] == texts


def test_viterbi_against_all_paths():
    import itertools
    import random

    r = random.Random(3)
    for _ in range(40):
        s = [r.uniform(-2, 2) for _ in range(6)]
        t = [[r.uniform(-1, 1) for _ in range(2)] for _ in range(2)]
        value = lambda y, s=s, t=t: sum(x for x, k in zip(s, y, strict=True) if k) + sum(t[a][b] for a, b in zip(y, y[1:], strict=False))
        assert abs(value(html_extract.viterbi(s, t)) - max(value(y) for y in itertools.product((0, 1), repeat=6))) < 1e-9


def test_extraction_of_held_out_pages():
    w, t = (x.tolist() for x in html_extract.model())
    pages = html_extract.training_pages(200, seed=77)
    right = sum(html_extract.main_text(p, w, t) == " ".join(k) for p, k in pages)
    assert right >= 0.8 * len(pages)


def test_extraction(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = html_extract.op8_crf_extraction(spark, sf).collect()
    assert len(got) == pages.count() and all(r.n_chars == len(r.text) for r in got)
    for r, p in zip(sorted(got), sorted(pages.collect()), strict=True):
        import html
        import re

        body = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        assert r.text == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", body)).split())


def test_extraction_of_odd_pages(spark):
    rows = [(1, "u", None, "x"), (1, "u", "", "x"), (None, None, "<nav><a href=x>Home</a></nav>", "x"), (3, "u", "<article><p>Long enough text of an article, with a stop.</article>" * 1, "x"), (4, "u", "<" * 2000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_extract.extract(df).collect()
    assert [(r.page_id, r.text) for r in got[:4]] == [(1, ""), (1, ""), (None, ""), (3, "Long enough text of an article, with a stop.")]
    assert got[4].page_id == 4 and got[4].text in ("", "<" * 2000)
    assert html_extract.extract(df.limit(0)).count() == 0


def test_known_words_are_decided_bit_by_bit(spark, sf):
    """Probabilities of classes and of the bits of hashes sum to one; held-out known words cost less than by their plain share; the query has these scores."""
    lm, r = lm_scoring, np.random.default_rng(3)
    p = 10 ** lm.class_probabilities(np.floor(r.pareto(1, lm.CLASSES**3)))[0]
    assert np.allclose(p.sum(axis=-1), 1)
    h, c = np.sort(r.integers(0, 1 << 63, 500, dtype=np.uint64)), np.ceil(r.pareto(1, 500)).astype(np.int64)  # one half: the first bit is none
    full, without = lm.path(h, c, c * (c > 1), np.ones(500, np.int64), 1, 64)
    assert abs((10**full).sum() - 1) < 1e-9 and (without <= full + 1e-3).mean() > 0.9
    again = lm.path(h[::2], c[::2] * 0 + 1, c[::2] * 0, np.ones(250, np.int64), 1, 64)[0]
    assert abs((10**again).sum() - 1) < 1e-9
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plain, mixed, moved = ({x.doc_id: x for x in lm.lm_score(d, mixed_words=m).collect()} for d, m in ((docs, False), (docs, True), (docs.repartition(7), True)))
    held = [d for d, x in plain.items() if x.held_out]
    assert sum(mixed[d].score for d in held) > sum(plain[d].score for d in held)
    assert any(abs(mixed[d].score - plain[d].score) > 1 for d in held) and all(abs(x.score - moved[d].score) < 1e-6 for d, x in mixed.items())
    assert all(abs(x.score - mixed[x.doc_id].score) < 1e-6 for x in lm.op7_context_mixing(spark, sf).collect())

"""The pipeline's stages, each against plain Python on what the one before kept."""

import re

import corpus_pipeline
import pytest

from sievelight.llm.scratch import Scratch
from test_joins import brute
from test_line_runs import plain_dedup
from test_quality_and_lines import base

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf):
    """What goes into each stage, and what comes out of the last."""
    scratch = Scratch(spark, "test-pipeline")
    out = [spark.read.parquet(f"{sf}/documents.parquet")]
    for i, (_, f) in enumerate(corpus_pipeline.STAGES):
        out.append(scratch.table(f(spark, out[-1], sf), f"s{i}"))
    return out


def test_names_and_columns(stages):
    assert len(corpus_pipeline.STAGES) == 4 and corpus_pipeline.ORACLE_SQL is None
    assert all(s.columns == COLUMNS for s in stages[:-1])


def test_quality_stage(stages):
    texts = {r.doc_id: r.text for r in stages[0].collect()}
    kept = {r.doc_id: r.text for r in stages[1].collect()}
    assert all(texts[d] == t for d, t in kept.items())
    assert not any(base(t)[-1] for t in kept.values()) and len(kept) > len(texts) / 2


def test_line_stage(stages):
    want = {d: t for d, t in plain_dedup(sorted((r.doc_id, r.text) for r in stages[1].collect())).items() if re.search(r"[^\x20\x09-\x0D]", t)}
    got = stages[2].collect()
    assert {r.doc_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_near_duplicate_stage(stages):
    rows = [(r.doc_id, r.text) for r in stages[2].collect()]
    keep = {d for (d, _), (n, c, _) in zip(rows, brute(rows, 5, 80, 100), strict=True) if n == 0 or c == d}
    assert {r.doc_id: r.text for r in stages[3].collect()} == {d: t for d, t in rows if d in keep}


def test_packing_stage(stages):
    total = {}
    for r in stages[4].collect():
        total.setdefault(r.doc_id, [r.doc_tokens, 0])[1] += r.length
    assert set(total) == {r.doc_id for r in stages[3].collect()} and all(a == b for a, b in total.values())


def test_near_duplicates_with_awkward_rows(spark, docs):
    own = docs.select(*COLUMNS)
    kept = corpus_pipeline.near_duplicates(spark, own, "").collect()
    texts = [r.text for r in kept if r.text and r.text.strip()]
    assert len(texts) == len(set(texts)) and kept
    assert corpus_pipeline.near_duplicates(spark, own.limit(0), "").count() == 0

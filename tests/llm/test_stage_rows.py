"""The pipeline's stages on awkward rows: nulls, repeated rows, clashing columns, empty tables; and shards of equal texts."""

import corpus_pipeline
import pytest

from sievelight.llm import sharding
from test_joins import brute  # noqa: F401  the fixtures' neighbours
from test_quality_and_lines import base

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, edge_rows):
    """Awkward rows with columns that are named like the operators' own."""
    rows = [(r[0], r[1], r[2], r[3], len(r[1] or ""), "a", 7, True) for r in edge_rows]
    return spark.createDataFrame(rows, f"{DOCS}, group_key string, n_removed_lines int, kept boolean").repartition(3)


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:3], ids=lambda s: s[0])
def test_stages_keep_columns(spark, sf, edge_rows, stage):
    docs = table(spark, edge_rows)
    got = stage[1](spark, docs, sf)
    assert got.columns == docs.columns
    rows = got.collect()
    assert 0 < len(rows) <= len(edge_rows) and {(r.group_key, r.kept) for r in rows} == {("a", True)}
    assert stage[1](spark, docs.limit(0), sf).count() == 0


def test_quality_stage_of_awkward_rows(spark, sf, edge_rows):
    got = corpus_pipeline.quality(spark, table(spark, edge_rows), sf).collect()
    assert not any(base(r.text)[-1] for r in got)  # null and empty texts are gone
    texts = [r.text for r in got]
    assert texts.count(edge_rows[0][1]) in (0, sum(r[1] == edge_rows[0][1] for r in edge_rows))  # repeated rows share a verdict


def test_line_stage_of_awkward_rows(spark, sf, edge_rows):
    got = corpus_pipeline.lines(spark, table(spark, edge_rows), sf).collect()
    assert sum(r.text is None for r in got) == sum(r[1] is None for r in edge_rows)
    assert all(r.n_chars == len(r.text or "") for r in got)
    assert sum(r.text == edge_rows[0][1] for r in got) == 1  # of copies the first


def test_near_duplicates_of_nameless_rows(spark, sf, edge_rows):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text, "en", "s", 1), (5, text, "en", "s", 1), (3, f"{text} x", "en", "s", 1), (None, None, "en", "s", 0), (9, "", "en", "s", 0)]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOCS), sf).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == [(0, ""), (3, f"{text} x"), (9, "")]


def test_packing_stage_of_awkward_rows(spark, sf, edge_rows):
    docs = table(spark, edge_rows)
    got = corpus_pipeline.packing(spark, docs, sf).collect()
    assert sum(r.start == 0 for r in got) == len(edge_rows)  # every row is packed, repeated and null ones too
    assert all(r.length > 0 for r in got) and corpus_pipeline.packing(spark, docs.limit(0), sf).count() == 0


def test_equal_texts_share_a_shard(spark):
    """Groups up to a shard's fair share are whole; nulls and empties are one group."""
    rows = [(i, f"text number {i % 150} " * (1 + i % 7)) for i in range(1500)] + [(2000 + i, None if i % 2 else "") for i in range(30)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=24).collect()
    where = {}
    for r in got:
        where.setdefault(r.group_hash, set()).add(r.shard)
    assert all(len(s) == 1 for s in where.values()) and len({s for x in where.values() for s in x}) == 24
    for s in range(24):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))

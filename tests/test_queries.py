"""Every registered query against its SQL."""

import importlib
import math

import duckdb
import pytest

from sievelight.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c


def shown(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    value = lambda v: None if isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v
    return sorted(cols), sorted(repr([value(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, sf, con, name):
    df = catalogue.QUERIES[name](spark, sf)
    got = shown([tuple(r) for r in df.collect()], df.columns)
    r = con.execute(catalogue.ORACLE_SQL[name])
    cols = [d[0] for d in r.description]
    assert got == shown(r.fetchall(), cols)


def test_entry_module(spark):
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("order", [(0, 1, 2), (1, 0, 2), (2, 1, 0)])
def test_stream_keeps_latest(spark, tmp_path, order):
    from sievelight.streaming.telemetry import appended, current, keep_latest

    (tmp_path / "in").mkdir()
    path, files = str(tmp_path / "out"), ['{"k":1,"v":"a","seq":1}\n{"k":2,"v":"b","seq":1}', '{"k":1,"v":"c","seq":2}', '{"k":3,"v":"e","seq":0}\n{"k":2,"v":"z","seq":0}']
    assert current(spark, path) is None
    for i in order:  # a file is a batch
        (tmp_path / "in" / f"{i}.json").write_text(files[i])
        stream = appended(spark, str(tmp_path / "in"), "k int, v string, seq int", per_trigger=1)
        q = keep_latest(stream, path, str(tmp_path / "cp"), ["k"], "seq").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    assert sorted((r.k, r.v) for r in current(spark, path).collect()) == [(1, "c"), (2, "b"), (3, "e")]
    again = keep_latest(appended(spark, str(tmp_path / "in"), "k int, v string, seq int"), path, str(tmp_path / "other"), ["k"], "seq").trigger(availableNow=True).start()
    with pytest.raises(Exception, match="doesn't belong"):  # a new checkpoint over an old table
        again.awaitTermination(120)

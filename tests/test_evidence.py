import pytest
from pyspark.sql import functions as F

from sievelight.operators import embedding, evidence


def test_items_are_cleaned(spark):
    rows = [("rust_function_slice", '{"file":"a","risk_tags":[" unsafe ","",null],"symbol":""}'), ("x", '{"evidence_type":"rule","calls":["f"]}'), ("c_build_info", None), ("y", "{bad")]
    got = evidence.items(spark.createDataFrame(rows, "kind string, meta string")).collect()
    assert [r.evidence_type for r in got] == ["code_slice", "rule", "c_build_info", "code"]
    assert got[0].risk_tags == ["unsafe"] and got[0].symbol is None and got[0].risk_score == 3 and got[1].calls == ["f"] and got[2].file == "" and got[3].calls == []


def test_target_comes_first(spark):
    rows = spark.createDataFrame([(0, "rule", "a"), (1, "code", "gone"), (2, "code_slice", "b"), (3, "code", "a")], "idx int, evidence_type string, file string")
    files = spark.createDataFrame([("a",), ("b",), ("b",)], "path string")
    assert [r.idx for r in evidence.target_first(rows, files).orderBy("place").collect()] == [2, 0, 1, 3]
    many = spark.range(5000).select(F.col("id").alias("idx"), F.when(F.col("id") >= 4000, "code").otherwise("rule").alias("evidence_type"), F.lit("a").alias("file"))
    got = [r.idx for r in evidence.target_first(many, files).orderBy("place").collect()]
    assert got == [4000, *range(4000), *range(4001, 5000)]  # none is left out
    assert [r.idx for r in evidence.target_first(many.filter("idx < 4000"), files).orderBy("place").collect()] == list(range(4000))
    code, rest = evidence.split(rows)
    assert code.count() == 3 and [r.idx for r in rest.collect()] == [0]
    assert evidence.strategies(rows).count() == 0


def test_prompt(spark):
    own = spark.createDataFrame([("x {a} y {b}", "1", "2")], "t string, a string, b string")
    text = evidence.render(F.col("t"), {"a": F.col("a"), "b": F.col("b")})
    got = own.select(text.alias("t"), evidence.has_in_order(text, ["x", "1", "2"]).alias("y"), evidence.has_in_order(text, ["2", "1"]).alias("n")).first()
    assert tuple(got) == ("x 1 y 2", True, False)


def test_template_diffs(spark):
    own = spark.createDataFrame([("f", "fn a() {\n\n  x\n}"), (None, "")], "p string, s string")
    got = [tuple(r) for r in own.select(evidence.template_diff(F.col("p"), F.col("s")), evidence.template_diff(F.col("p"), F.col("s"), edit=True)).collect()]
    assert got[0] == ("--- a/f\n+++ b/f\n@@ -1,1 +1,1 @@\n-fn a() {\n+fn a() {\n", "--- a/f\n+++ b/f\n@@ -3,1 +3,1 @@\n-  x\n+  x // patched\n")
    assert got[1][0] == "--- a/file.txt\n+++ b/file.txt\n@@ -1,1 +1,1 @@\n-line1\n+line1\n"


def test_models(spark):
    models = spark.createDataFrame([("m", "stub", 8)], "model_id string, provider_type string, dimension int")
    assert embedding.model(models, "m")["dimension"] == 8
    with pytest.raises(ValueError, match="model_not_found"):
        embedding.model(models, "x")


def test_stub_of_the_default_seed():
    import hashlib
    import random

    first = random.Random(1337 ^ int.from_bytes(hashlib.sha256(b"aaa").digest()[:8], "little")).uniform(-1, 1)
    assert embedding.stub({"dimension": 3})(["aaa"])[0][0] == float(f"{first:.7g}")

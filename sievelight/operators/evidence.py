"""Evidence items: clean metadata, strategies, the target file, and what goes into and comes out of a prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelight.functions.features import any_of, evidence_type, risk_score
from sievelight.functions.text import lines, strip
from sievelight.sources.schemas import META

#: Types of evidence that tell how to repair, by their beginning.
STRATEGY_TYPES = ["replacement_strategy", "rust_rule_snippet", "interface_constraint", "behavior_constraint"]
#: Ranges in which rows are numbered.
RANGES = 256
LISTS = ["risk_tags", "constraint_tags", "api_tags", "calls", "applies_to_risk"]
NAMES = ["symbol", "signature", "strategy_id", "strategy_title"]


def clean_list(values: Column) -> Column:
    """Trimmed strings without blanks; null counts as empty."""
    return F.coalesce(F.filter(F.transform(values, strip), lambda x: x != ""), F.array().cast("array<string>"))


def items(found: DataFrame) -> DataFrame:
    """(kind, meta as JSON, …) with the metadata's known fields as columns, cleaned, and the risk score."""
    meta = F.from_json(F.col("meta"), META)
    own = found.withColumn("_m", meta)
    own = own.withColumn("file", F.coalesce("_m.file", F.lit(""))).withColumn("evidence_type", evidence_type(F.col("kind"), F.col("_m.evidence_type")))
    own = own.withColumns({c: clean_list(F.col(f"_m.{c}")) for c in LISTS} | {c: F.nullif(F.col(f"_m.{c}"), F.lit("")) for c in NAMES})
    return own.withColumn("risk_score", risk_score(F.col("risk_tags"))).drop("_m")


def is_code(kind: Column) -> Column:
    return F.coalesce(kind.startswith("code"), F.lit(False))


def split(evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(code, everything else)."""
    return evidence.filter(is_code(F.col("evidence_type"))), evidence.filter(~is_code(F.col("evidence_type")))


def strategies(evidence: DataFrame, order: str = "idx", by: str | None = None, most: int = 10) -> DataFrame:
    """The first strategies, of all or of each group."""
    own = evidence.filter(any_of([F.col("evidence_type").startswith(s) for s in STRATEGY_TYPES]))
    if by is None:
        return own.orderBy(order).limit(most)
    return own.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(order))).filter(F.col("_n") <= most).drop("_n")


def numbered(rows: DataFrame, order: str, name: str = "place") -> DataFrame:
    """Rows with their number by a numeric column, from 1; its values are distinct, a null comes first.

    Quantiles of the column cut the rows into ranges of about equal size, which are numbered by themselves and
    shifted by the sizes of those before, so no task sorts all rows.
    """
    cuts = rows.agg(F.coalesce(F.percentile_approx(order, [i / RANGES for i in range(1, RANGES)], 10_000), F.array()).alias("_cuts"))
    own = rows.crossJoin(F.broadcast(cuts)).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(order)))).drop("_cuts")  # cuts is one row
    own = own.withColumn("_range", F.coalesce("_range", F.lit(0)))
    sizes = own.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))  # a row a range
    at = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    return own.withColumn("_at", at).join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_at")).drop("_range", "_at", "_before")


def target_first(evidence: DataFrame, files: DataFrame, order: str = "idx") -> DataFrame:
    """The items with place: the first code item whose file (path) exists comes first, the others keep their order."""
    here = files.select(F.col("path").alias("file")).distinct()
    code = evidence.filter(is_code(F.col("evidence_type")) & (F.col("file") != ""))
    picked = code.join(here, "file", "left_semi").agg(F.min(order).alias("_picked"))
    own = numbered(evidence, order).crossJoin(F.broadcast(picked))  # picked is one row
    moved = F.when(F.col(order) == F.col("_picked"), F.lit(1)).when(F.col(order) < F.col("_picked"), F.col("place") + 1).otherwise(F.col("place"))
    return own.withColumn("place", moved.cast("long")).drop("_picked")


def render(template: Column, values: dict[str, Column]) -> Column:
    """A template with its {name} places filled in, one after another."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def has_in_order(text: Column, wanted: list[str]) -> Column:
    """Whether all strings occur, each behind the one before."""
    at, fine = F.lit(1), F.lit(True)
    for w in wanted:
        found = F.locate(w, text, 1) if w is wanted[0] else F.call_function("locate", F.lit(w), text, at)
        fine = fine & (found > 0)
        at = found + len(w)
    return fine


def template_diff(path: Column, source: Column, *, edit: bool = False) -> Column:
    """A one-line diff of a source: its first line unchanged, or with edit its first line that is no signature, marked."""
    path = F.coalesce(F.nullif(path, F.lit("")), F.lit("file.txt"))
    own = F.when(F.size(lines(source)) == 0, F.array(F.lit("line1"))).otherwise(lines(source))
    fit = F.array_position(F.transform(own, lambda x: (strip(x) != "") & ~x.contains("fn ")), F.lit(True)).cast("int")
    at = F.greatest(fit, F.lit(1)) if edit else F.lit(1)
    line, place = F.element_at(own, at), at.cast("string")
    new = F.concat(line, F.lit(" // patched")) if edit else line
    return F.concat(F.lit("--- a/"), path, F.lit("\n+++ b/"), path, F.lit("\n@@ -"), place, F.lit(",1 +"), place, F.lit(",1 @@\n-"), line, F.lit("\n+"), new, F.lit("\n"))

"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.llm.jaccard_join import jaccard_join
from sievelight.llm.line_dedup import line_dedup
from sievelight.llm.packing import pack
from sievelight.llm.quality_rules import quality_rules
from sievelight.llm.scratch import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the others go.

    A null or empty text has no words and goes; repeated rows share a verdict; an empty table stays empty;
    all columns are carried in a struct, so that none can clash.
    """
    return quality_rules(docs, rows=True).filter("kept").select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated chunks of lines; n_chars follows. Those of which no word is left go.

    A null text stays; repeated rows are copies, of which the first keeps its lines; an empty table stays
    empty; columns that are named like the operator's own are carried apart from them.
    """
    cleaned = line_dedup(docs).filter(r"n_removed_lines = 0 or text rlike '[^\\x20\\x09-\\x0D]'")
    now = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))}
    return cleaned.select(*(now.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8), that of the smallest id; those without a word stay."""
    joined = Scratch(spark, "near").table(jaccard_join(docs, width=5, num=80, den=100), "joined")
    alone = joined.filter("group_key is null").select("doc_id", "text_hash")
    nameless = F.col("doc_id").isNull().alias("nameless")  # an id comes before none
    first = joined.filter("group_key is not null").groupBy("group_key").agg(F.min(F.struct(nameless, "doc_id", "text_hash")).alias("of")).select("of.doc_id", "of.text_hash")
    kept = alone.unionByName(first).select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash"))
    out = docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]) & (F.xxhash64(docs["text"]) == kept["kept_hash"]), "left_semi")
    repeated = docs.groupBy("doc_id").count().filter("count > 1").limit(1).count()
    return out.dropDuplicates(["doc_id", "text"]) if repeated else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens, neighbours on the curve together.

    A null text is packed as an empty one, repeated rows one by one; an empty table gives no pieces; columns
    other than the id and the text aren't read.
    """
    return pack(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("packing", packing)]

#: SQL can't express content-defined chunks, the curve or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next reads it."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage-{i}")
    return STAGES[-1][1](spark, docs, sf_dir)

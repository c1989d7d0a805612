"""Operator 1, sharding: vector bin packing of bytes, tokens and rows.

Items are placed largest first, each on the shard where the dot product of its (bytes, tokens, rows)
with the shard's residual capacity is highest. An item is a large group of equal texts, a part of a
group too large for one item, or all small groups that share a cell of a hash; so the number of items
is bounded whatever the input, and equal texts stay together unless their group is split.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievelight.llm.scratch import Scratch

SHARDS, OVERHEAD = 24, 8
#: Hash cells of small groups per shard, and the share of a shard from which a group is an item of its own.
CELLS_PER_SHARD, LARGE = 256, 1 / 128
#: A group that is more than a shard's fair share is dealt over items of this share of a shard; any other stays whole.
SPLIT = 1 / 16
#: Rows that one bucket of slots holds, about.
SLOT_ROWS = 100_000


def place(items: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each row (bytes, tokens, rows) of items; ties go to the lower item and shard."""
    total = np.maximum(items.sum(axis=0), 1)
    size = items / total * shards  # 1 is a shard's fair share in that dimension
    left = np.ones((shards, items.shape[1]))
    out = np.zeros(len(items), np.int64)
    for i in np.argsort(-size.max(axis=1), kind="stable"):
        fits = (left >= size[i]).all(axis=1)
        if fits.any():
            score = np.where(fits, left @ size[i], -np.inf)
        else:  # it overflows everywhere: where the fullest dimension stays lowest
            score = (left - size[i]).min(axis=1)
        out[i] = s = int(np.argmax(score))
        left[s] -= size[i]
    return out


def shard(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """One row per row of df: id, size, text_crc32, tokens, group_hash, shard, slot.

    size is the UTF-8 bytes of the text (null: none) plus 8; tokens are words between ASCII white space.
    A null text counts as the empty one, so nulls and empties form one group. Repeated rows and null ids
    each take a place of their own; ties in a shard's slots go by id, then by hash, and equal rows are
    interchangeable. An empty table gives an empty result; other columns aren't read. Texts are hashed
    where they are read and never shuffled. The 64-bit hash only decides what is placed together: a
    collision would put two texts on one shard. The driver sees at most 3 / LARGE large groups a shard and
    the sums of the cells.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "shard")
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    base = df.select(
        df[id_col].alias("id"),
        (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"),
        F.xxhash64(text).alias("group_hash"),
    )
    base = scratch.table(base, "base")
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")]
    whole = base.agg(*sums).first()
    caps = [max(whole[k] or 0, 1) / shards for k in ("size", "tokens", "n")]
    share = F.greatest(*(F.col(k) / F.lit(float(c)) for k, c in zip(("size", "tokens", "n"), caps, strict=True)))
    large = base.groupBy("group_hash").agg(*sums).select("group_hash", share.alias("share")).filter(F.col("share") >= LARGE)
    parts = [(r["group_hash"], int(np.ceil(r["share"] / SPLIT)) if r["share"] > 1 else 1) for r in large.collect()]  # 3 * shards / LARGE rows at most
    big = F.broadcast(spark.createDataFrame(parts, "group_hash long, parts int"))
    part = F.coalesce(F.pmod(F.xxhash64(F.lit(1), "id"), F.col("parts")).cast("int"), F.lit(-1))
    cell = F.when(F.col("parts").isNull(), F.pmod(F.xxhash64(F.lit(2), "group_hash"), F.lit(CELLS_PER_SHARD * shards))).otherwise(F.col("group_hash"))
    keyed = base.join(big, "group_hash", "left").withColumn("part", part).withColumn("cell", cell).drop("parts")
    items = sorted(keyed.groupBy("part", "cell").agg(*sums).collect(), key=lambda r: (r["part"], r["cell"]))
    where = place(np.array([[r["size"], r["tokens"], r["n"]] for r in items], float).reshape(-1, 3), shards)
    placed = spark.createDataFrame([(r["part"], r["cell"], int(s)) for r, s in zip(items, where, strict=True)], "part int, cell long, shard int")
    put = keyed.join(F.broadcast(placed), ["part", "cell"]).drop("part", "cell")

    # slots: numbered inside hash buckets of a shard, so that a shard isn't one task
    buckets = max(1, (whole["n"] or 0) // (SLOT_ROWS * shards), 8)
    put = put.withColumn("bucket", F.pmod(F.xxhash64(F.lit(3), "id", "group_hash"), F.lit(buckets)).cast("int"))
    counts = put.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = counts.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("before"))
    order = Window.partitionBy("shard", "bucket").orderBy("id", "group_hash")
    out = put.withColumn("at", F.row_number().over(order)).join(F.broadcast(before) if buckets * shards <= 100_000 else before, ["shard", "bucket"])
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", "tokens", "group_hash", "shard", (F.col("before") + F.col("at") - 1).alias("slot"))


def op1_vector_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The law is bytes: the shards' sizes are near equal, and so are their tokens and rows."""
    placed = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")

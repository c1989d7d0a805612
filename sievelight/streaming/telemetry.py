"""Telemetry as streams (an extension): appended files in, current state and windows out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.operators.store import upsert_latest

#: Parts of a table of latest rows, by a hash of the keys; a batch rewrites only those that it has rows of.
BUCKETS = 64


def appended(spark: SparkSession, path: str, schema: str, per_trigger: int = 64) -> DataFrame:
    """A stream over JSON files as they are added."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).json(path)


def windowed_counts(events: DataFrame, ts: str, by: str, *, size: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts per window and key; what is later than the watermark is left out."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), place


def _names(spark: SparkSession, path: str) -> list[str]:
    store, place = _files(spark, path)
    return [s.getPath().getName() for s in store.listStatus(place)] if store.exists(place) else []


def _versions(spark: SparkSession, path: str, most: int) -> dict[int, list[int]]:
    """Of every bucket the batches up to most that wrote it, in order."""
    found = {int(b.split("=")[1]): _names(spark, f"{path}/rows/{b}") for b in _names(spark, f"{path}/rows") if b.startswith("_bucket=")}
    out = {b: sorted(v for n in names if n.startswith("_version=") for v in [int(n.split("=")[1])] if v <= most) for b, names in found.items()}
    return {b: v for b, v in out.items() if v}


def _at(spark: SparkSession, path: str, most: int, buckets: set[int] | None = None) -> DataFrame | None:
    last = {b: v[-1] for b, v in _versions(spark, path, most).items() if buckets is None or b in buckets}
    if not last:
        return None
    wanted = reduce(lambda a, b: a | b, [(F.col("_bucket") == b) & (F.col("_version") == v) for b, v in last.items()])
    return spark.read.parquet(f"{path}/rows").filter(wanted).drop("_bucket", "_version")


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The table that keep_latest() has written so far, by its last whole batch; None before the first."""
    done = [int(n) for n in _names(spark, f"{path}/batches")]
    return _at(spark, path, max(done)) if done else None


def keep_latest(stream: DataFrame, path: str, checkpoint: str, keys: list[str], seq: str):
    """Keeps a table of the row with the largest seq per key, read by current().

    The table lies in buckets of keys; a batch writes new versions of the buckets it has rows of, and then
    its number into batches, which makes them valid. Versions before the last two are removed. A batch that
    is run again starts from the same state. A new checkpoint needs a new path; a table that is gone is an error.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = [int(n) for n in _names(spark, f"{path}/batches")]
        if number and number - 1 not in done or not number and any(n > 0 for n in done):
            raise ValueError(f"the table at {path} doesn't belong to this stream's checkpoint: batches {sorted(done)[-3:]} before {number}")
        batch = batch.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"))
        touched = {r[0] for r in batch.select("_bucket").distinct().collect()}  # BUCKETS at most
        if touched:
            new, stored = batch.drop("_bucket"), _at(spark, path, number - 1, touched)
            latest = upsert_latest(stored if stored is not None else new.limit(0), new, keys, seq)
            out = latest.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")).withColumn("_version", F.lit(number))
            out.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket", "_version").parquet(f"{path}/rows")
        store, place = _files(spark, f"{path}/batches/{number}")
        store.create(place, True).close()
        for b, versions in _versions(spark, path, number).items():
            for v in versions[:-2] if b in touched else []:
                store, place = _files(spark, f"{path}/rows/_bucket={b}/_version={v}")
                store.delete(place, True)
        for n in done:
            if n < number - 2:
                store, place = _files(spark, f"{path}/batches/{n}")
                store.delete(place, True)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)

"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from sievelight.session import shared_folder


CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Writes a DataFrame as Parquet and reads it again, which cuts its lineage.

    A lost executor costs only the tasks that were running: the table outlives it.
    drop() removes a table no later plan reads; the rest goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_folder(spark)}/sievelight/{name}-{uuid.uuid4().hex}"
        atexit.register(self.clear)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        kept = self.spark.conf.get(CLEAN_UP, None)
        self.spark.conf.set(CLEAN_UP, "true")  # once the table is written, nothing reads the shuffles that made it
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.unset(CLEAN_UP) if kept is None else self.spark.conf.set(CLEAN_UP, kept)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.base}/{name}")

    def clear(self) -> None:
        try:
            self._delete(self.base)
        except Exception:  # the JVM has ended before us
            pass

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)

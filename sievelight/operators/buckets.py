"""Keyed tables of which a change rewrites only what it touches.

A table is partitioned by a hash of its keys, which is what a change replaces (dynamic partition overwrite: new files
are staged and put in place when the job is done), and bucketed by the keys, so that a change meets the stored rows
without a shuffle of them. Keys are never null: a change with a null key is refused.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.operators.store import with_ids

PART = "_part"


@dataclass(frozen=True)
class Keyed:
    """A table of the session's catalogue, its keys, the parts that are replaced and the buckets inside them."""

    spark: SparkSession
    name: str
    keys: tuple[str, ...]
    parts: int = 64
    buckets: int = 8

    def rows(self) -> DataFrame:
        """All rows, without the column of parts."""
        return self.spark.table(self.name).drop(PART)

    def _dealt(self, rows: DataFrame) -> DataFrame:
        null = F.lit(False)
        for k in self.keys:
            null = null | F.col(k).isNull()
        part = F.when(null, F.raise_error(F.lit(f"a key of {self.name} is null"))).otherwise(F.pmod(F.xxhash64(*self.keys), F.lit(self.parts))).cast("int")
        return rows.withColumn(PART, part)

    def _touched(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(rows with their parts, the stored rows of these parts); the driver sees at most as many numbers as there are parts."""
        dealt = self._dealt(rows)
        numbers = [r[0] for r in dealt.select(PART).distinct().collect()]
        return dealt, self.spark.table(self.name).filter(F.col(PART).isin(*numbers) if numbers else F.lit(False))

    def _replace(self, merged: DataFrame) -> None:
        columns = self.spark.table(self.name).columns
        mode = "spark.sql.sources.partitionOverwriteMode"
        before = self.spark.conf.get(mode)
        self.spark.conf.set(mode, "dynamic")
        try:
            merged.select(*columns).write.mode("overwrite").insertInto(self.name)
        finally:
            self.spark.conf.set(mode, before)

    def merged(self, rows: DataFrame, seq: str | None = None) -> DataFrame:
        """What the touched parts hold after an upsert of rows: one row a key.

        With seq the row of the largest one stays, of equal ones the new; one without is the oldest. Without seq a new
        row replaces a stored one, and of several new ones of a key any stays.
        """
        dealt, stored = self._touched(rows)
        names = [c for c in stored.columns if c not in self.keys]
        dealt = dealt.select(*stored.columns)
        new = dealt.groupBy(*self.keys).agg(F.max_by(F.struct(*names), F.col(seq)).alias("_new"), F.any_value(F.struct(*names)).alias("_any")) if seq else dealt.groupBy(*self.keys).agg(F.any_value(F.struct(*names)).alias("_new"))
        new = new.select(*self.keys, F.coalesce("_new", "_any").alias("_new")) if seq else new  # all of a key without a seq
        old = stored.select(*self.keys, F.struct(*names).alias("_old"))
        both = old.join(new, list(self.keys), "full_outer")
        wins = F.col("_old").isNull() if not seq else F.col("_old").isNull() | F.coalesce(F.col(f"_new.{seq}") >= F.col(f"_old.{seq}"), F.col(f"_old.{seq}").isNull())
        kept = F.when(F.col("_new").isNotNull() & (wins if seq else F.lit(True)), F.col("_new")).otherwise(F.col("_old"))
        return both.select(*self.keys, kept.alias("_r")).select(*self.keys, "_r.*").select(*stored.columns)

    def upsert(self, rows: DataFrame, seq: str | None = None) -> None:
        """Puts rows in place of those of equal keys; rows has the table's columns."""
        self._replace(self.merged(rows, seq))

    def remove(self, keys: DataFrame) -> None:
        """Rows whose keys are among these go; a part that loses all its rows is left without files."""
        dealt, stored = self._touched(keys.select(*self.keys))
        left = stored.join(dealt.select(*self.keys), list(self.keys), "left_anti")
        empty = dealt.select(PART).distinct().join(left.select(PART).distinct(), PART, "left_anti")
        numbers = [r[0] for r in empty.collect()]  # parts at most
        self._replace(left)
        for k in numbers:
            self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION ({PART} = {k})")
            _delete(self.spark, f"{_location(self.spark, self.name)}/{PART}={k}")

    def get_or_create(self, rows: DataFrame, id_col: str, *, refresh: tuple[str, ...] = ()) -> None:
        """Rows whose keys the table has not yet come in under new ids; where it has them, the refresh columns are updated."""
        dealt, stored = self._touched(rows.dropDuplicates(list(self.keys)))
        names = list(self.keys)
        fresh = dealt.select(*names, F.struct(*refresh).alias("_new")) if refresh else None
        known = stored.join(fresh, names, "left") if refresh else stored
        known = known.select(*(F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in refresh else F.col(c) for c in stored.columns))
        new = with_ids(self.spark.table(self.name), dealt.join(stored.select(*names), names, "left_anti"), id_col, names)
        self._replace(known.unionByName(new.select(*(F.col(c) if c in new.columns else F.lit(None).alias(c) for c in stored.columns))))


def _location(spark: SparkSession, name: str) -> str:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").filter("col_name = 'Location'").collect()
    return rows[0]["data_type"]


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def create(rows: DataFrame, name: str, path: str, keys: list[str], *, parts: int = 64, buckets: int = 8) -> Keyed:
    """The table of rows, one a key, at a path."""
    table = Keyed(rows.sparkSession, name, tuple(keys), parts, buckets)
    dealt = table._dealt(rows.dropDuplicates(keys))
    dealt.repartition(PART, F.pmod(F.hash(*keys), F.lit(buckets))).write.partitionBy(PART).bucketBy(buckets, *keys).option("path", path).saveAsTable(name)
    return table


def attach(spark: SparkSession, name: str, path: str, schema: str, keys: list[str], *, parts: int = 64, buckets: int = 8) -> Keyed:
    """A table that another session created, under a name of this one."""
    by = ", ".join(keys)
    spark.sql(f"CREATE TABLE {name} ({schema}, {PART} INT) USING parquet PARTITIONED BY ({PART}) CLUSTERED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'")
    spark.sql(f"MSCK REPAIR TABLE {name}")
    return Keyed(spark, name, tuple(keys), parts, buckets)

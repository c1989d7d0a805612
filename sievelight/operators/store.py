"""Guarded changes of tables that are Parquet: every change is a new DataFrame, made by joins."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievelight.functions.text import content_hash, strip

#: States of runs and of patches.
RUN_STATES = ["INIT", "RETRIEVE", "GENERATE", "APPLY", "EXECUTE", "DIAGNOSE", "STOP", "FAILED"]
PATCH_STATES = ["applied", "rolled_back"]


def page(table: DataFrame, key: str, *, limit: int = 50, offset: int = 0, most: int = 200) -> DataFrame:
    """Rows by key; limit is held to 1..most, offset to 0 and more."""
    return table.orderBy(key).offset(max(0, offset)).limit(min(max(1, limit), most))


def point(table: DataFrame, key: str, value) -> DataFrame:
    return table.filter(F.col(key) == value).limit(1)


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Rows of child whose key no parent has; a null key refers to none and is no orphan."""
    keys = parent.select(F.col(parent_key or key).alias("_parent"))
    return child.filter(F.col(key).isNotNull()).join(keys, F.col(key) == F.col("_parent"), "left_anti")


def repeated(table: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return table.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def has_key(meta, name: str):
    """Whether a JSON object has a key, be its value null."""
    return F.coalesce(F.array_contains(F.json_object_keys(meta), F.lit(name)), F.lit(False))


def with_ids(stored: DataFrame, rows: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    """Gives new rows the ids after the largest stored one, in order.

    Numbers are dealt per hash bucket and shifted by the buckets before, so no single task sorts all rows.
    """
    top = stored.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("top"))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(256)))
    counts = rows.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = counts.select("_bucket", (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_before"))  # 256 rows
    at = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    out = rows.withColumn("_at", at).join(F.broadcast(before), "_bucket").crossJoin(F.broadcast(top))  # top is one row
    return out.withColumn(id_col, F.col("top") + F.col("_before") + F.col("_at")).drop("_bucket", "_at", "_before", "top")


def _met(keys: list[str]):
    """Equality of keys with columns _k0, _k1, …, in which nulls are equal."""
    return reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])


def _without(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys, nulls included, others have not."""
    others = others.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)))
    return rows.join(others, _met(keys), "left_anti")


def insert_ignore(stored: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """stored with those rows whose keys it has not yet; of rows with equal keys one. Null keys are equal to each other."""
    new = _without(rows.dropDuplicates(keys), stored, keys)
    return stored.unionByName(new, allowMissingColumns=True)


def upsert_latest(stored: DataFrame, rows: DataFrame, keys: list[str], seq: str | None = None) -> DataFrame:
    """stored with rows in place of those of equal keys; one row a key.

    With seq the row of the largest seq stays, be it new or stored; of equal ones the new, and one without
    a seq is the oldest. Without seq a new row replaces a stored one, and of several new ones any stays.
    """
    if not seq:
        rows = rows.dropDuplicates(keys)
        return _without(stored, rows, keys).unionByName(rows, allowMissingColumns=True)
    both = stored.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    names = [c for c in both.columns if c != "_new"]
    rest = F.struct(*(c for c in names if c not in keys))
    return both.groupBy(*keys).agg(F.max_by(rest, F.struct(seq, "_new")).alias("_r")).select(*keys, "_r.*").select(*names)


def update(stored: DataFrame, keys: list[str], changes: DataFrame) -> DataFrame:
    """stored with the columns of changes (keys, columns) where its keys are found; of several changes of a key any."""
    names = [c for c in changes.columns if c not in keys]
    new = changes.dropDuplicates(keys).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.struct(*names).alias("_new"))
    out = stored.join(new, _met(keys), "left")
    return out.select(*(F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in stored.columns))


def get_or_create(stored: DataFrame, rows: DataFrame, keys: list[str], id_col: str, *, refresh: tuple[str, ...] = ()) -> DataFrame:
    """stored with those rows whose natural keys it has not yet, under new ids; where it has them, the refresh columns are updated."""
    known = update(stored, keys, rows.select(*keys, *refresh)) if refresh else stored
    new = _without(rows.dropDuplicates(keys), stored, keys)
    return known.unionByName(with_ids(stored, new, id_col, keys), allowMissingColumns=True)


def _of_known_state(rows: DataFrame, states: list[str], runs: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(rows of an allowed state whose run exists, the others with the reason)."""
    checked = rows.withColumn("reason", F.when(~F.coalesce(F.col("status").isin(*states), F.lit(False)), "status")) if "status" in rows.columns else rows.withColumn("reason", F.lit(None).cast("string"))
    if runs is not None:
        known = runs.select(F.col("run_id").alias("_run")).distinct()
        checked = checked.join(known, F.col("run_id") == F.col("_run"), "left")
        checked = checked.withColumn("reason", F.coalesce("reason", F.when(F.col("_run").isNull(), "fk"))).drop("_run")
    return checked.filter("reason is null").drop("reason"), checked.filter("reason is not null")


def _stamped(rows: DataFrame, *names: str) -> DataFrame:
    """rows with the present time in the named columns where they have none."""
    return rows.withColumns({n: F.coalesce(F.col(n).cast("timestamp"), F.current_timestamp()) if n in rows.columns else F.current_timestamp() for n in names})


def create_runs(runs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs with the new ones, refused rows): a run begins as INIT, a state that isn't known or an id that exists is refused."""
    rows = rows.withColumn("status", F.coalesce("status", F.lit("INIT")) if "status" in rows.columns else F.lit("INIT"))
    fine, bad = _of_known_state(_stamped(rows, "created_at", "updated_at"), RUN_STATES, None)
    taken = fine.join(runs.select("run_id"), "run_id", "left_semi").withColumn("reason", F.lit("unique"))
    return insert_ignore(runs, fine, ["run_id"]), bad.unionByName(taken)


def add_steps(steps: DataFrame, runs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(steps with the new ones, refused rows: their run is unknown)."""
    fine, bad = _of_known_state(_stamped(rows, "created_at"), [], runs)
    return insert_ignore(steps, fine, ["step_id"]), bad


def add_patches(patches: DataFrame, runs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(patches with the new ones, refused rows: their state or run is unknown)."""
    fine, bad = _of_known_state(_stamped(rows, "created_at"), PATCH_STATES, runs)
    return insert_ignore(patches, fine, ["patch_id"]), bad


def set_status(table: DataFrame, key: str, changes: DataFrame, states: list[str]) -> tuple[DataFrame, DataFrame]:
    """(table with the states of changes (key, status, …), refused changes of an unknown state); updated_at becomes the present time."""
    fine, bad = _of_known_state(changes, states, None)
    return update(table, [key], _stamped(fine, "updated_at") if "updated_at" in table.columns else fine), bad


def truncate(*tables: DataFrame) -> list[DataFrame]:
    """The tables without their rows."""
    return [t.limit(0) for t in tables]


def lock_key(name: str) -> int:
    """The signed 64-bit number under which a name is locked: the first eight bytes of its sha256, the highest first."""
    return int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "big", signed=True)


def cascade_delete(tables: list[tuple[DataFrame, str, str | None]], ids: list) -> list[DataFrame]:
    """Deletes ids from the first table and what refers to them down the chain of (table, key, key of its parent)."""
    out: list[DataFrame] = []
    gone: DataFrame | None = None
    for table, key, parent in tables:
        doomed = table.filter(F.col(key).isin(*ids)) if gone is None else table.join(gone, F.col(parent) == F.col("_gone"), "left_semi")
        out.append(table.join(doomed.select(F.col(key).alias("_key")), F.col(key) == F.col("_key"), "left_anti"))
        gone = doomed.select(F.col(key).alias("_gone"))
    return out


def insert_projects(projects: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(projects with the new names, rows refused because their name exists)."""
    taken = rows.join(projects.select("name"), "name", "left_semi")
    new = rows.dropDuplicates(["name"]).join(projects.select("name"), "name", "left_anti")
    return projects.unionByName(with_ids(projects, new, "project_id", ["name"]), allowMissingColumns=True), taken


def insert_snapshots(snapshots: DataFrame, projects: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(snapshots with the new ones, refused rows: no such project or already there); an empty commit is 'mock'."""
    rows = rows.withColumn("commit_sha", F.coalesce(F.nullif(strip(F.col("commit_sha")), F.lit("")), F.lit("mock")))
    bad = orphans(rows, projects, "project_id").withColumn("reason", F.lit("fk"))
    fine = rows.join(projects.select("project_id"), "project_id", "left_semi")
    keys = ["project_id", "commit_sha"]
    taken = fine.join(snapshots.select(*keys), keys, "left_semi").withColumn("reason", F.lit("unique"))
    new = fine.dropDuplicates(keys).join(snapshots.select(*keys), keys, "left_anti")
    return snapshots.unionByName(with_ids(snapshots, new, "snapshot_id", keys), allowMissingColumns=True), bad.unionByName(taken)


def insert_chunks(chunks: DataFrame, snapshots: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks with the new ones, refused rows and why): meta needs a file, the snapshot must exist, equal chunks are stored once."""
    keys = ["snapshot_id", "kind", "lang", "content_hash"]
    rows = rows.withColumn("content_hash", content_hash(F.col("content")))
    checked = rows.join(snapshots.select("snapshot_id").withColumn("_found", F.lit(True)), "snapshot_id", "left")
    short = F.length("kind").between(1, 64) & F.length("lang").between(1, 32)
    reason = F.when(~has_key(F.col("meta"), "file"), "meta_file").when(~short, "length").when(F.col("_found").isNull(), "fk")
    checked = checked.withColumn("reason", reason).drop("_found")
    fine = checked.filter("reason is null").drop("reason")
    taken = fine.join(chunks.select(*keys), keys, "left_semi").withColumn("reason", F.lit("unique"))
    new = fine.dropDuplicates(keys).join(chunks.select(*keys), keys, "left_anti")
    return chunks.unionByName(with_ids(chunks, new, "chunk_id", keys), allowMissingColumns=True), checked.filter("reason is not null").unionByName(taken)

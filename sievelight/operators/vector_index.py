"""An approximate vector index: inverted lists around centres, the lists as folders of a table.

Centres come from k-means over a bounded sample; every vector goes to the list of its nearest centre, and a search
reads the lists of the centres nearest to its query. Distances inside the lists are exact, so more lists only add rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LISTS, PROBES = 100, 10
#: Vectors of the sample for each list.
SAMPLE = 128
#: Vectors for which a list has one more file.
SLICE = 200_000
DIGITS = 9
_ROW = "chunk_id long, snapshot_id long, model_id string, embedding array<float>, norm double, list int"


def _sound(vectors: DataFrame) -> DataFrame:
    """Vectors that have a direction."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return vectors.filter(F.coalesce(fine, F.lit(False)))


def centres(vectors: DataFrame, lists: int = LISTS, seed: int = 42) -> np.ndarray:
    """Unit vectors (lists, dim) from k-means by cosine over the lists * SAMPLE vectors whose hashed ids are smallest.

    They have the dimension that most vectors have, the larger of equals. Fewer vectors give fewer centres.
    """
    own = _sound(vectors)
    most = own.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if most is None:
        return np.zeros((0, 0))
    sample = own.filter(F.size("embedding") == most["dim"]).orderBy(F.xxhash64("chunk_id", F.lit(seed)), "chunk_id").limit(lists * SAMPLE)
    rows = sample.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    n = rows.count()
    if n == 1:
        found = np.array([rows.first()[0].toArray()])
    else:
        found = np.array(KMeans(k=min(lists, n), distanceMeasure="cosine", seed=seed, maxIter=15).fit(rows).clusterCenters())
    return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-300)


def _assigned(unit: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.diff(b.column(3).offsets.to_numpy())
            v = np.zeros((b.num_rows, unit.shape[1]))
            fits = sizes == unit.shape[1]
            flat = b.column(3).flatten().to_numpy(zero_copy_only=False)
            v[fits] = flat[np.repeat(fits, sizes)].reshape(-1, unit.shape[1])
            norm = np.sqrt(np.einsum("ij,ij->i", v, v))
            near = (v @ unit.T).argmax(axis=1).astype(np.int32)
            near[~fits] = -1  # of another dimension: never found, but kept
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(norm), pa.array(near)], names=["chunk_id", "snapshot_id", "model_id", "embedding", "norm", "list"])

    return run


def _stored(vectors: DataFrame, unit: np.ndarray) -> DataFrame:
    own = _sound(vectors).select("chunk_id", "snapshot_id", "model_id", F.col("embedding").cast("array<float>").alias("embedding"))
    return own.mapInArrow(_assigned(unit), _ROW)


def _write(rows: DataFrame, path: str, n: int, mode: str) -> None:
    dealt = rows.repartition("list", F.pmod(F.xxhash64("chunk_id"), F.lit(1 + n // (SLICE * LISTS))))
    dealt.sortWithinPartitions("list", "snapshot_id", "chunk_id").write.mode(mode).partitionBy("list").parquet(f"{path}/lists")


def build(vectors: DataFrame, path: str, *, lists: int = LISTS, seed: int = 42) -> None:
    """The index of vectors (chunk_id, snapshot_id, model_id, embedding); null, zero and non-finite ones are left out, as they have no direction."""
    unit = centres(vectors, lists, seed)
    rows = [(i, u.tolist()) for i, u in enumerate(unit)]
    vectors.sparkSession.createDataFrame(rows, "list int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    if len(unit):
        _write(_stored(vectors, unit), path, vectors.count(), "overwrite")


def _unit(spark: SparkSession, path: str) -> np.ndarray:
    """The centres, as many as lists."""
    rows = spark.read.schema("list int, centre array<double>").parquet(f"{path}/centres").orderBy("list").collect()
    return np.array([r["centre"] for r in rows])


def add(path: str, vectors: DataFrame) -> None:
    """Puts new vectors in the lists of their nearest centres, which stay as they are."""
    unit = _unit(vectors.sparkSession, path)
    if not len(unit):
        return build(vectors, path)
    _write(_stored(vectors, unit), path, vectors.count(), "append")


def probed(unit: np.ndarray, query: np.ndarray, probes: int) -> list[int]:
    """Numbers of the lists whose centres are nearest to a query."""
    return sorted(np.argsort(-(unit @ query), kind="stable")[:probes].tolist())


def search(spark: SparkSession, path: str, query: list[float], *, probes: int = PROBES, limit: int = 50, snapshot_id: int | None = None, model_id: str | None = None, max_dist: float | None = None) -> DataFrame:
    """chunk_id, dist of the nearest vectors in the probed lists; ties go to the lower id. Other folders aren't read."""
    unit, q = _unit(spark, path), np.asarray(query, float)
    if not len(unit) or not np.isfinite(q).all() or not q.any() or len(q) != unit.shape[1]:
        return spark.createDataFrame([], "chunk_id long, dist double")
    own = spark.read.schema(_ROW).parquet(f"{path}/lists").filter(F.col("list").isin(*probed(unit, q, probes)))
    own = own if snapshot_id is None else own.filter(F.col("snapshot_id") == snapshot_id)
    own = own if model_id is None else own.filter(F.col("model_id") == model_id)
    length = float(np.sqrt(q @ q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, len(q))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 - v @ q / (b.column(2).to_numpy() * length))], names=["chunk_id", "dist"])

    found = own.select("chunk_id", "embedding", "norm").mapInArrow(run, "chunk_id long, dist double").withColumn("dist", F.round("dist", DIGITS))
    found = found if max_dist is None else found.filter(F.col("dist") <= max_dist)
    return found.orderBy("dist", "chunk_id").limit(limit)


def search_all(spark: SparkSession, path: str, queries: DataFrame, *, probes: int = PROBES, limit: int = 10) -> DataFrame:
    """query_id, chunk_id, dist of the nearest vectors of each row of queries (query_id, vector), at most limit each.

    Queries travel to the lists that they probe. A list is dealt over slices that each meet all its queries and
    give limit rows a query, so neither a large list nor a popular one is one task's work.
    """
    unit = _unit(spark, path)
    stored = spark.read.schema(_ROW).parquet(f"{path}/lists")
    slices = 1 + stored.count() // (SLICE * max(1, len(unit)))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for query_id, vector in zip(b["query_id"], b["vector"], strict=True):
                q = np.asarray(vector, float)
                if len(q) == unit.shape[1] and np.isfinite(q).all() and q.any():
                    yield pd.DataFrame([(query_id, k, s, vector) for k in probed(unit, q, probes) for s in range(slices)], columns=["query_id", "list", "slice", "vector"])

    def compare(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        v = np.array(own["embedding"].tolist(), float) if len(own) else np.zeros((0, 1))
        norms, ids = own["norm"].to_numpy(), own["chunk_id"].to_numpy()
        for query_id, vector in zip(asked["query_id"], asked["vector"], strict=True) if len(own) else []:
            q = np.asarray(vector, float)
            dist = np.round(1 - v @ q / (norms * np.sqrt(q @ q)), DIGITS) + 0.0  # no negative zero
            at = np.lexsort((ids, dist))[:limit]
            out.append(pd.DataFrame({"query_id": query_id, "chunk_id": ids[at], "dist": dist[at]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "chunk_id": [], "dist": []})

    sent = queries.select("query_id", "vector").filter("vector is not null").mapInPandas(near, "query_id long, list int, slice int, vector array<double>")
    own = stored.select("chunk_id", "embedding", "norm", "list", F.pmod(F.xxhash64("chunk_id"), F.lit(slices)).cast("int").alias("slice"))
    found = own.groupBy("list", "slice").cogroup(sent.groupBy("list", "slice")).applyInPandas(compare, "query_id long, chunk_id long, dist double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "chunk_id"))
    return found.withColumn("_place", place).filter(F.col("_place") <= limit).drop("_place")


def _share(whole: DataFrame, part: DataFrame) -> float:
    found = whole.join(part.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left").agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0]
    return float(found) if found is not None else 1.0


def recall(spark: SparkSession, path: str, queries: DataFrame, *, probes: int = PROBES, limit: int = 10) -> float:
    """The share of the exact limit nearest vectors of the queries that the index finds."""
    whole = search_all(spark, path, queries, probes=len(_unit(spark, path)), limit=limit)
    return _share(whole, search_all(spark, path, queries, probes=probes, limit=limit))


def enough_probes(spark: SparkSession, path: str, queries: DataFrame, *, least: float = 0.9, limit: int = 10) -> int:
    """The fewest probes, of 1, 2, 4, … and all lists, with which the index reaches a recall of least for these queries."""
    lists, probes = len(_unit(spark, path)), 1
    whole = search_all(spark, path, queries, probes=lists, limit=limit).persist()  # limit rows a query
    try:
        while probes < lists and _share(whole, search_all(spark, path, queries, probes=probes, limit=limit)) < least:
            probes *= 2
    finally:
        whole.unpersist()
    return min(probes, lists)

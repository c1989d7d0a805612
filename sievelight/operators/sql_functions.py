"""Retrieval as table functions of SQL, over the views <name>_chunks and <name>_vectors.

SELECT * FROM lexical_search(1, 'borrow checker', array('rust'), 50), and so for vector_search and hybrid_retrieve.
Spark puts a function's query in place of its call, so filters reach the scan and the cut is a top-k of the plan, as
in the DataFrame forms in search.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_WORDS = r"array_distinct(regexp_extract_all(lower(p_query), '[\\p{L}\\p{N}]+', 0))"
_PLACED = rf"filter(transform(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+', 0), (w, i) -> named_struct('pos', i + 1, 't', CAST(array_position({_WORDS}, w) AS INT) - 1)), x -> x.t >= 0)"
_NONE = f"array_repeat(CAST(NULL AS INT), size({_WORDS}))"
_P, _J = "transform(s.p, (v, i) -> IF(i = x.t, x.pos, v))", "transform(s.j, (v, i) -> IF(i = x.t, s.entry + 1, v))"
#: The fold over minimal covers, as search.cover_rank() has it, for any number of words.
_RANK = f"""aggregate({_PLACED}, named_struct('p', {_NONE}, 'j', {_NONE}, 'entry', 0, 'start', CAST(NULL AS INT), 'rank', 0.0D),
  (s, x) -> named_struct('p', {_P}, 'j', {_J}, 'entry', s.entry + 1, 'start', IF(exists({_P}, v -> v IS NULL), s.start, array_min({_P})),
   'rank', s.rank + IF(exists({_P}, v -> v IS NULL) OR s.start <=> array_min({_P}), 0.0D, 0.1D / (1 + (x.pos - array_min({_P})) - (s.entry + 1 - array_min({_J}))))),
  s -> IF(s.start IS NULL, NULL, round(s.rank, 9)))"""

_LEXICAL = f"""CREATE OR REPLACE TEMPORARY FUNCTION lexical_search(p_snapshot BIGINT, p_query STRING, p_kinds ARRAY<STRING>, p_limit INT)
RETURNS TABLE (chunk_id BIGINT, rank DOUBLE)
RETURN SELECT chunk_id, rank FROM (
  SELECT chunk_id, rank, row_number() OVER (ORDER BY rank DESC, chunk_id) AS place FROM (
    SELECT chunk_id, {_RANK} AS rank FROM {{name}}_chunks
    WHERE (p_snapshot IS NULL OR snapshot_id = p_snapshot) AND (p_kinds IS NULL OR size(p_kinds) = 0 OR array_contains(p_kinds, kind))
      AND size({_WORDS}) > 0 AND forall({_WORDS}, w -> contains(lower(content), w))
  ) WHERE rank IS NOT NULL
) WHERE place <= p_limit"""

_DOT = "aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * y), 0.0D, (s, x) -> s + x)"
_VECTOR = f"""CREATE OR REPLACE TEMPORARY FUNCTION vector_search(p_snapshot BIGINT, p_model STRING, p_vector ARRAY<DOUBLE>, p_max_dist DOUBLE, p_limit INT)
RETURNS TABLE (chunk_id BIGINT, dist DOUBLE)
RETURN SELECT chunk_id, dist FROM (
  SELECT chunk_id, dist, row_number() OVER (ORDER BY dist, chunk_id) AS place FROM (
    SELECT chunk_id, CASE WHEN size(embedding) <> size(p_vector) THEN NULL WHEN exists(embedding, x -> x <> 0) AND exists(p_vector, x -> x <> 0)
      THEN round(1 - {_DOT.format(a="embedding", b="p_vector")} / (sqrt({_DOT.format(a="embedding", b="embedding")}) * sqrt({_DOT.format(a="p_vector", b="p_vector")})), 9) ELSE double('NaN') END AS dist
    FROM {{name}}_vectors WHERE (p_snapshot IS NULL OR snapshot_id = p_snapshot) AND (p_model IS NULL OR model_id = p_model)
  ) WHERE dist IS NOT NULL AND (p_max_dist IS NULL OR dist <= p_max_dist)
) WHERE place <= p_limit"""

_HYBRID = """CREATE OR REPLACE TEMPORARY FUNCTION hybrid_retrieve(p_snapshot BIGINT, p_query STRING, p_vector ARRAY<DOUBLE>, p_kinds ARRAY<STRING>, p_max_dist DOUBLE, p_top_k INT)
RETURNS TABLE (chunk_id BIGINT, excerpt STRING, kind STRING, lang STRING, meta STRING, dist DOUBLE, lexical_rank BIGINT, vector_rank BIGINT, rrf DOUBLE)
RETURN SELECT c.chunk_id, left(c.content, 200), c.kind, c.lang, c.meta, f.dist, f.lexical_rank, f.vector_rank, round(f.rrf, 12) FROM (
  SELECT *, row_number() OVER (ORDER BY round(rrf, 12) DESC, chunk_id) AS place FROM (
    SELECT chunk_id, dist, lexical_rank, vector_rank, coalesce({lexical_weight}D / ({k} + lexical_rank), 0.0D) + coalesce({vector_weight}D / ({k} + vector_rank), 0.0D) AS rrf FROM
      (SELECT chunk_id, CAST(row_number() OVER (ORDER BY rank DESC, chunk_id) AS BIGINT) AS lexical_rank FROM lexical_search(p_snapshot, p_query, p_kinds, greatest(p_top_k, 50)))
    FULL JOIN
      (SELECT chunk_id, min(rank) AS vector_rank, max(dist) AS dist FROM (
         SELECT v.chunk_id, v.dist, CAST(row_number() OVER (ORDER BY v.dist, v.chunk_id) AS BIGINT) AS rank FROM vector_search(p_snapshot, NULL, p_vector, p_max_dist, greatest(3 * p_top_k, 50)) v
         LEFT JOIN {name}_chunks k ON k.chunk_id = v.chunk_id WHERE p_kinds IS NULL OR size(p_kinds) = 0 OR array_contains(p_kinds, k.kind)) GROUP BY chunk_id)
    USING (chunk_id))
  ) f JOIN {name}_chunks c ON c.chunk_id = f.chunk_id AND (p_snapshot IS NULL OR c.snapshot_id = p_snapshot) WHERE f.place <= p_top_k"""


def register(spark: SparkSession, chunks: DataFrame, vectors: DataFrame, *, name: str = "evidence", k: int = 60, lexical_weight: float = 0.5, vector_weight: float = 0.5) -> None:
    """Makes the views and the table functions of a session: null snapshots, kinds, models and caps are no limit.

    Rows come in no order; rank, dist and rrf say it, and ties go to the lower chunk. A query without a word finds nothing.
    """
    chunks.createOrReplaceTempView(f"{name}_chunks")
    vectors.createOrReplaceTempView(f"{name}_vectors")
    for text in (_LEXICAL, _VECTOR):
        spark.sql(text.replace("{name}", name))
    spark.sql(_HYBRID.format(name=name, k=int(k), lexical_weight=float(lexical_weight), vector_weight=float(vector_weight)))

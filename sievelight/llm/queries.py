"""The training-data queries and, where SQL can express one, their DuckDB text."""

from __future__ import annotations

from sievelight.llm.decontamination import op13_benchmark_index
from sievelight.llm.embedding_dedup import linked_dedup, op6_subspace_dedup
from sievelight.llm.html_extract import op8_crf_extraction
from sievelight.llm.jaccard_join import op10_jaccard_join
from sievelight.llm.line_dedup import op2_line_chunks
from sievelight.llm.lm_scoring import op7_context_mixing
from sievelight.llm.packing import op4_curve_packing
from sievelight.llm.periodic_runs import op11_periodic_runs
from sievelight.llm.quality_rules import op3_quality_divergence
from sievelight.llm.sentencepieces import op5_shared_prefix_pieces
from sievelight.llm.sharding import op1_vector_sharding
from sievelight.llm.token_counts import op9_token_counts
from sievelight.llm.vector_codes import op12_vector_codes

QUERIES = {
    "op1_vector_sharding": op1_vector_sharding,
    "op2_line_chunks": op2_line_chunks,
    "op3_quality_divergence": op3_quality_divergence,
    "op4_curve_packing": op4_curve_packing,
    "op5_shared_prefix_pieces": op5_shared_prefix_pieces,
    "op6_subspace_dedup": op6_subspace_dedup,
    "op7_context_mixing": op7_context_mixing,
    "op8_crf_extraction": op8_crf_extraction,
    "op9_token_counts": op9_token_counts,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_vector_codes": op12_vector_codes,
    "op13_benchmark_index": op13_benchmark_index,
    "linked_dedup": linked_dedup,
}

#: The smallest id that links reach from every node: minima spread along links until nothing changes.
_REACH = """reach(id, least) AS (
    SELECT id, id FROM node
    UNION
    SELECT link.b, reach.least FROM reach JOIN link ON link.a = reach.id AND reach.least < link.b
)"""


def _links_sql(source: str) -> str:
    """Links and components of a table of vectors; moved is embeddings with two jittered rows of each."""
    shift = lambda k: f"list_transform(embedding, lambda x, i: x + ({k} * 0.005 + (vec_id % 7) * 0.004::DOUBLE) * (((i - 1) * {7 + k} + vec_id) % 5 - 2))"
    moved = f"""own AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding, label FROM embeddings),
once AS (SELECT vec_id + 1000000 AS vec_id, {shift(1)} AS embedding, label FROM own),
again AS (SELECT vec_id + 1000000 AS vec_id, {shift(2)} AS embedding, label FROM once),
moved AS (SELECT * FROM own UNION ALL SELECT * FROM once UNION ALL SELECT * FROM again),
""" if source == "moved" else ""
    return f"""
WITH RECURSIVE {moved}node AS MATERIALIZED (
    SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v,
           label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
           AND list_count(embedding) = len(embedding)
           AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0
           AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS sound
    FROM {source}
),
link AS MATERIALIZED (
    SELECT p.id AS a, q.id AS b
    FROM node p JOIN node q ON p.label = q.label AND p.id <> q.id AND len(p.v) = len(q.v)
    WHERE p.sound AND q.sound AND list_cosine_similarity(p.v, q.v) >= 0.93
),
{_REACH}
SELECT node.id AS vec_id, (SELECT count(*) FROM link WHERE link.a = node.id) AS n_links, min(reach.least) AS component_id,
       node.id = min(reach.least) AS kept
FROM node JOIN reach ON reach.id = node.id GROUP BY node.id
"""


def _code_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Rounds of assignment and of floors of means, one after another, as tables of parts and of codebook entries."""
    told = [
        f"""base AS MATERIALIZED (
    SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0
),
part AS MATERIALIZED (SELECT id, label, m, v[m * len(v) // {parts} + 1 : (m + 1) * len(v) // {parts}] AS p FROM base, range({parts}) AS parts(m)),
book0 AS MATERIALIZED (
    SELECT m, k, p FROM (SELECT m, p, row_number() OVER (PARTITION BY m ORDER BY id) - 1 AS k FROM part) WHERE k < {entries}
)"""
    ]
    for r in range(rounds + 1):
        told.append(f"""near{r} AS MATERIALIZED (
    SELECT part.id, part.label, part.m, part.p,
           min(row(CAST(list_sum(list_transform(list_zip(part.p, b.p), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), b.k)) AS best
    FROM part JOIN book{r} b ON part.m = b.m GROUP BY part.id, part.label, part.m, part.p
)""")
        if r < rounds:
            told.append(f"""mean{r} AS (
    SELECT m, k, list(x ORDER BY j) AS p FROM (
        SELECT m, best[2] AS k, j, CAST(floor(sum(p[j]) / count(*)) AS BIGINT) AS x
        FROM near{r}, range(1, (SELECT max(len(p)) FROM part) + 1) AS places(j) GROUP BY m, best[2], j
    ) GROUP BY m, k
),
book{r + 1} AS MATERIALIZED (SELECT m, k, coalesce(mean{r}.p, book{r}.p) AS p FROM book{r} LEFT JOIN mean{r} USING (m, k))""")
    told.append(f"""digest AS (SELECT sha256(string_agg(array_to_string(p, ','), ',' ORDER BY m, k)) AS codebooks_sha256 FROM book{rounds}),
coded AS (SELECT id, label, string_agg(lower(printf('%02x', best[2])), '' ORDER BY m) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM near{rounds} GROUP BY id, label)
SELECT id AS vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, digest
""")
    return "WITH " + ",\n".join(told)


ORACLE_SQL: dict[str, str] = {
    "op6_subspace_dedup": _links_sql("embeddings"),
    "linked_dedup": _links_sql("moved"),
    "op10_jaccard_join": f"""
WITH RECURSIVE words AS (
    SELECT doc_id AS id, list_filter(
        string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'),
        lambda w: w <> '') AS w
    FROM documents
),
sets AS MATERIALIZED (
    SELECT id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
                    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
    FROM words
),
token AS MATERIALIZED (SELECT id, len(s) AS n, unnest(s) AS t FROM sets),
link AS MATERIALIZED (
    SELECT p.id AS a, q.id AS b
    FROM token p JOIN token q ON p.t = q.t AND p.id <> q.id AND 10 * p.n >= 9 * q.n AND 10 * q.n >= 9 * p.n
    GROUP BY p.id, q.id, p.n, q.n
    HAVING 100 * count(*) >= 90 * (p.n + q.n - count(*))
),
node AS (SELECT id FROM sets),
{_REACH}
SELECT sets.id AS doc_id, len(sets.s) AS n_shingles, min(reach.least) AS component_id,
       (SELECT count(*) FROM link WHERE link.a = sets.id) AS n_links
FROM sets JOIN reach ON reach.id = sets.id GROUP BY sets.id, sets.s
""",
    "op12_vector_codes": _code_sql(),
    "op13_benchmark_index": """
WITH word AS MATERIALIZED (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w
    FROM documents
),
item AS MATERIALIZED (
    SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w
    FROM benchmark
),
phrase AS MATERIALIZED (
    SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i + 1 : i + 10], ' ') AS p
    FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 9, 1))) AS i FROM item WHERE len(w) > 0)
),
sizes AS MATERIALIZED (SELECT DISTINCT n FROM phrase),
place AS MATERIALIZED (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM word, sizes WHERE len(w) >= n),
hit AS MATERIALIZED (SELECT place.doc_id, place.i, place.n, phrase.item_id FROM place JOIN phrase ON place.n = phrase.n AND array_to_string(place.w[i + 1 : i + place.n], ' ') = phrase.p),
marked AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT word.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM word LEFT JOIN marked USING (doc_id) LEFT JOIN named USING (doc_id)
""",
}

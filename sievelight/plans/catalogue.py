"""Registered queries over the test data, and the same in SQL for DuckDB."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.functions import classes, diagnostics, diffs, features, text
from sievelight.operators import buckets, chunking, embedding, evidence, search, sql_functions, store, telemetry, text_index, vector_index
from sievelight.plans import views
from sievelight.plans.views import CODE_SQL, ITER_SQL, LOGS_SQL, METRICS_SQL, NL, SCORE_SQL, STEPS_SQL
from sievelight.session import shared_folder
from sievelight.sources import digested, writers
from sievelight.sources.readers import issues, logs, series, sf_table
from sievelight.streaming import counters

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# -- retrieval

TOKENS = ["the", "of"]
QUERY = "The of the"
_HITS = r"""toks AS (SELECT doc_id, source, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS a FROM documents),
 post AS (SELECT doc_id AS chunk_id, source, unnest(a) AS tok, generate_subscripts(a, 1) AS pos FROM toks),
 hit AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY pos) AS j FROM post WHERE tok IN ('the', 'of')),
 run AS (SELECT *, max(CASE WHEN tok = 'the' THEN pos END) OVER w AS p0, max(CASE WHEN tok = 'of' THEN pos END) OVER w AS p1, max(CASE WHEN tok = 'the' THEN j END) OVER w AS j0, max(CASE WHEN tok = 'of' THEN j END) OVER w AS j1
  FROM hit WINDOW w AS (PARTITION BY chunk_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 fin AS (SELECT chunk_id, source, pos, j, least(p0, p1) AS s, least(j0, j1) AS sj FROM run WHERE p0 IS NOT NULL AND p1 IS NOT NULL),
 cov AS (SELECT *, lag(s) OVER (PARTITION BY chunk_id ORDER BY pos) AS b FROM fin),
 scored AS (SELECT chunk_id, source, round(sum(0.1::double / (1 + (pos - s) - (j - sj))), 9) AS score FROM cov WHERE b IS NULL OR b <> s GROUP BY 1, 2),
 lex AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM (SELECT * FROM scored WHERE {kinds} ORDER BY score DESC, chunk_id LIMIT 50))"""


def _hits(kinds: str) -> str:
    return _HITS.replace("{kinds}", kinds)


_NEAR = """dist AS (SELECT vec_id AS chunk_id, label, vec_id % 4 AS snapshot_id, round(list_cosine_distance(embedding::double[], (SELECT embedding::double[] FROM embeddings WHERE vec_id = 0)), 9) AS dist FROM embeddings),
 near AS (SELECT chunk_id, dist, row_number() OVER (ORDER BY dist, chunk_id) AS rank FROM (SELECT * FROM dist ORDER BY dist, chunk_id LIMIT {limit}))"""
_FUSED = """fused AS (SELECT coalesce(l.chunk_id, v.chunk_id) AS chunk_id, l.rank AS lexical_rank, v.rank AS vector_rank, v.dist AS dist,
  coalesce(0.5::double / (60 + l.rank), 0) + coalesce(0.5::double / (60 + v.rank), 0) AS rrf FROM lex l FULL JOIN {near} v ON l.chunk_id = v.chunk_id)"""
_RISK = "CASE WHEN source = 'src1' THEN 6 WHEN source = 'src2' THEN 5 ELSE 0 END"


def _lexical(spark, sf_dir, kinds=None):
    found = search.lexical_search(views.chunks(spark, sf_dir), QUERY, kinds=kinds, limit=50, index=views.index(spark, sf_dir))
    return search.ranked(found, F.desc("rank"), F.col("chunk_id")).select("chunk_id", F.col("rank"))


@query(f"""WITH {_hits("true")}, {_NEAR.format(limit=60)}, {_FUSED.format(near="near")}, top AS (SELECT * FROM fused ORDER BY round(rrf, 12) DESC, chunk_id LIMIT 20)
 SELECT t.chunk_id, left(d.text, 200) AS excerpt, d.source AS kind, d.lang, t.dist, t.lexical_rank::bigint AS lexical_rank, t.vector_rank::bigint AS vector_rank, round(t.rrf, 12) AS rrf, ({_RISK})::bigint AS risk_score
 FROM top t JOIN documents d ON d.doc_id = t.chunk_id""")
def hybrid_rrf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: lexical and vector lists, fused, cut, and ordered with risk."""
    out = search.hybrid_retrieve(views.chunks(spark, sf_dir), views.vectors(spark, sf_dir), QUERY, views.query_vector(spark, sf_dir), top_k=20, index=views.index(spark, sf_dir))
    return out.select("chunk_id", "excerpt", "kind", "lang", "dist", F.col("lexical_rank").cast("long"), F.col("vector_rank").cast("long"), "rrf", F.col("risk_score").cast("long"))


@query(f"WITH {_hits('true')} SELECT chunk_id, score AS rank FROM scored ORDER BY score DESC, chunk_id LIMIT 50")
def lexical_search(spark, sf_dir):
    return search.lexical_search(views.chunks(spark, sf_dir), QUERY, limit=50)


@query(f"WITH {_hits('true')} SELECT chunk_id, score AS rank FROM scored ORDER BY score DESC, chunk_id LIMIT 50")
def indexed_search(spark, sf_dir):
    return search.lexical_search(views.chunks(spark, sf_dir), QUERY, limit=50, index=views.index(spark, sf_dir))


@query(f"WITH {_hits('true')} SELECT chunk_id, score AS rank FROM scored ORDER BY score DESC, chunk_id LIMIT 5")
def pruned_search(spark, sf_dir):
    """The best five by one range of ids first, and then those ranges whose bounds reach its fifth rank."""
    return text_index.search(spark, views.index(spark, sf_dir), QUERY, limit=5, first=1, whole=1, short=0).rows


@query(f"WITH {views.CHANGED_SQL}, {_hits('true').replace('FROM documents', 'FROM docs')} SELECT chunk_id, score AS rank FROM scored ORDER BY score DESC, chunk_id LIMIT 50")
def index_after_changes(spark, sf_dir):
    """An index after inserts, changes, deletes and a merge."""
    return text_index.search(spark, views.changed_index(spark, sf_dir), QUERY, limit=50).rows


@query(r"""WITH q AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM benchmark), qt AS (SELECT item_id, len(w) AS m, unnest(w) AS tok FROM q),
 d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS a FROM documents), post AS (SELECT doc_id, unnest(a) AS tok, generate_subscripts(a, 1) AS pos FROM d),
 hit AS MATERIALIZED (SELECT item_id, m, doc_id, post.tok, pos FROM post JOIN qt ON post.tok = qt.tok),
 full_ AS (SELECT item_id, doc_id FROM hit GROUP BY item_id, doc_id, m HAVING count(DISTINCT tok) = m),
 h AS MATERIALIZED (SELECT hit.*, row_number() OVER (PARTITION BY hit.item_id, hit.doc_id ORDER BY pos) AS j FROM hit JOIN full_ ON hit.item_id = full_.item_id AND hit.doc_id = full_.doc_id),
 run AS (SELECT h.item_id, h.doc_id, h.pos, h.j, max(CASE WHEN h.tok = qt.tok THEN h.pos END) OVER w AS p, max(CASE WHEN h.tok = qt.tok THEN h.j END) OVER w AS pj
  FROM h JOIN qt ON qt.item_id = h.item_id WINDOW w AS (PARTITION BY h.item_id, h.doc_id, qt.tok ORDER BY h.pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 fin AS (SELECT item_id, doc_id, pos, j, min(p) AS s, min(pj) AS sj FROM run GROUP BY 1, 2, 3, 4 HAVING count(p) = count(*)),
 cov AS (SELECT *, lag(s) OVER (PARTITION BY item_id, doc_id ORDER BY pos) AS b FROM fin),
 scored AS (SELECT item_id, doc_id, round(sum(0.1::double / (1 + (pos - s) - (j - sj))), 9) AS rank FROM cov WHERE b IS NULL OR b <> s GROUP BY 1, 2)
 SELECT item_id AS query_id, doc_id AS chunk_id, rank FROM scored QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY rank DESC, doc_id) <= 50""")
def batch_retrieval(spark, sf_dir):
    """All benchmark texts as queries against all documents."""
    asked = sf_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return text_index.search_all(spark, views.index(spark, sf_dir), asked, limit=50)


def _sql(spark, sf_dir, text: str) -> DataFrame:
    sql_functions.register(spark, views.chunks(spark, sf_dir), views.vectors(spark, sf_dir))
    return spark.sql(text)


@query(f"WITH {_hits('true')} SELECT chunk_id, score AS rank FROM scored ORDER BY score DESC, chunk_id LIMIT 50")
def sql_lexical_search(spark, sf_dir):
    return _sql(spark, sf_dir, f"SELECT * FROM lexical_search(NULL, '{QUERY}', NULL, 50)")


@query(f"WITH {_NEAR.format(limit=50)} SELECT chunk_id, dist FROM dist WHERE snapshot_id = 1 AND dist <= 0.95 ORDER BY dist, chunk_id LIMIT 50")
def sql_vector_search(spark, sf_dir):
    vector = ", ".join(f"{x!r}D" for x in views.query_vector(spark, sf_dir))
    return _sql(spark, sf_dir, f"SELECT * FROM vector_search(1, 'm', array({vector}), 0.95, 50)")


@query(f"""WITH {_hits("true")}, {_NEAR.format(limit=60)}, twice AS (SELECT chunk_id, rank, dist FROM near UNION ALL SELECT chunk_id, rank + 7, dist + 1 FROM near WHERE rank % 3 = 0),
 best AS (SELECT chunk_id, min(rank) AS rank, max(dist) AS dist FROM twice GROUP BY 1), {_FUSED.format(near="best")}
 SELECT chunk_id, lexical_rank::bigint AS lexical_rank, vector_rank::bigint AS vector_rank, dist, round(rrf, 12) AS rrf FROM fused""")
def rrf_repeated(spark, sf_dir):
    """Fusion where every third id of the vector list stands there twice: the best rank counts, and the largest distance."""
    near = search.ranked(search.vector_search(views.vectors(spark, sf_dir), views.query_vector(spark, sf_dir), limit=60), "dist", "chunk_id").select("chunk_id", "rank", "dist")
    twice = near.unionByName(near.filter("rank % 3 = 0").select("chunk_id", (F.col("rank") + 7).alias("rank"), (F.col("dist") + 1).alias("dist")))
    out = search.rrf(_lexical(spark, sf_dir), twice)
    return out.select("chunk_id", F.col("lexical_rank").cast("long"), F.col("vector_rank").cast("long"), "dist", F.round("rrf", 12).alias("rrf"))


@query(f"""WITH {_hits("source IN ('src1', 'src2')")}, {_NEAR.format(limit=60)},
 sub AS (SELECT n.chunk_id, n.dist, row_number() OVER (ORDER BY n.dist, n.chunk_id) AS rank FROM near n JOIN documents d ON d.doc_id = n.chunk_id WHERE d.source IN ('src1', 'src2')),
 {_FUSED.format(near="sub")} SELECT chunk_id, dist, lexical_rank::bigint AS lexical_rank, vector_rank::bigint AS vector_rank, round(rrf, 12) AS rrf FROM fused ORDER BY round(rrf, 12) DESC, chunk_id LIMIT 20""")
def sql_hybrid_retrieve(spark, sf_dir):
    vector = ", ".join(f"{x!r}D" for x in views.query_vector(spark, sf_dir))
    return _sql(spark, sf_dir, f"SELECT chunk_id, dist, lexical_rank, vector_rank, rrf FROM hybrid_retrieve(NULL, '{QUERY}', array({vector}), array('src1', 'src2'), NULL, 20)")


@query(r"""WITH toks AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS a FROM documents), post AS (SELECT doc_id, unnest(a) AS tok FROM toks)
 SELECT tok, count(*) AS n, count(DISTINCT doc_id) AS df FROM post GROUP BY tok""")
def postings_stats(spark, sf_dir):
    return search.postings(views.chunks(spark, sf_dir)).groupBy("tok").agg(F.count("*").alias("n"), F.countDistinct("chunk_id").alias("df"))


@query(f"WITH {_NEAR.format(limit=50)} SELECT chunk_id, dist FROM near")
def vector_topk(spark, sf_dir):
    return search.vector_search(views.vectors(spark, sf_dir), views.query_vector(spark, sf_dir), limit=50)


@query(f"WITH {_NEAR.format(limit=50)} SELECT chunk_id, dist FROM near")
def ivf_search(spark, sf_dir):
    """The approximate index with all its lists probed, which makes it exact."""
    return vector_index.search(spark, views.vector_lists(spark, sf_dir), views.query_vector(spark, sf_dir), probes=vector_index.LISTS, limit=50)


@query("""WITH v AS (SELECT vec_id, embedding::double[] AS e FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 100 = 0),
 near AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, round(list_cosine_distance(v.e, q.e), 9) + 0.0 AS dist FROM q, v)
 SELECT query_id, chunk_id, dist FROM near QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dist, chunk_id) <= 10""")
def ivf_batch(spark, sf_dir):
    """Every vector whose id is divisible by 100 as a query, against all lists."""
    return vector_index.search_all(spark, views.vector_lists(spark, sf_dir), _vector_queries(spark, sf_dir), probes=vector_index.LISTS, limit=10)


def _vector_queries(spark, sf_dir):
    own = sf_table(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0")
    return own.select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("vector"))


@query("SELECT count(*) AS n_queries, TRUE AS recall_reached, TRUE AS lists_left_out FROM embeddings WHERE vec_id % 100 = 0")
def ivf_recall(spark, sf_dir):
    """Whether the fewest probes that were found to do so reach a recall of 0.9, and leave lists out."""
    path, asked = views.vector_lists(spark, sf_dir), _vector_queries(spark, sf_dir)
    probes = vector_index.enough_probes(spark, path, asked)
    reached = vector_index.recall(spark, path, asked, probes=probes) >= 0.9
    return asked.agg(F.count("*").alias("n_queries")).withColumns({"recall_reached": F.lit(reached), "lists_left_out": F.lit(probes < vector_index.LISTS)})


@query(f"WITH {_NEAR.format(limit=50)} SELECT chunk_id, dist FROM dist WHERE snapshot_id = 1 AND dist <= 0.95 ORDER BY dist, chunk_id LIMIT 50")
def vector_snapshot_maxdist(spark, sf_dir):
    return search.vector_search(views.vectors(spark, sf_dir), views.query_vector(spark, sf_dir), snapshot_id=1, model_id="m", max_dist=0.95, limit=50)


@query(f"""WITH {_hits("true")}, {_NEAR.format(limit=60)}, {_FUSED.format(near="near")}
 SELECT chunk_id, lexical_rank::bigint AS lexical_rank, vector_rank::bigint AS vector_rank, round(rrf, 12) AS rrf FROM fused""")
def rrf_fusion(spark, sf_dir):
    near = search.ranked(search.vector_search(views.vectors(spark, sf_dir), views.query_vector(spark, sf_dir), limit=60), "dist", "chunk_id")
    out = search.rrf(_lexical(spark, sf_dir), near.select("chunk_id", "rank"))
    return out.select("chunk_id", F.col("lexical_rank").cast("long"), F.col("vector_rank").cast("long"), F.round("rrf", 12).alias("rrf"))


@query(f"""WITH {_hits("source IN ('src1', 'src2')")}, {_NEAR.format(limit=60)},
 sub AS (SELECT n.chunk_id, n.dist, row_number() OVER (ORDER BY n.dist, n.chunk_id) AS rank FROM near n JOIN documents d ON d.doc_id = n.chunk_id WHERE d.source IN ('src1', 'src2')),
 {_FUSED.format(near="sub")}, top AS (SELECT * FROM fused ORDER BY round(rrf, 12) DESC, chunk_id LIMIT 20)
 SELECT t.chunk_id, t.dist, round(t.rrf, 12) AS rrf, ({_RISK})::bigint AS risk_score FROM top t JOIN documents d ON d.doc_id = t.chunk_id""")
def vector_kind_postfilter(spark, sf_dir):
    out = search.hybrid_retrieve(views.chunks(spark, sf_dir), views.vectors(spark, sf_dir), QUERY, views.query_vector(spark, sf_dir), kinds=["src1", "src2"], top_k=20)
    return out.select("chunk_id", "dist", "rrf", F.col("risk_score").cast("long"))


@query(f"""WITH f AS (SELECT doc_id AS chunk_id, ({_RISK})::bigint AS risk_score, lang = 'en' AS code FROM documents)
 SELECT chunk_id, risk_score, code, row_number() OVER (ORDER BY code DESC, risk_score DESC, chunk_id DESC) AS place FROM f ORDER BY place LIMIT 100""")
def risk_rerank(spark, sf_dir):
    tags = F.from_json(F.get_json_object("meta", "$.risk_tags"), "array<string>")
    items = views.chunks(spark, sf_dir).select("chunk_id", F.col("chunk_id").alias("idx"), features.risk_score(tags).cast("long").alias("risk_score"), F.when(F.col("lang") == "en", "code_slice").otherwise("rule").alias("evidence_type"))
    top = search.prioritize(items).limit(100)
    code = F.col("evidence_type").startswith("code")
    return search.ranked(top, code.desc(), F.desc("risk_score"), F.desc("idx")).select("chunk_id", "risk_score", code.alias("code"), F.col("rank").cast("long").alias("place"))


# -- chunks and their features


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1")
def chunk_dedup_hash(spark, sf_dir):
    return views.chunks(spark, sf_dir).groupBy(text.content_hash(F.col("content")).alias("content_hash")).agg(F.min("chunk_id").alias("first_id"), F.count("*").alias("copies"))


@query(f"""WITH l AS (SELECT doc_id, string_split(text, {NL}) AS a0 FROM documents), l1 AS (SELECT doc_id, CASE WHEN a0[len(a0)] = '' THEN a0[1:len(a0) - 1] ELSE a0 END AS a FROM l),
 p AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) - 1 AS pos, len(a) AS n FROM l1)
 SELECT 'd' || doc_id AS path, (pos // 4)::bigint AS chunk_index, ((pos // 4) * 4)::bigint AS start_row, least((pos // 4) * 4 + 4, max(n))::bigint AS end_row, md5(string_agg(line, {NL} ORDER BY pos)) AS digest
 FROM p GROUP BY doc_id, pos // 4 HAVING regexp_matches(string_agg(line, {NL} ORDER BY pos), '\\S')""".replace("\\\\S", "\\S"))
def line_window_chunks(spark, sf_dir):
    files = views.chunks(spark, sf_dir).select(F.concat(F.lit("d"), F.col("chunk_id").cast("string")).alias("path"), "content")
    out = chunking.window_chunks(files, 4)
    return out.select("path", F.col("chunk_index").cast("long"), F.col("start_row").cast("long"), F.col("end_row").cast("long"), F.md5(F.col("content").cast("binary")).alias("digest"))


_ANY = lambda marks: " OR ".join(f"contains(content, '{m}')" for m in marks)
_TAGS = lambda rules: "concat_ws(',', " + ", ".join(f"CASE WHEN {_ANY(marks)} THEN '{tag}' END" for tag, marks in rules) + ")"


@query(f"WITH {CODE_SQL} SELECT path, {_TAGS(features.RISK_RULES)} AS tags FROM code")
def risk_tags(spark, sf_dir):
    return views.code(spark, sf_dir).select("path", F.array_join(features.risk_tags(F.col("content")), ",").alias("tags"))


@query(f"WITH {CODE_SQL} SELECT path, {_TAGS([(a, [a]) for a in features.API_NAMES])} AS tags FROM code")
def api_tags(spark, sf_dir):
    return views.code(spark, sf_dir).select("path", F.array_join(features.api_tags(F.col("content")), ",").alias("tags"))


@query(f"WITH {CODE_SQL} SELECT path, CASE WHEN k % 7 <> 0 THEN 'pub fn f' || k || '(a: *const u8)' END AS signature FROM code")
def signature(spark, sf_dir):
    return views.code(spark, sf_dir).select("path", features.signature(F.col("content")).alias("signature"))


@query(f"""WITH {CODE_SQL}, c AS (SELECT path, list_filter(l, lambda n, i: list_position(l, n) = i) AS x FROM (SELECT path, list_filter(regexp_extract_all(content, '\\b([A-Za-z_]\\w*)\\s*\\(', 1), lambda n: n NOT IN ('if', 'fn', 'unsafe', 'let', 'pub')) AS l FROM code))
 SELECT path, array_to_string(x, ',') AS names, len(x)::bigint AS n FROM c""")
def calls(spark, sf_dir):
    found = features.calls(F.col("content"))
    return views.code(spark, sf_dir).select("path", F.array_join(found, ",").alias("names"), F.size(found).cast("long").alias("n"))


_RISKY = "unsafe|[*]const|[*]mut|malloc|free|memcpy|memmove|[.]add[(]|[.]offset[(]"


@query(f"""WITH {CODE_SQL}, l AS (SELECT path, string_split(content, {NL}) AS a FROM code),
 m AS (SELECT path, len(a) AS n, list_position(list_transform(a, lambda x: regexp_matches(x, '{_RISKY}')), true) AS risk,
  list_position(list_transform(a, lambda x: regexp_matches(trim(x), '^(fn |pub fn |pub[(]crate[)] fn |pub[(]crate[)] unsafe fn |unsafe fn )')), true) AS sign FROM l),
 k AS (SELECT *, CASE WHEN risk > 0 THEN risk WHEN sign > 0 THEN sign ELSE 1 END AS anchor FROM m)
 SELECT path, greatest(1, anchor - 8)::bigint AS start_line, least(n, anchor + 8)::bigint AS end_line, anchor::bigint AS anchor_line,
 CASE WHEN risk > 0 THEN 'risk' WHEN sign > 0 THEN 'signature' ELSE 'start' END AS anchor_kind, CASE WHEN sign > 0 THEN sign END::bigint AS signature_line FROM k""")
def patch_boundary(spark, sf_dir):
    b = features.boundary(F.col("content"))
    return views.code(spark, sf_dir).select("path", *(c if n == "anchor_kind" else c.cast("long").alias(n) for n, c in ((n, c.alias(n)) for n, c in b.items())))


_COUNT = lambda marks: " + ".join(f"((length(content) - length(replace(content, '{m}', ''))) // {len(m)})" for m in marks)


@query(f"WITH {CODE_SQL} SELECT split_part(path, '/', 2) AS module, " + ", ".join(f"sum({_COUNT(m)})::bigint AS {n}" for n, m in features.SAFETY.items()) + " FROM code GROUP BY 1")
def safety_counts(spark, sf_dir):
    code = views.code(spark, sf_dir).select(F.split_part("path", F.lit("/"), F.lit(2)).alias("module"), *(c.alias(n) for n, c in features.safety_counts(F.col("content")).items()))
    return code.groupBy("module").agg(*(F.sum(n).alias(n) for n in features.SAFETY))


@query(f"""WITH {CODE_SQL}, l AS (SELECT content, unnest(string_split(content, {NL})) AS line FROM code),
 a AS (SELECT sum(len(regexp_extract_all(content, '\\bunsafe\\s*\\{{')))::bigint AS unsafe_blocks, sum(len(regexp_extract_all(content, '\\*const\\b|\\*mut\\b|\\bas\\s+\\*const\\b|\\bas\\s+\\*mut\\b')))::bigint AS raw_ptr_count FROM code),
 b AS (SELECT count(*) AS n, count(*) FILTER (WHERE contains(line, 'unsafe')) AS u FROM l) SELECT unsafe_blocks, round(u * 100.0::double / n, 9) AS unsafe_line_pct, raw_ptr_count FROM a, b""")
def source_metrics(spark, sf_dir):
    return telemetry.merged_source_measures(views.code(spark, sf_dir)).withColumn("unsafe_line_pct", F.round("unsafe_line_pct", 9))


@query("""WITH c AS (SELECT 'src/m' || (o_orderkey % 10) || '/f' || o_orderkey || '.rs' AS path, o_orderkey AS k, 2 + CASE WHEN o_orderkey % 3 = 0 THEN 1 WHEN o_orderkey % 5 = 0 THEN 3 ELSE 2 END AS n FROM orders)
 SELECT path, 0::bigint AS chunk_index, 0::bigint AS start_row, n::bigint AS end_row, CAST(NULL AS VARCHAR) AS degrade_reason FROM c WHERE k % 7 <> 0
 UNION ALL SELECT path, 1, n + 3, n + 8, NULL FROM c WHERE k % 7 <> 0
 UNION ALL SELECT path, 0, 0, n + 10, 'tree_sitter_error_nodes' FROM c WHERE k % 7 = 0""")
def function_slices(spark, sf_dir):
    """Function slices of source texts by tokens; texts whose brackets don't match are windows."""
    out = chunking.function_chunks(views.tricky_code(spark, sf_dir), chunking.rust_parser)
    return out.select("path", *(F.col(c).cast("long") for c in ("chunk_index", "start_row", "end_row")), "degrade_reason")


def _classed_sql(source: str) -> str:
    """The scan and the classes in SQL: rows (id, class, token) of source (id, text). Its engine allows no nested bounds of lengths, which no token here reaches."""
    q = lambda p: re.sub(r"\{1,\d+\}", "+", re.sub(r"\{0,\d+\}", "*", p)).replace("'", "''")
    hits = " ".join(f"WHEN regexp_full_match(t, '{q(p)}') THEN '{n}'" for n, p in classes.PATTERNS.items() if n != "word")
    kind = lambda c, a, b, d: f"CASE WHEN regexp_full_match({c}, '[A-Za-z-]+') THEN '{a}' WHEN regexp_matches({c}, '\\p{{N}}') THEN '{b}' ELSE '{d}' END"
    return f"""scanned AS (SELECT id, unnest(regexp_extract_all(text, '{q(classes.SCAN)}')) AS t FROM {source}),
 kinds AS MATERIALIZED (SELECT id, t, CASE {hits} ELSE 'word' END AS k FROM scanned),
 classed AS (SELECT id, CASE k WHEN 'hword' THEN {kind('t', 'asciihword', 'numhword', 'hword')} WHEN 'word' THEN CASE WHEN regexp_full_match(t, '[0-9]+') THEN 'uint' ELSE {kind('t', 'asciiword', 'numword', 'word')} END ELSE k END AS class, lower(t) AS token
   FROM kinds WHERE k NOT IN ('tag', 'entity', 'protocol')
  UNION ALL SELECT id, 'host', lower(split_part(t, '/', 1)) FROM kinds WHERE k = 'url' UNION ALL SELECT id, 'url_path', lower(regexp_extract(t, '/.*$')) FROM kinds WHERE k = 'url'
  UNION ALL SELECT id, {kind('p', 'hword_asciipart', 'hword_numpart', 'hword_part')}, lower(p) FROM (SELECT id, unnest(string_split(t, '-')) AS p FROM kinds WHERE k = 'hword'))"""


@query(f"WITH texts AS (SELECT page_id AS id, url || ' ' || html AS text FROM pages), {_classed_sql('texts')} SELECT id AS page_id, class, count(*) AS n, count(DISTINCT token) AS n_distinct, min(token) AS first, max(token) AS last FROM classed GROUP BY ALL")
def classed_pages(spark, sf_dir):
    """Tokens by class of every page's address and source."""
    own = sf_table(spark, sf_dir, "pages").select("page_id", F.explode(classes.classed_tokens(F.concat("url", F.lit(" "), "html"))).alias("t"))
    return own.groupBy("page_id", F.col("t.class").alias("class")).agg(F.count("*").alias("n"), F.countDistinct("t.token").alias("n_distinct"), F.min("t.token").alias("first"), F.max("t.token").alias("last"))


@query(f"WITH texts AS (SELECT doc_id AS id, text FROM documents), {_classed_sql('texts')} SELECT class, token, count(*) AS n, count(DISTINCT id) AS df FROM classed GROUP BY ALL")
def classed_words(spark, sf_dir):
    """Tokens by class of all documents."""
    own = sf_table(spark, sf_dir, "documents").select("doc_id", F.explode(classes.classed_tokens(F.col("text"))).alias("t"))
    return own.groupBy(F.col("t.class").alias("class"), F.col("t.token").alias("token")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("df"))


# -- diagnostics


@query(f"""WITH {LOGS_SQL} SELECT event_id, CASE WHEN event_id % 3 = 0 THEN regexp_extract(line, ' (E\\d+): ', 1) END AS error_code,
 CASE WHEN event_id % 3 < 2 THEN split_part(line, ':', 1) END AS file, CASE WHEN event_id % 3 < 2 THEN event_id * CASE WHEN event_id % 3 = 1 AND event_id % 97 = 0 THEN 100000000000 ELSE 1 END END::bigint AS line,
 CASE event_id % 3 WHEN 0 THEN regexp_extract(line, '(value is .*)', 1) WHEN 1 THEN regexp_extract(line, ':1: (.*)', 1) ELSE line END AS summary FROM logs""")
def diagnose_parse(spark, sf_dir):
    found = issues(views.logs(spark, sf_dir), "line")
    return found.select("event_id", "error_code", "file", F.col("line").cast("long"), "summary")


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 124 WHEN event_id % 3 = 0 THEN 0 ELSE 101 END AS code, lower(CASE WHEN event_id % 5 = 0 THEN 'thread: Assertion failed: x' WHEN event_id % 17 = 0 THEN 'a Timeout' ELSE 'plain' END) AS err,
  CASE WHEN event_id % 11 = 0 THEN 'patch_apply_failed: x' WHEN event_id % 13 = 0 THEN 'retrieve_no_results' WHEN event_id % 19 = 0 THEN 'patch_constraint_violation:too_large' ELSE '' END AS step FROM events)
 SELECT event_id, CASE WHEN starts_with(step, 'patch_constraint_violation:') THEN 'patch_constraint_violation' WHEN starts_with(step, 'patch_apply_failed:') THEN 'apply_fail' WHEN step = 'retrieve_no_results' THEN 'retrieve_empty'
  WHEN code = 124 OR contains(err, 'timeout') THEN 'timeout' WHEN contains(err, 'assertion failed') THEN 'test_fail' WHEN code <> 0 THEN 'compile_fail' ELSE 'unknown' END AS kind FROM e""")
def error_kind(spark, sf_dir):
    e = F.col("event_id")
    code = F.when(e % 4 == 0, 124).when(e % 3 == 0, 0).otherwise(101)
    err = F.when(e % 5 == 0, "thread: Assertion failed: x").when(e % 17 == 0, "a Timeout").otherwise("plain")
    step = F.when(e % 11 == 0, "patch_apply_failed: x").when(e % 13 == 0, "retrieve_no_results").when(e % 19 == 0, "patch_constraint_violation:too_large")
    return sf_table(spark, sf_dir, "events").select("event_id", diagnostics.error_kind(code, err, step).alias("kind"))


@query(f"""WITH {LOGS_SQL}, p AS (SELECT event_id, CASE WHEN event_id % 3 < 2 THEN split_part(line, ':', 1) END AS file, CASE WHEN event_id % 3 = 0 THEN regexp_extract(line, ' (E\\d+): ', 1) END AS code FROM logs)
 SELECT event_id, 'compile_fail|' || coalesce(file, '') || '|' || coalesce(code, '') AS signature, nullif(regexp_extract(file, '^(.*)/[^/]*$', 1), '') AS scope FROM p""")
def error_signature(spark, sf_dir):
    found = issues(views.logs(spark, sf_dir), "line")
    return found.select("event_id", diagnostics.error_signature(F.lit("compile_fail"), F.col("file"), F.col("error_code")).alias("signature"), diagnostics.scope(F.col("file")).alias("scope"))


@query("""WITH e AS (SELECT event_id, event_id % 2 = 0 AS good, CASE event_id % 3 WHEN 0 THEN 'x' || chr(10) || 'Test result: FAILED. ' || event_id % 7 || ' passed; 2 failed; y' WHEN 1 THEN 'running 9 tests' ELSE 'none' END AS t FROM events),
 f AS (SELECT *, try_cast(regexp_extract(t, '(?i)test result:\\s*(?:ok|FAILED)\\.\\s*(\\d+)\\s+passed;\\s+(\\d+)\\s+failed;', 1) AS int) AS p, try_cast(regexp_extract(t, '(?i)passed;\\s+(\\d+)\\s+failed;', 1) AS int) AS q, try_cast(regexp_extract(t, '(?i)running\\s+(\\d+)\\s+tests', 1) AS int) AS n FROM e)
 SELECT event_id, CASE WHEN p IS NOT NULL THEN p WHEN n IS NOT NULL THEN CASE WHEN good THEN n ELSE 0 END ELSE good::int END::bigint AS passed, CASE WHEN p IS NOT NULL THEN p + q WHEN n IS NOT NULL THEN n ELSE 1 END::bigint AS total FROM f""")
def pass_rate(spark, sf_dir):
    e = F.col("event_id")
    out = F.when(e % 3 == 0, F.format_string("x\nTest result: FAILED. %d passed; 2 failed; y", (e % 7).cast("int"))).when(e % 3 == 1, "running 9 tests").otherwise("none")
    counts = diagnostics.pass_counts(out, F.lit(""), F.when(e % 2 == 0, 0).otherwise(101))
    return sf_table(spark, sf_dir, "events").select("event_id", counts["passed"].cast("long").alias("passed"), counts["total"].cast("long").alias("total"))


# -- telemetry

_PIVOT = ", ".join(f"max(CASE WHEN key = '{k}' THEN v END) AS {k}" for k in views.METRIC_KEYS)


@query(f"WITH {METRICS_SQL} SELECT run_id, {_PIVOT} FROM latest GROUP BY 1")
def metrics_pivot(spark, sf_dir):
    return telemetry.metrics_pivot(telemetry.latest_metrics(views.metrics(spark, sf_dir)), views.METRIC_KEYS)


@query(f"WITH {STEPS_SQL} SELECT run_id, min(seq) AS seq, arg_min(snapshot, seq)::bigint AS snapshot FROM steps WHERE step_name = 'INIT' GROUP BY 1")
def first_init_step(spark, sf_dir):
    return telemetry.first_step(views.steps(spark, sf_dir), "INIT").select("run_id", "seq", F.get_json_object("input_json", "$.snapshot_id").cast("long").alias("snapshot"))


@query(f"WITH {STEPS_SQL} SELECT run_id, step_name, max(seq) AS seq, arg_max(ms, seq) AS ms FROM steps GROUP BY 1, 2")
def last_step_by_name(spark, sf_dir):
    return telemetry.last_steps(views.steps(spark, sf_dir)).select("run_id", "step_name", "seq", "ms")


@query(f"""WITH {STEPS_SQL} SELECT run_id, sum(ms)::bigint AS total_ms, coalesce(sum(ms) FILTER (WHERE step_name = 'RETRIEVE'), 0)::bigint AS retrieve_ms, coalesce(sum(ms) FILTER (WHERE step_name = 'GENERATE'), 0)::bigint AS generate_ms,
 coalesce(sum(ms) FILTER (WHERE step_name = 'EXECUTE'), 0)::bigint AS execute_ms FROM steps GROUP BY 1""")
def step_durations(spark, sf_dir):
    return telemetry.step_durations(views.steps(spark, sf_dir))


@query(f"WITH {STEPS_SQL} SELECT run_id, coalesce(bool_or(ok) FILTER (WHERE step_name = 'APPLY'), false) AS has_apply, coalesce(bool_or(ok) FILTER (WHERE step_name = 'EXECUTE'), false) AS has_execute FROM steps GROUP BY 1")
def step_flags(spark, sf_dir):
    return telemetry.step_flags(views.steps(spark, sf_dir), ["APPLY", "EXECUTE"])


@query(f"WITH {CODE_SQL}, t AS (SELECT 'm' || (k % 10) AS run_id, unnest(string_split({_TAGS(features.RISK_RULES)}, ',')) AS tag FROM code) SELECT run_id, tag, count(*) AS n FROM t WHERE tag <> '' GROUP BY 1, 2")
def tag_frequency(spark, sf_dir):
    items = views.code(spark, sf_dir).select(F.concat(F.lit("m"), (F.col("k") % 10).cast("string")).alias("run_id"), F.lit("code_slice").alias("evidence_type"), features.risk_tags(F.col("content")).alias("risk_tags"))
    return telemetry.tag_counts(items)


def _runs(spark, sf_dir):
    return sf_table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("run_id")).agg(F.max("ts").alias("created_at")).withColumn("status", F.lit("STOP"))


def _patches(spark, sf_dir):
    e = sf_table(spark, sf_dir, "events").filter("event_type = 'error'")
    return e.select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("seq"), F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("file_path"), F.lit("applied").alias("status"))


_RUNS = "runs AS (SELECT user_id::varchar AS run_id, max(ts) AS created_at, 'STOP' AS status FROM events GROUP BY 1), patches AS (SELECT user_id::varchar AS run_id, event_id AS seq, 'f' || event_id AS file_path FROM events WHERE event_type = 'error')"


@query(f"WITH {_RUNS} SELECT run_id, created_at FROM runs ORDER BY created_at DESC, run_id LIMIT 25")
def recent_runs(spark, sf_dir):
    return telemetry.recent_runs(_runs(spark, sf_dir), 25).select("run_id", "created_at")


@query(f"""WITH {STEPS_SQL}, {METRICS_SQL}, {_RUNS}, wide AS (SELECT run_id, {_PIVOT} FROM latest GROUP BY 1),
 ini AS (SELECT run_id, arg_min(snapshot, seq)::bigint AS snapshot FROM steps WHERE step_name = 'INIT' GROUP BY 1), pc AS (SELECT run_id, count(*) AS n FROM patches GROUP BY 1)
 SELECT r_name AS project, i.snapshot, n_name AS commit, r.run_id, CASE WHEN mode IN ('baseline', 'enhanced') THEN mode WHEN coalesce(pc.n, 0) > 0 THEN 'enhanced' ELSE 'baseline' END AS mode,
 CASE WHEN final_status = 'OK' OR primary_error_kind = 'test_fail' THEN 1 ELSE 0 END::bigint AS compile_ok, CASE WHEN final_status = 'OK' THEN 1 ELSE 0 END::bigint AS test_ok, final_status, iteration_count, coalesce(pc.n, 0)::bigint AS patch_rounds, total_ms, primary_error_kind
 FROM runs r LEFT JOIN ini i USING (run_id) LEFT JOIN nation ON n_nationkey = i.snapshot LEFT JOIN region ON r_regionkey = n_regionkey LEFT JOIN wide w ON w.run_id = r.run_id LEFT JOIN pc ON pc.run_id = r.run_id""")
def experiments_report(spark, sf_dir):
    snapshots = sf_table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("snapshot_id"), F.col("n_regionkey").alias("project_id"), F.col("n_name").alias("commit_sha"))
    projects = sf_table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("project_id"), F.col("r_name").alias("name"))
    out = telemetry.experiments_report(_runs(spark, sf_dir), views.steps(spark, sf_dir), telemetry.latest_metrics(views.metrics(spark, sf_dir)), _patches(spark, sf_dir), snapshots, projects)
    return out.select("project", "snapshot", "commit", "run_id", "mode", F.col("compile_ok").cast("long"), F.col("test_ok").cast("long"), "final_status", "iteration_count", F.col("patch_rounds").cast("long"), "total_ms", "primary_error_kind")


@query(f"""WITH {STEPS_SQL}, {METRICS_SQL}, {_RUNS}, wide AS (SELECT run_id, {_PIVOT} FROM latest GROUP BY 1),
 ls AS (SELECT run_id, step_name, arg_max(k, seq) AS k, arg_max(issues, seq) AS issues FROM steps GROUP BY 1, 2), s AS (SELECT run_id, max(CASE WHEN step_name = 'GENERATE' THEN 'f' || k END) AS target,
  max(CASE WHEN step_name = 'EXECUTE' THEN k END)::bigint AS ec, max(CASE WHEN step_name = 'DIAGNOSE' THEN issues END) AS issues, max(CASE WHEN step_name = 'RETRIEVE' THEN 1 END) AS items FROM ls GROUP BY 1),
 ns AS (SELECT run_id, count(*) AS n FROM steps GROUP BY 1), pc AS (SELECT run_id, count(*) AS n, arg_min(file_path, seq) AS f FROM patches GROUP BY 1)
 SELECT r.run_id, ns.n::bigint AS n_steps, coalesce(pc.n, 0)::bigint AS n_patches, coalesce(s.items, 0)::bigint AS evidence_count, coalesce(s.issues, 0)::bigint AS diagnose_issue_count, coalesce(s.target, pc.f, '') AS target_file,
 CASE WHEN pc.n > 0 THEN 'applied' ELSE '' END AS patch_status, s.ec AS execute_exit_code, coalesce(w.final_status, r.status) AS final_status, w.total_ms
 FROM runs r LEFT JOIN s ON s.run_id = r.run_id LEFT JOIN ns ON ns.run_id = r.run_id LEFT JOIN pc ON pc.run_id = r.run_id LEFT JOIN wide w ON w.run_id = r.run_id""")
def run_summary(spark, sf_dir):
    out = telemetry.run_summary(_runs(spark, sf_dir), views.steps(spark, sf_dir), telemetry.latest_metrics(views.metrics(spark, sf_dir)), _patches(spark, sf_dir))
    return out.select("run_id", "n_steps", "n_patches", "evidence_count", "diagnose_issue_count", "target_file", "patch_status", F.col("execute_exit_code").cast("long"), "final_status", "total_ms")


@query("SELECT event_type, count(value) AS n, min(value) AS min, quantile_disc(value, 0.95) AS p, max(value) AS max FROM events GROUP BY 1")
def latency_p95(spark, sf_dir):
    return telemetry.percentile(sf_table(spark, sf_dir, "events"), "value", 0.95, ["event_type"])


# -- convergence


@query(f"""WITH {ITER_SQL}, s AS (SELECT *, lag(l_linestatus) OVER w AS b, row_number() OVER w AS rn FROM it WINDOW w AS (PARTITION BY run_id ORDER BY iter)), g AS (SELECT *, sum(CASE WHEN rn > 1 AND b = l_linestatus THEN 0 ELSE 1 END) OVER (PARTITION BY run_id ORDER BY iter) AS island FROM s)
 SELECT run_id, iter::bigint AS iter, row_number() OVER (PARTITION BY run_id, island ORDER BY iter) - 1 AS streak FROM g""")
def no_progress_streak(spark, sf_dir):
    return telemetry.no_progress(views.iterations(spark, sf_dir), "l_linestatus").select("run_id", F.col("iter").cast("long"), "streak")


def _scored(spark, sf_dir):
    score = telemetry.score(F.col("blocks"), F.col("pct"), F.col("ptrs"), F.col("rate"), F.col("failed"))
    return views.iterations(spark, sf_dir).withColumn("score", score)


@query(f"""WITH {ITER_SQL}, s AS (SELECT run_id, iter, {SCORE_SQL} FROM it), o AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY a, b, c, d, iter) AS place FROM s),
 m AS (SELECT run_id, iter, min(place) OVER (PARTITION BY run_id ORDER BY iter ROWS UNBOUNDED PRECEDING) AS best FROM o) SELECT m.run_id, m.iter::bigint AS iter, o.iter::bigint AS best_iter, (m.iter - o.iter)::bigint AS stale FROM m JOIN o ON o.run_id = m.run_id AND o.place = m.best""")
def running_best(spark, sf_dir):
    return telemetry.running_best(_scored(spark, sf_dir)).select("run_id", F.col("iter").cast("long"), F.col("best_iter").cast("long"), "stale")


@query(f"WITH {ITER_SQL}, s AS (SELECT run_id, iter, {SCORE_SQL} FROM it) SELECT run_id, iter::bigint AS iter FROM s QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY a, b, c, d, iter) = 1")
def argmin_score(spark, sf_dir):
    return telemetry.best(_scored(spark, sf_dir)).select("run_id", F.col("iter").cast("long"))


# -- store


@query("SELECT doc_id AS chunk_id, source AS kind, lang FROM documents WHERE doc_id % 4 = 2 ORDER BY chunk_id LIMIT 50 OFFSET 10")
def paged_list(spark, sf_dir):
    own = views.chunks(spark, sf_dir).filter("snapshot_id = 2").select("chunk_id", "kind", "lang")
    return store.page(own, "chunk_id", limit=50, offset=10)


@query("SELECT doc_id AS chunk_id, left(text, 200) AS excerpt FROM documents WHERE source IN ('src1', 'src3')")
def kind_filter(spark, sf_dir):
    return search.kind_filter(views.chunks(spark, sf_dir), ["src1", "src3"]).select("chunk_id", text.excerpt(F.col("content")).alias("excerpt"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')")
def fk_orphans(spark, sf_dir):
    parents = sf_table(spark, sf_dir, "customer").filter("c_mktsegment <> 'BUILDING'")
    return store.orphans(sf_table(spark, sf_dir, "orders"), parents, "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


@query("SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def unique_violations(spark, sf_dir):
    return store.repeated(sf_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey"])


@query("""WITH n AS (SELECT n_nationkey FROM nation WHERE n_regionkey <> 1), c AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT * FROM n)), o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT * FROM c))
 SELECT 'nation' AS name, n_nationkey::bigint AS id FROM n UNION ALL SELECT 'customer', c_custkey FROM c UNION ALL SELECT 'orders', o_orderkey FROM o""")
def cascade_delete(spark, sf_dir):
    t = lambda n: sf_table(spark, sf_dir, n)
    _, nation, customer, orders = store.cascade_delete([(t("region"), "r_regionkey", None), (t("nation"), "n_nationkey", "n_regionkey"), (t("customer"), "c_custkey", "c_nationkey"), (t("orders"), "o_orderkey", "o_custkey")], [1])
    ids = lambda df, name, key: df.select(F.lit(name).alias("name"), F.col(key).cast("long").alias("id"))
    return ids(nation, "nation", "n_nationkey").union(ids(customer, "customer", "c_custkey")).union(ids(orders, "orders", "o_orderkey"))


@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events WHERE event_id >= 100 GROUP BY 1, 2 UNION ALL SELECT user_id, event_type, event_id, value FROM (SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events WHERE event_id < 100 GROUP BY 1, 2) s WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.event_id >= 100 AND e.user_id = s.user_id AND e.event_type = s.event_type)")
def upsert_latest(spark, sf_dir):
    events = sf_table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    keys = ["user_id", "event_type"]
    stored = store.upsert_latest(events.limit(0), events.filter("event_id < 100"), keys, "event_id")
    return store.upsert_latest(stored, events.filter("event_id >= 100"), keys, "event_id")


@query("SELECT c_custkey AS k, 'stored' AS origin FROM customer UNION ALL SELECT p_partkey, 'new' FROM part WHERE p_partkey NOT IN (SELECT c_custkey FROM customer)")
def insert_ignore(spark, sf_dir):
    stored = sf_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit("stored").alias("origin"))
    rows = sf_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.lit("new").alias("origin"))
    return store.insert_ignore(stored, rows.union(rows), ["k"])


def _inserted(spark, sf_dir):
    """All documents offered as chunks; every second one lacks what its metadata need."""
    rows = views.chunks(spark, sf_dir).select(F.lit(7).cast("long").alias("snapshot_id"), "kind", "lang", "content", F.when(F.col("chunk_id") % 2 == 0, F.col("meta")).otherwise("{}").alias("meta"))
    stored = rows.limit(0).withColumns({"content_hash": F.lit("").cast("string"), "chunk_id": F.lit(0).cast("long")})
    return store.insert_chunks(stored, spark.range(7, 8).withColumnRenamed("id", "snapshot_id"), rows)


@query("""SELECT source AS kind, lang, sha256(text) AS content_hash, CAST(NULL AS VARCHAR) AS reason FROM documents WHERE doc_id % 2 = 0 GROUP BY ALL
 UNION ALL SELECT source, lang, sha256(text), 'meta_file' FROM documents WHERE doc_id % 2 <> 0""")
def insert_chunks(spark, sf_dir):
    new, refused = _inserted(spark, sf_dir)
    names = ["kind", "lang", "content_hash"]
    return new.select(*names, F.lit(None).cast("string").alias("reason")).union(refused.select(*names, "reason"))


@query("SELECT count(*) AS n, 1::bigint AS first, count(*) AS last FROM (SELECT 1 FROM documents WHERE doc_id % 2 = 0 GROUP BY source, lang, sha256(text))")
def insert_ids(spark, sf_dir):
    return _inserted(spark, sf_dir)[0].agg(F.countDistinct("chunk_id").alias("n"), F.min("chunk_id").alias("first"), F.max("chunk_id").alias("last"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 7")
def point_lookup(spark, sf_dir):
    return store.point(sf_table(spark, sf_dir, "orders"), "o_orderkey", 7).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'R' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def update_status(spark, sf_dir):
    changes = sf_table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.lit("R").alias("o_orderstatus"))
    return store.update(sf_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"], changes)


@query("""SELECT n_name AS name, CASE WHEN n_regionkey = 1 THEN 'fresh' ELSE 'old' END AS meta, false AS made FROM nation UNION ALL SELECT DISTINCT c_mktsegment, 'fresh', true FROM customer""")
def get_or_create(spark, sf_dir):
    nation = sf_table(spark, sf_dir, "nation")
    stored = nation.select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.lit("old").alias("meta"))
    rows = nation.filter("n_regionkey = 1").select(F.col("n_name").alias("name")).union(sf_table(spark, sf_dir, "customer").select("c_mktsegment"))
    out = store.get_or_create(stored, rows.withColumn("meta", F.lit("fresh")), ["name"], "id", refresh=("meta",))
    return out.select("name", "meta", (F.col("id") > 24).alias("made"))


@query("""WITH r AS (SELECT event_id::varchar AS run_id, CASE event_id % 4 WHEN 0 THEN 'STOP' WHEN 1 THEN 'odd' WHEN 2 THEN 'FAILED' ELSE 'INIT' END AS status FROM events)
 SELECT run_id, status, CASE WHEN status = 'odd' THEN 'status' WHEN run_id IN (SELECT c_custkey::varchar FROM customer) THEN 'unique' END AS reason FROM r
 UNION ALL SELECT c_custkey::varchar, 'INIT', NULL FROM customer""")
def created_runs(spark, sf_dir):
    e = F.col("event_id")
    stored = sf_table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("run_id"), F.lit("INIT").alias("status"))
    rows = sf_table(spark, sf_dir, "events").select(e.cast("string").alias("run_id"), F.when(e % 4 == 0, "STOP").when(e % 4 == 1, "odd").when(e % 4 == 2, "FAILED").alias("status"))
    new, refused = store.create_runs(stored, rows)
    return new.select("run_id", "status", F.lit(None).cast("string").alias("reason")).union(refused.select("run_id", "status", "reason"))


# -- sources and sinks


@query("SELECT doc_id AS k, octet_length(encode(text)) >= 10240 AS spilled, CASE WHEN octet_length(encode(text)) >= 10240 THEN 0 ELSE octet_length(encode(text)) END::bigint AS stdout_bytes, CASE WHEN octet_length(encode(text)) >= 10240 THEN '' ELSE lang END AS stderr FROM documents")
def spilled_output(spark, sf_dir):
    slim, _ = writers.spill(sf_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), F.col("text").alias("stdout"), F.col("lang").alias("stderr")))
    return slim.select("k", "spilled", F.octet_length("stdout").cast("long").alias("stdout_bytes"), "stderr")


@query("SELECT event_id FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 7 DAY")
def old_files(spark, sf_dir):
    events = sf_table(spark, sf_dir, "events")
    return writers.retention(events.withColumn("modificationTime", F.col("ts")), events.agg(F.max("ts")).scalar()).select("event_id")


@query("SELECT c_custkey, format('{:.2f}', c_acctbal / 8) AS shown FROM customer")
def two_decimals(spark, sf_dir):
    return sf_table(spark, sf_dir, "customer").select("c_custkey", text.fixed2(F.col("c_acctbal") / 8).alias("shown"))


@query("SELECT n FROM range(3, 1001, 7) t(n)")
def number_series(spark, sf_dir):
    return series(spark, 3, 1000, 7)


@query(f"""WITH {views.RUNNER_SQL}, j AS (SELECT event_id, content, CASE WHEN content LIKE '  {{%' THEN json_extract_string(content, '$.stderr') END AS e, CASE WHEN content LIKE '  {{%' THEN json_extract_string(content, '$.stdout') END AS o FROM logs)
 SELECT event_id, CASE WHEN e IS NULL THEN content WHEN trim(e, ' ' || {NL}) <> '' THEN e ELSE o END AS payload FROM j""")
def runner_payload(spark, sf_dir):
    return views.runner_logs(spark, sf_dir).select("event_id", diagnostics.payload(F.col("content")).alias("payload"))


# -- diffs

@query(f"""WITH {views.DIFFS_SQL} SELECT id, CASE WHEN len(l) > 120 THEN 'too_large' WHEN len(list_filter(changed, lambda x: contains(x[2:], 'pub fn keep()'))) > 0 THEN 'signature_changed'
  WHEN len(files) = 0 THEN 'missing_file_header' WHEN len(files) > 1 THEN 'multi_file_patch' WHEN files[1] <> 'f.rs' THEN 'target_file_mismatch' WHEN len(hunks) <> 1 THEN 'multi_hunk'
  WHEN len(changed) = 0 THEN 'no_changes' WHEN len(changed) > 40 THEN 'too_many_changes' WHEN len(starts) = 0 THEN 'missing_hunk_header' WHEN starts[1]::bigint NOT BETWEEN 1 AND 20 THEN 'outside_boundary' END AS violation,
 contains(diff, '@@ ') AND len(list_filter(l, lambda x: x <> '' AND NOT regexp_matches(x, '^(--- |[+][+][+] |@@ |[+]|-| )'))) = 0 AS only_hunks, len(changed) AS n_changed FROM begun""")
def diff_constraints(spark, sf_dir):
    d = F.col("diff")
    found = diffs.violation(d, F.lit("f.rs"), F.lit("pub fn keep()"), F.lit(1), F.lit(20))
    return views.diffs(spark, sf_dir).select("id", found.alias("violation"), diffs.only_hunks(d).alias("only_hunks"), F.size(diffs.changed_lines(d)).cast("long").alias("n_changed"))


@query(f"""SELECT doc_id AS chunk_id, source || '/' AS file, 'code' AS evidence_type, CASE source WHEN 'src1' THEN 'unsafe,raw_ptr' WHEN 'src2' THEN 'manual_mem,unsafe,other' ELSE '' END AS tags, ({_RISK})::bigint AS risk_score FROM documents""")
def evidence_items(spark, sf_dir):
    out = evidence.items(views.chunks(spark, sf_dir))
    return out.select("chunk_id", "file", "evidence_type", F.array_join("risk_tags", ",").alias("tags"), F.col("risk_score").cast("long"))


@query("""WITH s AS (SELECT event_id, user_id, CASE event_id % 5 WHEN 0 THEN 'code_slice' WHEN 1 THEN 'replacement_strategy' WHEN 2 THEN 'rust_rule_snippet_x' ELSE 'note' END AS t FROM events)
 SELECT event_id, user_id FROM s WHERE t IN ('replacement_strategy', 'rust_rule_snippet_x') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 10""")
def strategies_of_runs(spark, sf_dir):
    e = F.col("event_id")
    kind = F.when(e % 5 == 0, "code_slice").when(e % 5 == 1, "replacement_strategy").when(e % 5 == 2, "rust_rule_snippet_x").otherwise("note")
    rows = sf_table(spark, sf_dir, "events").select("event_id", "user_id", kind.alias("evidence_type"))
    return evidence.strategies(rows, "event_id", "user_id").select("event_id", "user_id")


@query(f"""WITH {CODE_SQL} SELECT path, '--- a/' || path || {NL} || '+++ b/' || path || {NL} || CASE WHEN k % 7 = 0 THEN '@@ -1,1 +1,1 @@' || {NL} || '-// nothing' || {NL} || '+// nothing // patched'
 ELSE '@@ -2,1 +2,1 @@' || {NL} || '-' || split_part(content, {NL}, 2) || {NL} || '+' || split_part(content, {NL}, 2) || ' // patched' END || {NL} AS diff FROM code""")
def template_diffs(spark, sf_dir):
    return views.code(spark, sf_dir).select("path", evidence.template_diff(F.col("path"), F.col("content"), edit=True).alias("diff"))


_KINDS = "CASE event_id % 5 WHEN 0 THEN 'code_slice' WHEN 1 THEN 'replacement_strategy' WHEN 2 THEN 'rust_rule_snippet_x' ELSE 'note' END"


def _evidence(spark, sf_dir):
    e = F.col("event_id")
    kind = F.when(e % 5 == 0, "code_slice").when(e % 5 == 1, "replacement_strategy").when(e % 5 == 2, "rust_rule_snippet_x").otherwise("note")
    return sf_table(spark, sf_dir, "events").select(e.alias("idx"), F.concat(F.lit("f"), (F.col("user_id") % 50).cast("string")).alias("file"), kind.alias("evidence_type"))


@query(f"SELECT event_id AS idx, CASE WHEN {_KINDS} LIKE 'code%' THEN 'code' ELSE 'rest' END AS part FROM events")
def split_evidence(spark, sf_dir):
    code, rest = evidence.split(_evidence(spark, sf_dir))
    return code.select("idx", F.lit("code").alias("part")).union(rest.select("idx", F.lit("rest").alias("part")))


@query(f"""WITH i AS (SELECT event_id AS idx, 'f' || user_id % 50 AS file, {_KINDS} AS t FROM events),
 p AS (SELECT min(idx) AS picked FROM i WHERE t LIKE 'code%' AND file IN (SELECT 'f' || s_nationkey FROM supplier))
 SELECT idx, row_number() OVER (ORDER BY CASE WHEN idx = picked THEN 0 ELSE 1 END, idx) AS place FROM i, p""")
def target_pick(spark, sf_dir):
    files = sf_table(spark, sf_dir, "supplier").select(F.concat(F.lit("f"), F.col("s_nationkey").cast("string")).alias("path"))
    return evidence.target_first(_evidence(spark, sf_dir), files).select("idx", F.col("place").cast("long").alias("place"))


@query("""SELECT c_custkey, 'Repair ' || c_name || ' of {unknown} in ' || c_mktsegment || ', then ' || c_name AS prompt,
 regexp_matches('Repair ' || c_name || ' of {unknown} in ' || c_mktsegment || ', then ' || c_name, 'Repair.*BUILDING.*then') AS in_order FROM customer""")
def rendered_prompt(spark, sf_dir):
    prompt = evidence.render(F.lit("Repair {name} of {unknown} in {segment}, then {name}"), {"name": F.col("c_name"), "segment": F.col("c_mktsegment")})
    return sf_table(spark, sf_dir, "customer").select("c_custkey", prompt.alias("prompt"), evidence.has_in_order(prompt, ["Repair", "BUILDING", "then"]).alias("in_order"))


# -- embedding


@query()
def stub_embedding(spark, sf_dir):
    """Mersenne Twister vectors of the documents: no SQL has them; tested against the generator."""
    out = embedding.embed(views.chunks(spark, sf_dir), "stub", {}, model_id="stub")
    return out.select("chunk_id", "model_id", F.size("embedding").alias("dimension"), F.md5(F.array_join(F.transform("embedding", lambda x: x.cast("string")), " ")).alias("digest"))


# -- what goes through files


def _folder(spark, name: str) -> str:
    """A new folder that all executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(ORACLE_SQL["upsert_latest"])
def bucketed_upsert(spark, sf_dir):
    """The same upsert on a keyed table, of which it rewrites the parts that it touches."""
    events = sf_table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    keys = ["user_id", "event_type"]
    first = store.upsert_latest(events.limit(0), events.filter("event_id < 100"), keys, "event_id")
    stored = buckets.create(first, f"latest_{uuid.uuid4().hex}", _folder(spark, "latest"), keys, parts=16)
    stored.upsert(events.filter("event_id >= 100"), "event_id")
    return stored.rows().select("user_id", "event_type", "event_id", "value")


@query("""WITH gone AS (SELECT c_custkey FROM customer WHERE c_nationkey % 5 = 1) SELECT 'customer' AS name, c_custkey AS id FROM customer WHERE c_nationkey % 5 <> 1
 UNION ALL SELECT 'orders', o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM gone)""")
def bucketed_cascade(spark, sf_dir):
    """Customers of some nations go from a keyed table, and their orders from another."""
    t = lambda n: sf_table(spark, sf_dir, n)
    customers = buckets.create(t("customer").select("c_custkey", "c_nationkey"), f"customer_{uuid.uuid4().hex}", _folder(spark, "customer"), ["c_custkey"], parts=16)
    orders = buckets.create(t("orders").select("o_orderkey", "o_custkey"), f"orders_{uuid.uuid4().hex}", _folder(spark, "orders"), ["o_orderkey"], parts=16)
    gone = t("customer").filter("c_nationkey % 5 = 1").select("c_custkey")
    orders.remove(orders.rows().join(gone, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey"))
    customers.remove(gone)
    return customers.rows().select(F.lit("customer").alias("name"), F.col("c_custkey").alias("id")).union(orders.rows().select(F.lit("orders"), "o_orderkey"))


@query(f"""WITH r AS (SELECT s_suppkey AS i, s_nationkey AS u, abs(floor(s_acctbal))::bigint % 100 AS p FROM supplier),
 t AS (SELECT i, printf('%04d', i) || '.csv' AS file, 'iteration,unsafe_blocks,unsafe_line_pct,raw_ptr_count,test_pass_rate,timestamp_utc,commit,config_hash' || {NL} || i || ',' || u || ',' || p || '.00,1,100.00,t,c,h' || {NL} AS body FROM r
  UNION ALL SELECT i, printf('%04d', i) || '.json', '{{' || {NL} || '  "meta": {{' || {NL} || '    "timestamp_utc": "t",' || {NL} || '    "commit": "c",' || {NL} || '    "config_hash": "h"' || {NL} || '  }},' || {NL} || '  "iteration": ' || i || ',' || {NL} || '  "metrics": {{' || {NL} || '    "unsafe_blocks": ' || u || ',' || {NL} || '    "unsafe_line_pct": ' || p || '.0,' || {NL} || '    "raw_ptr_count": 1,' || {NL} || '    "test_pass_rate": 100.0' || {NL} || '  }}' || {NL} || '}}' || {NL} FROM r)
 SELECT file, strlen(body)::bigint AS size, sha256(body) AS told, true AS ok FROM t""")
def digested_iterations(spark, sf_dir):
    """Suppliers as iterations, written by executors with their digests and read again."""
    own = sf_table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("int").alias("iteration"), F.col("s_nationkey").alias("unsafe_blocks"), (F.abs(F.floor("s_acctbal")) % 100).cast("double").alias("unsafe_line_pct"),
        F.lit(1).alias("raw_ptr_count"), F.lit(100.0).alias("test_pass_rate"), F.lit("t").alias("timestamp_utc"), F.lit("c").alias("commit"), F.lit("h").alias("config_hash"),
    )
    folder = _folder(spark, "iterations")
    writers.iteration_files(own, folder)
    return digested.read(spark, folder).select("file", F.octet_length("content").cast("long").alias("size"), "told", "ok")


@query("SELECT 'v' || s_nationkey AS snapshot_version, '' AS c2rust_version, s_name AS c_project_path FROM supplier")
def tool_manifests(spark, sf_dir):
    """Suppliers as runs of a tool: gzip logs with manifests that name them, written by executors; each manifest with its log."""
    payload = F.to_json(F.struct(F.col("s_name").alias("cwd"), F.concat(F.lit("v"), F.col("s_nationkey").cast("string")).alias("snapshot_version")))
    runs = sf_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("run_id"), F.lit("2024-02-03 04:05:06").cast("timestamp").alias("at"), payload.alias("payload"))
    folder = _folder(spark, "tools")
    writers.tool_logs(runs, folder)
    told = spark.read.schema("snapshot_version string, c2rust_version string, c_project_path string, c2rust_log_path string").json(f"{folder}/*.manifest.json", multiLine=True)
    logs = spark.read.schema("cwd string").json(f"{folder}/*.json.gz").select(F.col("cwd").alias("c_project_path"))
    return told.join(logs, "c_project_path", "left_semi").select("snapshot_version", "c2rust_version", "c_project_path")


@query(ORACLE_SQL["diagnose_parse"].replace("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN regexp_extract", "SELECT CASE WHEN event_id % 3 = 0 THEN regexp_extract"))
def log_files(spark, sf_dir):
    """The log lines as gzip files, read and parsed."""
    folder = _folder(spark, "logs")
    views.logs(spark, sf_dir).select("line").write.option("compression", "gzip").text(folder)
    return logs(spark, folder).select("error_code", "file", "line", "summary")


@query(f"""WITH {ITER_SQL}, s AS (SELECT run_id, iter, l_linestatus AS key, {SCORE_SQL} FROM it), o AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY a, b, c, d, iter) AS place, lag(key) OVER w IS NOT DISTINCT FROM key AND lag(iter) OVER w IS NOT NULL AS same FROM s WINDOW w AS (PARTITION BY run_id ORDER BY iter)),
 m AS (SELECT *, min(place) OVER (PARTITION BY run_id ORDER BY iter ROWS UNBOUNDED PRECEDING) AS best, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY run_id ORDER BY iter ROWS UNBOUNDED PRECEDING) AS island FROM o)
 SELECT m.run_id, m.iter::bigint AS iter, row_number() OVER (PARTITION BY m.run_id, m.island ORDER BY m.iter) - 1 AS streak, b.iter::bigint AS best_iter, (m.iter - b.iter)::bigint AS stale FROM m JOIN o b ON b.run_id = m.run_id AND b.place = m.best""")
def streamed_counters(spark, sf_dir):
    """The streak and the running best of all iterations by a stream that stops and goes on."""
    folder = _folder(spark, "counters")
    rows = _scored(spark, sf_dir).select("run_id", "iter", F.col("l_linestatus").alias("key"), "score")
    for early in (True, False):
        own = rows.filter(F.col("iter") <= 3 if early else F.col("iter") > 3)
        own.write.mode("append").parquet(f"{folder}/in")
        stream = counters.counted(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
        started = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        started.awaitTermination()
    return spark.read.schema(counters.OUT).parquet(f"{folder}/out")


@query("""SELECT name, max(project_id) > 4 AS new, count(*) AS n FROM (SELECT r_name AS name, r_regionkey AS project_id FROM region UNION ALL SELECT DISTINCT n_name, 100 FROM nation WHERE n_name NOT IN (SELECT r_name FROM region)) GROUP BY name""")
def created_projects(spark, sf_dir):
    """Regions as stored projects, to which nations come; names that exist are refused."""
    stored = sf_table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("project_id"), F.col("r_name").alias("name"))
    new, _ = store.insert_projects(stored, sf_table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")).unionByName(stored.select("name")))
    return new.groupBy("name").agg((F.max("project_id") > 4).alias("new"), F.count("*").alias("n"))


@query("""WITH c AS (SELECT c_nationkey + 5 AS project_id, CASE WHEN c_custkey % 10 = 0 THEN 'mock' ELSE c_mktsegment END AS commit_sha FROM customer), p AS (SELECT n_nationkey AS project_id FROM nation)
 SELECT project_id::bigint AS project_id, commit_sha, NULL AS reason, count(DISTINCT commit_sha) AS n FROM c WHERE project_id IN (SELECT project_id FROM p) GROUP BY 1, 2
 UNION ALL SELECT project_id::bigint, commit_sha, 'fk', count(*) FROM c WHERE project_id NOT IN (SELECT project_id FROM p) GROUP BY 1, 2""")
def created_snapshots(spark, sf_dir):
    """Customers as new snapshots: an empty commit is mock, equal ones are stored once, those without a project are refused."""
    projects = sf_table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("project_id"))
    sha = F.when(F.col("c_custkey") % 10 == 0, " ").otherwise(F.col("c_mktsegment"))
    rows = sf_table(spark, sf_dir, "customer").select((F.col("c_nationkey") + 5).cast("long").alias("project_id"), sha.alias("commit_sha"))
    new, bad = store.insert_snapshots(spark.createDataFrame([], "snapshot_id long, project_id long, commit_sha string"), projects, rows)
    both = new.select("project_id", "commit_sha", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("project_id", "commit_sha", "reason"))
    return both.groupBy("project_id", "commit_sha", "reason").agg(F.count("*").alias("n"))


@query("SELECT event_id, strftime(ts, '%Y%m%dT%H%M%SZ') AS stamp, greatest(floor(value)::bigint, 0) AS ms FROM events")
def log_times(spark, sf_dir):
    """Events' times as log files' names show them, and the milliseconds to their ends."""
    ms = F.floor("value").cast("long")
    end = F.col("ts").cast("timestamp") + F.make_dt_interval(secs=(ms / 1000).cast("decimal(18,6)"))
    return sf_table(spark, sf_dir, "events").select("event_id", writers.stamp(F.col("ts").cast("timestamp")).alias("stamp"), writers.elapsed_ms(F.col("ts"), end).alias("ms"))


# -- extensions


@query("SELECT n_regionkey::bigint AS region, c_mktsegment AS segment, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ROLLUP (n_regionkey, c_mktsegment)")
def ext_rollup(spark, sf_dir):
    joined = sf_table(spark, sf_dir, "customer").join(sf_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.rollup(F.col("n_regionkey").cast("long").alias("region"), F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))


@query("SELECT c_nationkey::bigint AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def ext_intersect(spark, sf_dir):
    k = lambda t, c: sf_table(spark, sf_dir, t).select(F.col(c).cast("long").alias("k"))
    return k("customer", "c_nationkey").intersect(k("supplier", "s_nationkey"))

"""Lexical, vector and hybrid retrieval over chunks (chunk_id, snapshot_id, kind, lang, content, meta)."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelight.functions.features import risk_score
from sievelight.functions.text import excerpt, tokens
from sievelight.operators import text_index

#: Digits kept of a score before it orders rows, so that equal scores stay equal on every engine.
DIGITS = 9


@dataclass(frozen=True)
class Fusion:
    k: int = 60
    lexical_weight: float = 0.5
    vector_weight: float = 0.5


def query_tokens(query: str) -> list[str]:
    """Distinct tokens of a query, in order; the same rule as for texts."""
    return list(dict.fromkeys(re.findall(r"[^\W_]+", query.lower())))


def kind_filter(chunks: DataFrame, kinds: list[str] | None) -> DataFrame:
    """Chunks of any of the kinds, whose elements are taken as text; no kinds are no limit, one string isn't a list."""
    if isinstance(kinds, str):
        raise TypeError("kinds is a list")
    kinds = [str(k) for k in kinds or []]
    return chunks.filter(F.col("kind").isin(*kinds)) if kinds else chunks


def postings(chunks: DataFrame) -> DataFrame:
    """chunk_id, tok, pos (from 1) of every token."""
    return chunks.select("chunk_id", F.posexplode(tokens(F.col("content"))).alias("pos", "tok")).select("chunk_id", "tok", (F.col("pos") + 1).alias("pos"))


_HITS = "array<struct<pos:int,tok:string>>"


def text_hits(chunks: DataFrame, wanted: list[str], words: Callable[[Column], Column] = tokens) -> DataFrame:
    """chunk_id, hits of the chunks that hold all wanted tokens, from their texts: only wanted tokens leave a chunk's list of tokens.

    The tokens are looked for as plain substrings first, so that only chunks that may match are split.
    """
    if not wanted:
        return chunks.select("chunk_id", F.array().cast(_HITS).alias("hits")).limit(0)
    low = F.lower("content")
    may = chunks.filter(reduce(lambda a, b: a & b, [low.contains(t) for t in wanted]))
    placed = F.transform(words(F.col("content")), lambda t, i: F.when(t.isin(*wanted), F.struct((i + 1).alias("pos"), t.alias("tok"))))
    return may.select("chunk_id", F.array_compact(placed).alias("hits"))


def cover_rank(hits: Column, wanted: list[str]) -> Column:
    """The rank of a chunk by its hits (pos, tok) in order; null unless it holds all wanted tokens.

    rank sums 0.1 / (1 + words in between) over the minimal covers. A cover ends where the earliest of the last
    places of all tokens moves on; its entries are counted by the same running minimum. One fold inside the row.
    """
    none = F.lit(None).cast("int")
    begin = F.struct(*(none.alias(f"{x}{i}") for i in range(len(wanted)) for x in "pj"), F.lit(0).alias("entry"), none.alias("start"), F.lit(0.0).alias("rank"))

    def step(s: Column, x: Column) -> Column:
        entry = s["entry"] + 1
        p = [F.when(x["tok"] == t, x["pos"]).otherwise(s[f"p{i}"]) for i, t in enumerate(wanted)]
        j = [F.when(x["tok"] == t, entry).otherwise(s[f"j{i}"]) for i, t in enumerate(wanted)]
        whole = reduce(lambda a, b: a & b, [v.isNotNull() for v in p])
        start, first = (F.least(*v) if len(v) > 1 else v[0] for v in (p, j))
        moved = whole & (s["start"].isNull() | (s["start"] != start))
        noise = (x["pos"] - start) - (entry - first)
        return F.struct(
            *(v.alias(f"{n}{i}") for i in range(len(wanted)) for n, v in (("p", p[i]), ("j", j[i]))), entry.alias("entry"),
            F.when(whole, start).otherwise(s["start"]).alias("start"), (s["rank"] + F.when(moved, F.lit(0.1) / (1 + noise)).otherwise(0.0)).alias("rank"),
        )

    return F.aggregate(hits, begin, step, lambda s: F.when(s["start"].isNotNull(), F.round(s["rank"], DIGITS)))


def lexical_search(chunks: DataFrame, query: str, *, snapshot_id: int | None = None, kinds: list[str] | None = None, limit: int = 50, posts: DataFrame | None = None, index: str | None = None, words: Callable[[Column], Column] = tokens) -> DataFrame:
    """chunk_id, rank of the best chunks that hold every token; ties go to the lower id. An empty query finds nothing.

    posts: the chunks' postings, or index: the path of a stored text_index, read in place of their texts. What it has of
    chunks that aren't among these is passed over; changed content is found once the index has been told. words: the
    rule by which a text has tokens, such as functions.classes.plain; postings and indexes have their own.
    """
    own = kind_filter(chunks if snapshot_id is None else chunks.filter(F.col("snapshot_id") == snapshot_id), kinds)
    wanted = query_tokens(query) if words is tokens else list(dict.fromkeys(chunks.sparkSession.range(1).select(words(F.lit(query))).first()[0]))
    if not wanted:
        return own.select("chunk_id", F.lit(0.0).alias("rank")).limit(0)
    if index is not None:
        return text_index.search(chunks.sparkSession, index, query, snapshot_id=snapshot_id, among=own, limit=limit).rows
    elif posts is not None:
        found = posts.filter(F.col("tok").isin(*wanted)).join(own.select("chunk_id"), "chunk_id", "left_semi")
        hits = found.groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("pos", "tok"))).alias("hits"))
    else:
        hits = text_hits(own, wanted, words)
    # chunks without a rank are last, and go after the cut: a filter before it would work the rank out twice
    return hits.select("chunk_id", cover_rank(F.col("hits"), wanted).alias("rank")).orderBy(F.desc_nulls_last("rank"), "chunk_id").limit(limit).filter("rank is not null")


def cosine_distance(vector: Column, query: list[float]) -> Column:
    """1 - cosine in double precision; NaN where a vector is zero."""
    other = F.array(*(F.lit(float(x)) for x in query))
    mine = F.transform(vector, lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(mine, other, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(mine, F.lit(0.0), lambda s, x: s + x * x)) * F.lit(sum(float(x) ** 2 for x in query) ** 0.5)
    return F.when(F.size(vector) != len(query), F.lit(None)).when(norm == 0, F.lit(float("nan"))).otherwise(F.round(1 - dot / norm, DIGITS))


def vector_search(vectors: DataFrame, query: list[float], *, snapshot_id: int | None = None, model_id: str | None = None, limit: int = 50, max_dist: float | None = None) -> DataFrame:
    """chunk_id, dist of the nearest vectors (chunk_id, snapshot_id, model_id, embedding); ties go to the lower id.

    Exact: every vector of the snapshot is compared. model_id=None compares those of all models.
    """
    own = vectors if snapshot_id is None else vectors.filter(F.col("snapshot_id") == snapshot_id)
    own = own if model_id is None else own.filter(F.col("model_id") == model_id)
    found = own.select("chunk_id", cosine_distance(F.col("embedding"), query).alias("dist")).filter("dist is not null")
    found = found if max_dist is None else found.filter(F.col("dist") <= max_dist)
    return found.orderBy("dist", "chunk_id").limit(limit)


def ranked(found: DataFrame, *order: Column | str) -> DataFrame:
    """Numbers a bounded list from 1 in its order."""
    return found.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def rrf(lexical: DataFrame, vector: DataFrame, fusion: Fusion = Fusion()) -> DataFrame:  # noqa: B008
    """Weighted reciprocal rank fusion of two lists (chunk_id, rank): chunk_id, lexical_rank, vector_rank, rrf.

    An id that stands twice in a list keeps its best rank; one that is missing has a null rank there. A dist
    in the vector list comes along, of several the largest.
    """
    dist = [F.max("dist").alias("dist")] if "dist" in vector.columns else []
    a = lexical.groupBy("chunk_id").agg(F.min("rank").alias("lexical_rank"))
    b = vector.groupBy("chunk_id").agg(F.min("rank").alias("vector_rank"), *dist)
    part = lambda w, r: F.coalesce(F.lit(w) / (F.lit(fusion.k) + F.col(r)), F.lit(0.0))
    return a.join(b, "chunk_id", "full_outer").withColumn("rrf", part(fusion.lexical_weight, "lexical_rank") + part(fusion.vector_weight, "vector_rank"))


def hybrid_retrieve(
    chunks: DataFrame,
    vectors: DataFrame,
    query: str,
    query_vector: list[float],
    *,
    snapshot_id: int | None = None,
    model_id: str | None = None,
    kinds: list[str] | None = None,
    max_dist: float | None = None,
    top_k: int = 50,
    fusion: Fusion = Fusion(),  # noqa: B008
    index: str | None = None,
) -> DataFrame:
    """Evidence items: chunk_id, excerpt, kind, lang, meta, dist, lexical_rank, vector_rank, rrf, risk_score.

    Both lists are bounded by top_k; the fused one, top_k rows, comes to the driver, and the chunks are fetched
    by their ids, which the scan skips other pages by. index: as in lexical_search(). Kinds limit the vector list after
    its cut, the lexical one before. Risk orders equal scores within the cut and never decides it. Where a
    chunk has several vectors, its distance is that of the furthest in the list.
    """
    own = chunks if snapshot_id is None else chunks.filter(F.col("snapshot_id") == snapshot_id)
    lexical = ranked(lexical_search(chunks, query, snapshot_id=snapshot_id, kinds=kinds, limit=max(top_k, 50), index=index), F.desc("rank"), F.col("chunk_id")).select("chunk_id", "rank")
    near = vector_search(vectors, query_vector, snapshot_id=snapshot_id, model_id=model_id, limit=max(3 * top_k, 50), max_dist=max_dist)
    if kinds:
        near = near.join(kind_filter(own, kinds).select("chunk_id"), "chunk_id", "left_semi")
    near = ranked(near, "dist", "chunk_id")
    fused = rrf(lexical, near.select("chunk_id", "rank", "dist"), fusion).orderBy(F.desc(F.round("rrf", 12)), "chunk_id").limit(top_k)
    rows = fused.collect()
    fused = chunks.sparkSession.createDataFrame(rows, fused.schema)
    own = own.filter(F.col("chunk_id").isin(*(r["chunk_id"] for r in rows))) if rows else own.limit(0)
    tags = F.from_json(F.get_json_object("meta", "$.risk_tags"), "array<string>")
    items = own.join(F.broadcast(fused), "chunk_id").select(
        "chunk_id", excerpt(F.col("content")).alias("excerpt"), "kind", "lang", "meta", "dist", "lexical_rank", "vector_rank", F.round("rrf", 12).alias("rrf"), F.coalesce(risk_score(tags), F.lit(0)).alias("risk_score")
    )
    return items.orderBy(F.desc("rrf"), F.desc("risk_score"), "chunk_id")


def prioritize(items: DataFrame) -> DataFrame:
    """Code before other evidence, then by risk; equals in reverse of their order `idx`."""
    code = F.coalesce(F.col("evidence_type").startswith("code"), F.lit(False))
    return items.orderBy(F.desc(code), F.desc("risk_score"), F.desc("idx"))

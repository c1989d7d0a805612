"""Operator 13, benchmark decontamination: a positional inverted index of the documents, DataFrame functions only.

The index is a stored table of postings (term, row, pos) of the terms that the test items hold, sorted by term
inside each file, so that a lookup skips all but the pages of its terms. An item's phrases are its windows of
words. Of each window the places of its rarest term, less the term's offset, are intersected with those of the
next rarest terms; what is left is held against the documents' own words: an exact match, or with a slack a
proximity match, whose words lie each within so many words of their place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievelight.llm.scratch import Scratch

WINDOW = 10
#: Terms of a window whose lists are intersected, rarest first; the rest of its words are compared in the text.
LISTS = 3
#: Rows (terms, places, ids) up to which one side of a join is broadcast: counted before, some ten megabytes.
BROADCAST_ROWS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Letters that lower() may change besides A-Z.
_OTHER_UPPER = r"[\P{ASCII}&&[\p{IsUppercase}\p{Lt}]]"


def words_of(text: Column) -> Column:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text whose A-Z are lower-cased; a null text has none."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    low = F.when(F.regexp_like(text, F.lit(_OTHER_UPPER)), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.array_remove(F.split(low, _BETWEEN), "")


def _small(df: DataFrame) -> DataFrame:
    """df, broadcast if it is counted to be small enough, and as Spark sees fit otherwise."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


@dataclass
class Index:
    """documents: row, id, n_words, words; postings: term, row, pos."""

    documents: DataFrame
    postings: DataFrame
    scratch: Scratch


def build_index(df: DataFrame, terms: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index of df's texts; terms (term) are those whose postings are stored, None all of them.

    Every row is a document, also repeated ones and those without an id. Nothing is shuffled: a file of postings
    has those of the documents that one task read.
    """
    scratch = Scratch(df.sparkSession, "index")
    words = df.select(F.monotonically_increasing_id().alias("row"), df[id_col].alias("id"), words_of(df[text_col]).alias("words"))
    documents = scratch.table(words.select("row", "id", F.size("words").cast("long").alias("n_words"), "words"), "documents")
    placed = documents.select("row", F.posexplode("words").alias("pos", "term"))
    if terms is not None:
        placed = placed.join(_small(terms.select("term").distinct()), "term", "left_semi")
    postings = scratch.table(placed.select("term", "row", "pos").sortWithinPartitions("term", "row", "pos"), "postings")
    return Index(documents, postings, scratch)


def windows_of(items: DataFrame, *, id_col: str = "item_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """item, words of each window: width words after another, or all of an item that has fewer, but not none."""
    own = items.select(items[id_col].alias("item"), words_of(items[text_col]).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (width - 1), F.lit(1)))
    return own.select("item", "w", F.explode(starts).alias("at")).select("item", F.slice("w", F.col("at"), F.lit(width)).alias("words"))


def phrase_matches(index: Index, phrases: DataFrame, *, slack: int = 0, lists: int = LISTS) -> DataFrame:
    """row, phrase, start, n of every match of phrases (phrase, words); phrases are distinct.

    slack 0: the words stand one after another from start on. Otherwise start is the rarest word's place less its
    offset (ties: the first), and each word stands somewhere within slack words of its place; start may then be
    before the text's first word. Null and empty phrases match nothing.
    """
    scratch, postings = index.scratch, index.postings
    counts = postings.groupBy("term").agg(F.count("*").alias("n_places"))
    placed = phrases.select("phrase", F.size("words").alias("n"), F.posexplode("words").alias("offset", "term"))
    known = placed.join(counts, "term")  # a phrase with a word that no document has is short of a row, and can't match
    of = Window.partitionBy("phrase")
    rank = F.row_number().over(of.orderBy("n_places", "offset"))
    terms = known.select("*", rank.alias("rank"), F.count("*").over(of).alias("found")).filter("found = n and rank <= " + str(lists))
    terms = scratch.table(terms.select("phrase", "n", "offset", "term", "rank"), "terms")
    # places of the terms that are looked up at all: sorted files give their pages only
    looked_up = scratch.table(postings.join(_small(terms.select("term").distinct()), "term", "left_semi"), "looked-up")

    rarest = _small(terms.filter("rank = 1").select("phrase", "n", "offset", "term"))
    found = looked_up.join(rarest, "term").select("row", "phrase", "n", (F.col("pos") - F.col("offset")).alias("start"))
    found = found if slack else found.filter("start >= 0")
    near = slack + 1
    for k in range(2, lists + 1):
        more = _small(terms.filter(f"rank = {k}").select(F.col("phrase").alias("of"), "offset", "term"))
        wanted = found.join(more, F.col("phrase") == F.col("of"), "left").drop("of")  # phrases of fewer words pass
        short = wanted.filter("term is null").select("row", "phrase", "n", "start")
        wanted = wanted.filter("term is not null").withColumn("pos", F.col("start") + F.col("offset"))
        if slack:  # cells of slack + 1 places: a place within slack is in the same cell or one beside it
            cell = F.floor(F.col("pos") / near)
            wanted = wanted.withColumn("cell", F.explode(F.array(cell - 1, cell, cell + 1)))
            there = looked_up.select("term", "row", F.floor(F.col("pos") / near).alias("cell"), F.col("pos").alias("place"))
            met = wanted.join(there, ["term", "row", "cell"]).filter(F.abs(F.col("place") - F.col("pos")) <= slack)
            met = met.select("row", "phrase", "n", "start").distinct()
        else:
            met = wanted.join(looked_up, ["term", "row", "pos"], "left_semi").select("row", "phrase", "n", "start")
        found = scratch.table(met.unionByName(short), f"found-{k}-{slack}")

    # what is left is held against the words of its documents
    rows = _small(found.select("row").distinct())
    texts = index.documents.select("row", "words").join(rows, "row", "left_semi")
    whole = _small(phrases.select("phrase", F.col("words").alias("wanted")))
    held = found.join(texts, "row").join(whole, "phrase")
    if slack:
        near_words = lambda i: F.slice("words", F.greatest(F.col("start") + i + 1 - slack, F.lit(1)), F.greatest(F.least(F.lit(2 * slack + 1), F.col("start") + i + 1 + slack), F.lit(0)))
        same = F.aggregate(F.transform("wanted", lambda w, i: F.array_contains(near_words(i), w)), F.lit(True), lambda a, b: a & b)
    else:
        same = F.slice("words", F.col("start") + 1, F.greatest(F.col("n"), F.lit(0))) == F.col("wanted")
    return held.filter(same).select("row", "phrase", "start", "n")


def decontaminate(df: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WINDOW, slack: int = 0) -> DataFrame:
    """One row per row of df: id, n_words, n_hit (words inside a match), items (ids of items with a match, as sorted strings).

    A null text has no words and no hits; so has an empty one. An item without words has no windows, and one without an
    id marks words but isn't named; items that share an id are one. Repeated documents are hit alike; an empty
    table of documents gives no rows, one of items no hits; other columns aren't read. With a slack, proximity
    matches count, and the words from their start on, n of them and inside the text, are hit.
    """
    scratch = Scratch(df.sparkSession, "windows")
    windows = scratch.table(windows_of(items, id_col=item_col, text_col=item_text, width=width), "windows")
    phrases = scratch.table(windows.select("words").distinct().select(F.monotonically_increasing_id().alias("phrase"), "words"), "phrases")
    naming = windows.join(phrases, "words").filter("item is not null").select("phrase", F.col("item").cast("string").alias("item")).distinct()
    index = build_index(df, phrases.select(F.explode("words").alias("term")), id_col=id_col, text_col=text_col)
    matches = index.scratch.table(phrase_matches(index, phrases, slack=slack), "matches")

    # words inside any match, each counted once: in order of their starts, what goes beyond the furthest end so far
    spans = matches.groupBy("row", F.greatest("start", F.lit(0)).alias("start")).agg(F.max(F.col("start") + F.col("n")).alias("end"))
    spans = spans.join(index.documents.select("row", "n_words"), "row").withColumn("end", F.least("end", "n_words")) if slack else spans
    before = F.coalesce(F.max("end").over(Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hit = spans.select("row", F.greatest(F.col("end") - F.greatest("start", before), F.lit(0)).alias("more")).groupBy("row").agg(F.sum("more").cast("long").alias("n_hit"))
    named = matches.select("row", "phrase").distinct().join(_small(naming), "phrase").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = index.documents.select("row", "id", "n_words").join(hit, "row", "left").join(named, "row", "left")
    return out.select(F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def op13_benchmark_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items, by windows of ten words."""
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))

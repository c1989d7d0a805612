"""Operator 3, quality rules: distribution divergence from language references, DataFrame functions only.

Each document's histograms of character classes and of its language's common words are compared with
what is typical of that language's documents by Jensen-Shannon distance (base 2, 0 to 1). Short
documents have noisy histograms, so the limits widen with the inverse square root of the length, and
below a minimum length a histogram has no say. Every language met has a character reference of its own; a
document without one is compared with the nearest reference over its ASCII characters, since other letters
say which language it is and not how good it is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelight.llm.scratch import Scratch

#: Common words of the four languages.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "on", "was"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "des", "ist", "für"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un"],
}
WHITE = " \t\n\x0b\x0c\r"
#: Character classes besides lower-case and other letters, which are the rest of the words' characters.
CLASSES = {"upper": "[A-Z]", "digit": "[0-9]", "stop": "[.,;:!?'\"()\\-]", "symbol": "[#*$%&|<>]", "wide": "[^\\x00-\\x7F]"}
#: Parts to which shares are rounded where their median is taken.
STEPS = 2000
#: Good documents from which a language's own reference decides alone.
REFERENCE_LEAST = 5
#: References that are compared as one array, and those beyond which they aren't broadcast.
BLOCK, BROADCAST_ROWS = 256, 10_000
#: Place of "wide" in char_share.
WIDE = list(CLASSES).index("wide")
#: Limits of the distances, what 1/sqrt(length) adds, and the least lengths (characters, words). Chance alone
#: puts a text of n words at about 1.5/sqrt(n) from its language, and one of n characters at 1/sqrt(n).
CHAR_LIMIT, CHAR_SLACK, CHAR_LEAST = 0.085, 3.0, 100
WORD_LIMIT, WORD_SLACK, WORD_LEAST = 0.15, 1.5, 50


def _share(counts: list[Column], total: Column) -> Column:
    """An array of counts over their total, with the rest of the total last."""
    rest = total - reduce(lambda a, b: a + b, counts)
    return F.transform(F.array(*counts, rest), lambda x: x / F.greatest(total, F.lit(1)).cast("double"))


def _is(value: int):
    return lambda x: x == value


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares: the root of the divergence in bits."""
    term = F.zip_with(
        p, q,
        lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0) + F.when(b > 0, b * F.log2(2 * b / (a + b))).otherwise(0.0),
    )
    return F.sqrt(F.greatest(F.aggregate(term, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def measures(df: DataFrame, *, id_col: str, text_col: str, lang_col: str, rows: bool = False) -> DataFrame:
    """Per row: lang, the base counts, char_share and word_share; the words themselves go no further."""
    text = F.coalesce(df[text_col].cast("string"), F.lit(""))
    lang = df[lang_col].cast("string")
    out = df.select(df[id_col].alias("id"), lang.alias("lang"), text.alias("text"), *([F.struct(*(df[c] for c in df.columns)).alias("row")] if rows else []))
    out = out.withColumn("trimmed", F.btrim("text", F.lit(WHITE)))
    out = out.withColumn("words", F.when(F.col("trimmed") != "", F.split("trimmed", r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))).drop("trimmed")
    out = out.withColumn("n_words", F.size("words").cast("long"))
    lines = F.split("text", "\n")
    out = out.withColumn("lines", F.when(F.instr("text", "\n") > 0, F.filter(lines, lambda x: F.btrim(x, F.lit(WHITE)) != "")).otherwise(F.array().cast("array<string>")))
    out = out.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
    out = out.withColumn("word_chars", F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")).cast("long"))
    for name, chars in CLASSES.items():
        out = out.withColumn(f"n_{name}", F.regexp_count("text", F.lit(chars)).cast("long"))
    out = out.drop("text")

    # words in windows found twice: sort (hash, position) where some hash repeats, take the positions that have an equal neighbour
    out = out.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    h = F.col("hashes")
    windows = F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - 3), lambda i: F.xxhash64(h[i], h[i + 1], h[i + 2]))
    out = out.withColumn("k", F.when(F.col("n_words") >= 3, windows).otherwise(F.array().cast("array<long>"))).drop("hashes")
    pairs = F.sort_array(F.transform("k", lambda x, i: F.struct(x.alias("k"), i.alias("i"))))
    out = out.withColumn("s", F.when(F.size("k") > F.size(F.array_distinct("k")), pairs).otherwise(F.array().cast("array<struct<k:long,i:int>>"))).drop("k")
    s = F.col("s")
    twin = lambda x, j: (F.when(j > 0, s[j - 1]["k"] == x["k"]).otherwise(False)) | F.coalesce(F.get(s, j + 1)["k"] == x["k"], F.lit(False))
    out = out.withColumn("at", F.sort_array(F.transform(F.filter("s", twin), lambda x: x["i"]))).drop("s")
    at = F.col("at")
    gaps = F.transform("at", lambda x, j: F.when(j == 0, 3).otherwise(F.least(F.lit(3), x - at[j - 1])))
    out = out.withColumn("n_repeat_words", F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)).drop("at")

    every = sorted({v for ws in COMMON.values() for w in ws for v in (w, w.capitalize())})
    out = out.withColumn("common", F.transform(F.filter("words", lambda w: w.isin(*every)), F.lower)).drop("words")
    own = reduce(lambda a, kv: a.when(F.col("lang") == kv[0], F.array(*map(F.lit, kv[1]))), COMMON.items(), F.when(F.lit(False), F.array().cast("array<string>")))
    out = out.withColumn("own", own)
    places = F.transform("common", lambda w: F.array_position("own", w))
    out = out.withColumn("places", places)
    by_slot = [F.size(F.filter("places", _is(i + 1))).cast("long") for i in range(12)]
    n_upper, n_digit, n_stop, n_symbol, n_wide = (F.col(f"n_{c}") for c in CLASSES)
    out = out.withColumn("char_share", _share([n_upper, n_digit, n_stop, n_symbol, F.least(n_wide, F.col("word_chars") - n_upper - n_digit - n_stop - n_symbol)], F.col("word_chars")))
    out = out.withColumn("word_share", F.when(F.col("lang").isin(*COMMON), _share(by_slot, F.col("n_words"))))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select("id", "lang", "n_words", "word_chars", F.col("n_symbol").alias("n_symbols"), "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "char_share", "word_share", *(["row"] if rows else []))


def references(measured: DataFrame) -> DataFrame:
    """Typical shares of each language's documents that pass the base rules: lang, n, ref_chars, ref_words (of the four languages).

    The median of each share, then over their sum: a minority of odd documents doesn't shift it. Shares are
    rounded to STEPS parts before, so that a median is exact, the same in any partitioning, and counts that
    many values at most. One row per language met.
    """
    good = measured.filter(~F.col("base_failed"))

    def typical(col: str, n: int) -> list[Column]:
        return [F.percentile(F.round(F.col(col)[i] * STEPS) / STEPS, 0.5).alias(f"{col}{i}") for i in range(n)]

    def whole(col: str, n: int) -> Column:
        parts = F.array(*(F.col(f"{col}{i}") for i in range(n)))
        total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
        return F.when(total > 0, F.transform(parts, lambda x: x / total))

    chars, words = ("char_share", len(CLASSES) + 1), ("word_share", 13)
    own = good.filter(F.col("lang").isNotNull()).groupBy("lang").agg(F.count("*").alias("n"), *typical(*chars), *typical(*words))
    return own.select("lang", "n", whole(*chars).alias("ref_chars"), whole(*words).alias("ref_words"))


def _ascii(share: Column) -> Column:
    """Character shares without the wide ones, over their sum."""
    return F.transform(F.filter(share, lambda _, i: i != WIDE), lambda x: x / F.greatest(1 - share[WIDE], F.lit(1e-9)))


def _nearest(out: DataFrame, refs: DataFrame) -> DataFrame:
    """Adds near_distance, from the nearest of refs, to the rows that are alone.

    One block of references is an array that stands beside every row. More blocks meet the distinct shares of the
    rows that are alone, which are a stated set, and the least distance comes back to them.
    """
    shares = refs.select("lang", _ascii(F.col("ref_chars")).alias("share"))
    blocks = -(-refs.count() // BLOCK)
    if blocks <= 1:
        every = F.broadcast(shares.agg(F.collect_list("share").alias("every")))  # one row
        near = F.array_min(F.transform("every", lambda r: js_distance(F.col("plain"), r)))
        return out.crossJoin(every).withColumn("near_distance", F.when(F.col("alone"), near))
    every = shares.groupBy(F.pmod(F.xxhash64("lang"), F.lit(blocks)).alias("block")).agg(F.collect_list("share").alias("every")).select("every")
    every = F.broadcast(every) if blocks * BLOCK <= BROADCAST_ROWS else every
    near = F.array_min(F.transform("every", lambda r: js_distance(F.col("asked"), r)))
    least = out.filter("alone").select(F.col("plain").alias("asked")).distinct().crossJoin(every).groupBy("asked").agg(F.min(near).alias("near_distance"))
    return out.join(least, F.col("alone") & (F.col("plain") == F.col("asked")), "left").drop("asked")


def quality_rules(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: bool = False) -> DataFrame:
    """One row per row of df: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance, word_distance, kept.

    A null text counts as empty (no words: base_failed). Any language of REFERENCE_LEAST good documents is
    compared with its own reference. A document of null or a rarer language is far only if its ASCII
    characters are far from those of the nearest reference, and its characters from its language's own, if
    there is one; mostly non-ASCII text is left to the base rules. char_distance is then the smaller of the
    two. Where there is no reference, distances are null and the base rules alone decide. Repeated rows get
    equal verdicts; an empty table gives an empty result; other columns aren't read. Each row is measured by
    itself, in one narrow pass; only sums per language are shuffled.
    rows: adds row, a struct of df's columns, which spares a join where the verdict is put to use.
    """
    scratch = Scratch(df.sparkSession, "quality")
    measured = scratch.table(measures(df, id_col=id_col, text_col=text_col, lang_col=lang_col, rows=rows), "measured")
    refs = scratch.table(references(measured), "references").filter("ref_chars is not null")
    own = refs.select(F.col("lang").alias("of"), "n", "ref_chars", "ref_words")
    if own.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        own = F.broadcast(own)
    out = measured.join(own, measured["lang"] == F.col("of"), "left")
    wide = F.col("char_share")[WIDE]
    settled = F.coalesce(F.col("n") >= REFERENCE_LEAST, F.lit(False))
    out = out.withColumn("settled", settled).withColumn("n_ascii", F.col("word_chars") * (1 - wide)).withColumn("plain", _ascii(F.col("char_share")))
    out = out.withColumn("own_distance", F.when(F.col("ref_chars").isNotNull() & (F.col("word_chars") >= CHAR_LEAST), js_distance(F.col("char_share"), F.col("ref_chars"))))
    out = _nearest(out.withColumn("alone", ~F.col("settled") & (wide <= 0.5) & (F.col("n_ascii") >= CHAR_LEAST)), refs.filter(F.col("n") >= REFERENCE_LEAST))
    out = out.withColumn("word_distance", F.when(F.col("ref_words")[0].isNotNull() & F.col("settled") & (F.col("n_words") >= WORD_LEAST), js_distance(F.col("word_share"), F.col("ref_words"))))

    def over(distance: str, length: str, limit: float, slack: float) -> Column:
        return F.col(distance) > limit + slack / F.sqrt(F.greatest(length, F.lit(1)))

    far_own = over("own_distance", "word_chars", CHAR_LIMIT, CHAR_SLACK)
    far_near = over("near_distance", "n_ascii", CHAR_LIMIT, CHAR_SLACK)
    far_chars = F.when(F.col("settled"), F.coalesce(far_own, F.lit(False))).otherwise(F.coalesce(far_near, F.lit(False)) & F.coalesce(far_own, F.lit(True)))
    far = far_chars | F.coalesce(over("word_distance", "n_words", WORD_LIMIT, WORD_SLACK), F.lit(False))
    out = out.withColumn("char_distance", F.least("own_distance", "near_distance"))
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", (~F.col("base_failed") & ~far).alias("kept"), *(["row"] if rows else []))


def op3_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))

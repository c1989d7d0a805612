"""Operator 9, token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from sievelight.llm import bpe
from sievelight.llm.packs import lean

TOKENIZER, LIMIT = "byte_bpe_50k.json", 1024


def token_counts(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Tokens of each whole text: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Rows keep their number: repeated rows and null ids are counted like any other; a null text counts as
    empty (0 bytes, 0 tokens); an empty table gives an empty result; other columns are not read, so their
    names cannot clash. Special strings in a text are handled as the library's default does. A narrow map:
    no shuffle, and a lost task is run again from its input split. Inside a task texts are handled in
    batches of equal bytes; one over a mebibyte is first cut at places no token can span.
    tokenizer: path of a tokenizers file (.json) or a sentencepiece one (.model).
    """
    path = tokenizer or bpe.tokenizer_path(TOKENIZER)
    kind = df.schema[id_col].dataType.simpleString()

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1)
            sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            n = np.zeros(b.num_rows, np.int64)
            if path.endswith(".model"):
                for lo, hi in bpe.byte_batches(sizes.to_numpy(zero_copy_only=False)):
                    n[lo:hi] = [len(x) for x in _pieces(path).encode([t or "" for t in texts.slice(lo, hi - lo).to_pylist()], num_threads=1)]
            else:
                for lo, hi, lengths in bpe.count_texts(path, texts):
                    n[lo:hi] = lengths
            yield pa.RecordBatch.from_arrays([b.column(0), sizes, pa.array(n), pa.array(n > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    out = df.select(df[id_col].alias("id"), df[text_col].cast("string").alias("text")).mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)


def _pieces(path: str, kept: dict = {}):  # noqa: B006  one for a worker
    if path not in kept:
        import sentencepiece

        kept[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return kept[path]


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))

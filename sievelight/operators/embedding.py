"""Embedding providers and the embedding of chunks."""

from __future__ import annotations

import hashlib
import json
import random
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.functions.text import content_hash
from sievelight.operators.store import upsert_latest

#: A provider embeds a list of texts.
Provider = Callable[[list[str]], list[list[float]]]
BATCH = 128
#: Fixed value: the seed of the stub where its configuration has none.
SEED = 1337


def stub_vector(text: str, dim: int, seed: int = SEED) -> list[float]:
    """A vector that depends on nothing but the text: a Mersenne Twister seeded by its digest, seven significant digits."""
    r = random.Random(seed ^ int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "little"))
    return [float(f"{r.uniform(-1.0, 1.0):.7g}") for _ in range(dim)]


def stub(config: dict) -> Provider:
    dim, seed = int(config.get("dimension", 1536)), int(config.get("seed", SEED))
    return lambda texts: [stub_vector(t, dim, seed) for t in texts]


#: A transport posts a body as JSON to an address with headers and a time limit: (status, body of the answer).
Transport = Callable[[str, dict, dict, float], tuple[int, bytes]]
#: Texts of a request, tries after the first, the longest wait between tries, requests at a time, and seconds for an answer.
REMOTE_BATCH, RETRIES, LONGEST_WAIT, AT_ONCE, ANSWER_S = 128, 5, 10.0, 8, 60.0


def http_post(url: str, body: dict, headers: dict, limit: float) -> tuple[int, bytes]:
    """The transport of the standard library; an answer that isn't a success has its status, and no connection is status 0."""
    import urllib.error
    import urllib.request

    asked = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(asked, timeout=limit) as got:
            return got.status, got.read()
    except urllib.error.HTTPError as e:
        return e.code, e.read()
    except OSError as e:
        return 0, str(e).encode()


def remote(config: dict) -> Provider:
    """A provider behind an address: {"model", "input": texts} is asked, {"data": [{"index", "embedding"}]} is told.

    config: url, model, and if need be headers, batch, retries, at_once, answer_s, and for tests transport and sleep.
    Requests of a batch of texts each run a bounded number at a time. A busy or failing server (429, 5xx, no
    connection) is asked again after 1, 2, 4, … seconds, 10 at most; any other answer, a count that isn't that of the texts
    and an index that is missing are errors, which fail the task.
    """
    send: Transport = config.get("transport", http_post)
    sleep = config.get("sleep", time.sleep)
    size, retries = int(config.get("batch", REMOTE_BATCH)), int(config.get("retries", RETRIES))

    def ask(texts: list[str]) -> list[list[float]]:
        for n in range(retries + 1):
            status, body = send(config["url"], {"model": config["model"], "input": texts}, dict(config.get("headers", {})), float(config.get("answer_s", ANSWER_S)))
            if 200 <= status < 300:
                break
            if not (status == 0 or status == 429 or status >= 500) or n == retries:
                raise ValueError(f"provider_failed:{status}")
            sleep(min(LONGEST_WAIT, 2.0**n))
        data = json.loads(body).get("data", [])
        if len(data) != len(texts) or {d.get("index") for d in data} != set(range(len(texts))):
            raise ValueError("count_mismatch")
        return [[float(x) for x in d["embedding"]] for d in sorted(data, key=lambda d: d["index"])]

    def embed_all(texts: list[str]) -> list[list[float]]:
        parts = [texts[i : i + size] for i in range(0, len(texts), size)]
        with ThreadPoolExecutor(max_workers=int(config.get("at_once", AT_ONCE))) as pool:
            return [v for got in pool.map(ask, parts) for v in got]

    return embed_all


PROVIDERS: dict[str, Callable[[dict], Provider]] = {"stub": stub, "remote": remote}


def provider(kind: str, config: dict) -> Provider:
    """The provider of a registered kind; others can be added to PROVIDERS."""
    if kind not in PROVIDERS:
        raise ValueError(f"unknown_provider_type:{kind}")
    return PROVIDERS[kind](config)


def embed(chunks: DataFrame, kind: str, config: dict, *, model_id: str) -> DataFrame:
    """(chunk_id, snapshot_id, content) to chunk_id, model_id, snapshot_id, embedding; a wrong count or dimension is an error."""
    dim = int(config.get("dimension", 1536))
    step = BATCH * int(config.get("at_once", AT_ONCE)) if kind == "remote" else BATCH  # as many as are asked for at a time

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = provider(kind, config)
        for b in batches:
            for at in range(0, len(b), step):
                part = b.iloc[at : at + step]
                vectors = make([t or "" for t in part["content"]])
                if len(vectors) != len(part):
                    raise ValueError("count_mismatch")
                if any(len(v) != dim for v in vectors):
                    raise ValueError("dimension_mismatch")
                yield pd.DataFrame({"chunk_id": part["chunk_id"], "snapshot_id": part["snapshot_id"], "embedding": vectors})

    found = chunks.select("chunk_id", "snapshot_id", "content").mapInPandas(run, "chunk_id long, snapshot_id long, embedding array<float>")
    return found.select("chunk_id", F.lit(model_id).alias("model_id"), "snapshot_id", "embedding")


def embed_missing(stored: DataFrame, chunks: DataFrame, kind: str, config: dict, *, model_id: str) -> DataFrame:
    """Vectors of those chunks whose content the stored ones (chunk_id, model_id, content_hash, embedding) don't have.

    Each content is embedded once, and its vector goes to all chunks that have it: from stored if any chunk has it there
    under this model. So a load that broke off, or came again, goes on where it was. Columns: chunk_id, model_id,
    snapshot_id, content_hash, embedding.
    """
    own = chunks.select("chunk_id", "snapshot_id", "content", content_hash(F.col("content")).alias("content_hash"))
    of = stored.filter(F.col("model_id") == model_id)
    new = own.join(of.select("chunk_id", "content_hash"), ["chunk_id", "content_hash"], "left_anti")
    known = of.groupBy("content_hash").agg(F.any_value("embedding").alias("embedding"))
    asked = new.join(known.select("content_hash"), "content_hash", "left_anti").groupBy("content_hash").agg(F.min(F.struct("chunk_id", "snapshot_id", "content")).alias("c"))
    told = embed(asked.select("c.*"), kind, config, model_id=model_id).select("chunk_id", "embedding")
    told = asked.select("content_hash", F.col("c.chunk_id").alias("chunk_id")).join(told, "chunk_id").select("content_hash", "embedding")
    return new.drop("content").join(known.unionByName(told), "content_hash").select("chunk_id", F.lit(model_id).alias("model_id"), "snapshot_id", "content_hash", "embedding")


def embed_registered(chunks: DataFrame, models: DataFrame, model_id: str) -> DataFrame:
    """embed() by the registered model: its kind of provider, its dimension and its configuration."""
    row = model(models, model_id)
    config = {**json.loads(row.get("config_jsonb") or "{}"), "dimension": row["dimension"]}
    return embed(chunks, row["provider_type"], config, model_id=model_id)


def embed_and_upsert(stored: DataFrame, chunks: DataFrame, kind: str, config: dict, *, model_id: str) -> DataFrame:
    """The stored vectors with those of chunks in place of older ones, by (chunk_id, model_id)."""
    return upsert_latest(stored, embed(chunks, kind, config, model_id=model_id), ["chunk_id", "model_id"])


def model(models: DataFrame, model_id: str) -> dict:
    """The registered model of an id, as a dict; an unknown one is an error."""
    row = models.filter(F.col("model_id") == model_id).limit(1).collect()
    if not row:
        raise ValueError("model_not_found")
    return row[0].asDict()

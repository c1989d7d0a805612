"""The counters of a convergence loop as a stream, by transformWithState: runs share the state of a bucket.

An iteration comes out with streak, the iterations in a row with the key of the one before, with best_iter, the first of the
best so far, and with stale, the iterations since: what telemetry.no_progress() and running_best() say of a whole table.
A state for each run would be asked for and written run by run, which takes a millisecond or more; a bucket's runs are
asked for once a batch, and counted all at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "run_id bigint, iter bigint, streak bigint, best_iter bigint, stale bigint"
#: Fixed value: the states of a stream, which its checkpoint keeps.
BUCKETS = 512
_SCORE = list("abcd")
_KEPT = ["none", "run_id", "iter", "key", "streak", *_SCORE, "best"]


def follow(kept: pd.DataFrame | None, rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(the counters of the rows that are new, what is kept of every run) after rows (none, run_id, iter, key, a, b, c, d).

    Kept of a run are its last iteration and key, its streak, its best score and the iteration that had it.
    """
    rows = rows.assign(streak=0, best=rows["iter"], old=False)
    all_ = rows if kept is None else pd.concat([kept.assign(old=True), rows], ignore_index=True)
    all_ = all_.iloc[np.lexsort([all_["iter"], ~all_["old"], all_["run_id"], all_["none"]])].reset_index(drop=True)
    run = (all_[["none", "run_id"]] != all_[["none", "run_id"]].shift()).any(axis=1).cumsum().to_numpy()
    # an iteration that is there already, or comes after later ones, is passed over
    first = all_.groupby(run)[["iter", "old"]].transform("first")
    late = ~all_["old"] & first["old"] & (all_["iter"] <= first["iter"]) | ~all_["old"] & all_.groupby([run, "old"]).cumcount().gt(0) & (all_["iter"] == all_["iter"].shift())
    all_, run = all_[~late].reset_index(drop=True), run[~late.to_numpy()]
    new_run = np.append(True, run[1:] != run[:-1])
    key = pd.factorize(all_["key"])[0]  # nulls are equal
    begin = np.maximum.accumulate(np.where(new_run | np.append(True, key[1:] != key[:-1]), np.arange(len(run)), 0))
    streak = np.arange(len(run)) - begin + np.where(all_["old"].to_numpy()[begin], all_["streak"].to_numpy()[begin], 0)
    # later runs have the lower places, so the least so far starts anew with each
    order = np.lexsort([np.arange(len(run)), *(all_[x] for x in reversed(_SCORE)), -run])
    place = np.empty(len(run), np.int64)
    place[order] = np.arange(len(run))
    best = order[np.minimum.accumulate(place)]
    told = all_.assign(streak=streak, best=all_["best"].to_numpy()[best], **{x: all_[x].to_numpy()[best] for x in _SCORE})
    out = told[~told["old"]]
    ids = out["run_id"].astype("Int64").mask(out["none"])
    found = pd.DataFrame({"run_id": ids, "iter": out["iter"], "streak": out["streak"], "best_iter": out["best"], "stale": out["iter"] - out["best"]})
    return found, told[np.append(new_run[1:], True)][_KEPT]


class Counters(StatefulProcessor):
    """What is kept of a bucket's runs, as an Arrow stream: the same few numbers a run at any length."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("counters", "runs binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names of the interface
        kept = pa.ipc.open_stream(bytes(self.state.get()[0])).read_pandas() if self.state.exists() else None
        found, kept = follow(kept, pd.concat(list(rows), ignore_index=True).drop(columns="bucket"))
        body, sink = pa.Table.from_pandas(kept, preserve_index=False), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, body.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(body)
        self.state.update((sink.getvalue().to_pybytes(),))
        yield found

    def close(self) -> None:
        pass


def counted(iterations: DataFrame) -> DataFrame:
    """run_id, iter, streak, best_iter, stale of a stream (run_id, iter, key, score (a, b, c, d)).

    A run's iterations come in order, those of one batch in any; one that isn't after the run's last is passed over, so files
    that come again change nothing. Needs the RocksDB state store, which it sets in the session.
    """
    iterations.sparkSession.conf.set(STORE, ROCKS)
    run = F.col("run_id").cast("long")
    flat = iterations.select(
        F.pmod(F.xxhash64(run), F.lit(BUCKETS)).cast("int").alias("bucket"), run.isNull().alias("none"), F.coalesce(run, F.lit(0)).alias("run_id"),
        F.col("iter").cast("long").alias("iter"), F.col("key").cast("string").alias("key"), *(F.col(f"score.{x}").cast("double").alias(x) for x in "abcd"),
    )
    return flat.groupBy("bucket").transformWithStateInPandas(statefulProcessor=Counters(), outputStructType=OUT, outputMode="Append", timeMode="None")

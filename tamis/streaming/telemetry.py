"""Event logs as streams: window counts with a watermark, and deltas between logs kept as state (ST1)."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tamis.session import shared_dir

SLICE = 100_000


def read_parquet_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet file or folder as a stream of files."""
    schema = spark.read.parquet(path).schema
    if os.path.isfile(path):  # the file source watches folders
        folder, name = os.path.split(path)
        return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return spark.readStream.schema(schema).parquet(path)


def window_counts(events: DataFrame, at: str, by: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events a window and group; state older than the watermark is dropped."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def session_counts(events: DataFrame, at: str, by: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each group, ended by a gap."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Steps and seconds since the last log of a part that advanced; late or repeated logs are skipped.

    Spark hands a part's logs of a micro-batch over in several frames and in no set order, so they are put in order
    together (16 bytes a log); only logs of an earlier micro-batch's steps are late.
    """
    parts = [(f["step"].to_numpy(np.int64), f["seconds"].to_numpy(np.float64)) for f in (f[f["step"].notna()] for f in frames)]
    step, seconds = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0))
    order = np.lexsort((seconds, step))
    step, seconds = step[order], seconds[order]
    keep = np.append(True, step[1:] != step[:-1])[: len(step)]  # the first log of a step
    if state.exists:
        last = state.get
        keep &= step > last[0]
        step, seconds = np.append(last[0], step[keep]), np.append(last[1], seconds[keep])
    else:
        step, seconds = step[keep], seconds[keep]
    if len(step):
        state.update((int(step[-1]), float(seconds[-1])))
    on = np.flatnonzero(seconds[1:] > seconds[:-1])
    for i in range(0, max(1, len(on)), SLICE):
        at = on[i : i + SLICE]
        yield pd.DataFrame({"part": key[0], "step": step[at + 1], "d_step": step[at + 1] - step[at], "d_seconds": seconds[at + 1] - seconds[at]}, columns=["part", "step", "d_step", "d_seconds"])


def log_deltas(logs: DataFrame) -> DataFrame:
    """(part, step, d_step, d_seconds) from a stream of (part, step, seconds)."""
    return logs.groupBy("part").applyInPandasWithState(advance, "part bigint, step bigint, d_step bigint, d_seconds double", "step bigint, seconds double", "append", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over all that is there now and returns its result, kept with its checkpoint in the shared folder."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/tamis/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{base}/out")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")

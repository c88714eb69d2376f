"""Asynchronous batch jobs over file drops (SRC15, ST3): submit, poll until every job has ended, download.

A job is a folder of request lines, requests/job=<name>. Whoever serves it drops answers/job=<name> with a _SUCCESS file, or
failed/<name> with the reason. States are kept as JSON lines, states/, one line a job and change, so that a driver that was
lost goes on where it stopped: a job is submitted once, and its state is its last line's.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.sources.jsonl import exists

STATE = "job string, step int, state string, reason string"
ENDED = ("completed", "failed")


class Jobs:
    """The jobs of a folder in the shared file system."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def states(self) -> DataFrame:
        """(job, step, state, reason) of each job: its last line."""
        if not exists(self.spark, f"{self.folder}/states"):
            return self.spark.createDataFrame([], STATE)
        lines = self.spark.read.schema(STATE).json(f"{self.folder}/states")
        return lines.groupBy("job").agg(F.max_by(F.struct("step", "state", "reason"), "step").alias("s")).select("job", "s.*")

    def _append(self, rows: list[tuple]) -> None:
        if rows:
            self.spark.createDataFrame(rows, STATE).coalesce(1).write.mode("append").json(f"{self.folder}/states")

    def submit(self, requests: DataFrame, job: str) -> list[str]:
        """Writes the requests of jobs that aren't known yet; job names the column that tells them apart. One row a job is listed."""
        new = requests.join(self.states().select(F.col("job").alias("_known")), F.col(job) == F.col("_known"), "left_anti")
        names = sorted(r[0] for r in new.select(job).where(F.col(job).isNotNull()).distinct().collect())
        if names:
            new.where(F.col(job).isNotNull()).withColumn("job", F.col(job)).drop(*([job] if job != "job" else [])).write.mode("append").partitionBy("job").json(f"{self.folder}/requests")
            self._append([(n, 0, "submitted", None) for n in names])
        return names

    def poll(self) -> dict[str, str]:
        """Looks once for what was dropped and keeps what changed; the jobs' states."""
        rows, now = [], {}
        for r in self.states().collect():  # a row a job
            state, reason = r["state"], r["reason"]
            if state not in ENDED:
                failed = f"{self.folder}/failed/{r['job']}"
                if exists(self.spark, f"{self.folder}/answers/job={r['job']}/_SUCCESS"):
                    state, reason = "completed", None
                elif exists(self.spark, failed):
                    state, reason = "failed", self.spark.read.text(failed, wholetext=True).first()["value"]
                else:
                    state = "running"
                if state != r["state"]:
                    rows.append((r["job"], r["step"] + 1, state, reason))
            now[r["job"]] = state
        self._append(rows)
        return now

    def wait(self, every: float = 10.0, most: float = 86_400.0, between: Callable[[], None] | None = None) -> dict[str, str]:
        """Polls until all jobs have ended, or raises TimeoutError after `most` seconds."""
        until = time.monotonic() + most
        while not set((now := self.poll()).values()) <= set(ENDED):
            if time.monotonic() > until:
                raise TimeoutError(f"not ended: {sorted(j for j, s in now.items() if s not in ENDED)[:5]}")
            if between:
                between()
            time.sleep(every)
        return now

    def download(self, schema: str) -> DataFrame:
        """The answers of all completed jobs, with their job."""
        done = [r["job"] for r in self.states().where("state = 'completed'").select("job").collect()]
        if not done:
            return self.spark.createDataFrame([], f"{schema}, job string")
        every = self.spark.read.schema(schema).option("basePath", f"{self.folder}/answers").json([f"{self.folder}/answers/job={j}" for j in done])
        return every if "job" in every.columns else every.withColumn("job", F.regexp_extract(F.col("_metadata.file_path"), "job=([^/]+)/", 1))

"""A log of processing steps whose row counts are taken by the jobs that the steps run in anyway."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Log:
    """Steps in order; each marks a table, whose rows are counted whenever a job computes it. No step starts a job."""

    def __init__(self):
        self._steps: list[tuple[str, str, Observation, datetime]] = []

    def step(self, df: DataFrame, action: str, details: str = "") -> DataFrame:
        seen = Observation()
        self._steps.append((action, details, seen, datetime.now(timezone.utc)))
        return df.observe(seen, F.count(F.lit(1)).alias("n"))

    def table(self, spark: SparkSession) -> DataFrame:
        """(step, action, details, rows, removed, at): rows after each step, and how many fewer than before it; at: when it was planned. To be called when
        the steps' tables have been computed; waits for the counts."""
        rows, last = [], None
        for i, (action, details, seen, at) in enumerate(self._steps):
            n = int(seen.get["n"])
            rows.append((i + 1, action, details, n, 0 if last is None else last - n, at))
            last = n
        return spark.createDataFrame(rows, "step int, action string, details string, rows long, removed long, at timestamp")


def step(log: Log | None, df: DataFrame, action: str, details: str = "") -> DataFrame:
    """log.step(), if there is a log."""
    return df if log is None else log.step(df, action, details)

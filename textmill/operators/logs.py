"""Diagnostics logs, detached jobs and bursts of calls."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Records before an error that the recorder keeps; days and bytes of logs that stay; quiet time that ends a burst. Fixed values.
RING, KEEP_DAYS, KEEP_BYTES, QUIET_US = 64, 30, 384 * 1024 * 1024, 2_000_000
#: Finished jobs that are remembered. Fixed value.
HISTORY = 32
ENDED = ["completed", "terminated", "timed_out", "outcome_uncertain"]


def flight_recorder(log: DataFrame, instance: str, order: str, is_error, ring: int = RING) -> DataFrame:
    """Errors, and of the records since the error before up to ring last ones, flagged as context. Records after the last error stay unwritten."""
    by = Window.partitionBy(instance)
    d = log.withColumn("_error", is_error.cast("int"))
    d = d.withColumn("segment", F.coalesce(F.sum("_error").over(by.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    seg = Window.partitionBy(instance, "segment")
    d = d.withColumns({"_last": F.max("_error").over(seg), "_back": F.row_number().over(seg.orderBy(F.col(order).desc()))})
    return d.where((F.col("_last") == 1) & (F.col("_back") <= ring + 1)).withColumn("context", F.col("_error") == 0).drop("_error", "_last", "_back")


def status(files: DataFrame, records: DataFrame) -> DataFrame:
    """One row: files, bytes, oldest and newest day, and records that were dropped."""
    f = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.min("dt").alias("oldest"), F.max("dt").alias("newest"))
    return f.crossJoin(records.agg(F.coalesce(F.sum("dropped_since_last"), F.lit(0)).alias("dropped")))  # one row by one row


def retention(files: DataFrame, today, days: int = KEEP_DAYS, most: int = KEEP_BYTES) -> DataFrame:
    """files(path, dt, bytes) with removed: older than days, or beyond most bytes counted from the newest; today's always stay.

    The running total is over days first (one row each), then within a day, so that no task gets all files.
    """
    per_day = files.groupBy("dt").agg(F.sum("bytes").alias("day_bytes"))
    past = per_day.where(F.col("dt") < today).where(F.col("dt") >= F.date_sub(today, days))
    newer = F.coalesce(F.sum("day_bytes").over(Window.orderBy(F.col("dt").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = files.join(past.select("dt", newer.alias("newer")), "dt", "left")
    own = F.sum("bytes").over(Window.partitionBy("dt").orderBy(F.col("path").desc()).rowsBetween(Window.unboundedPreceding, 0))
    used = F.col("newer") + own
    removed = F.when(F.col("dt") >= today, False).when(F.col("dt") < F.date_sub(today, days), True).otherwise(used > most)
    return d.withColumn("removed", removed).drop("newer")


def job_states(events: DataFrame) -> DataFrame:
    """events(job_id, at, state) -> job_id, started, finished, state: the first terminal event decides, else the last event."""
    ended = F.col("state").isin(ENDED)
    return events.groupBy("job_id").agg(
        F.min("at").alias("started"), F.min(F.when(ended, F.col("at"))).alias("finished"),
        F.coalesce(F.min_by(F.when(ended, F.col("state")), F.when(ended, F.struct("at", "state"))), F.max_by("state", F.struct("at", "state"))).alias("state"),
    )


def job_history(jobs: DataFrame, most: int = HISTORY) -> DataFrame:
    """The most finished jobs that finished last: a top-k."""
    return jobs.where("finished IS NOT NULL").orderBy(F.col("finished").desc(), "job_id").limit(most)


def job_lookup(wanted: DataFrame, active: DataFrame, ended: DataFrame) -> DataFrame:
    """State of wanted jobs: the active table first, then the history, else unknown."""
    a, t = active.select("job_id", F.col("state").alias("a")), ended.select("job_id", F.col("state").alias("t"))
    return wanted.join(a, "job_id", "left").join(t, "job_id", "left").select("job_id", F.coalesce("a", "t", F.lit("unknown")).alias("state"))


def bursts(calls: DataFrame, key: str, start: str, end: str, quiet: int = QUIET_US, tie: str = "call_id") -> DataFrame:
    """calls with burst_id from 1 within key: a call that starts quiet or more after all before it have ended begins a burst."""
    w = Window.partitionBy(key).orderBy(start, tie)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col(start) >= before + quiet), 1).otherwise(0)
    return calls.withColumn("_new", new).withColumn("burst_id", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")


def admissions(jobs: DataFrame, key: str, start: str, end: str, slots: int = 16) -> DataFrame:
    """jobs with admitted (whether fewer than slots admitted jobs of the key run when it starts) and active (those, and itself if admitted).

    A job that isn't admitted holds no slot, so who is depends on all before: rows come in order of key and start,
    and of a key only its admitted jobs' ends are held, slots of them at most. A null end is never.
    """
    schema = T.StructType([*jobs.schema, T.StructField("active", T.IntegerType()), T.StructField("admitted", T.BooleanType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, ends = None, []
        for pdf in batches:
            active, admitted = [], []
            for k, a, b in zip(pdf[key].tolist(), pdf[start].tolist(), pdf[end].tolist(), strict=True):
                if k != of:
                    of, ends = k, []
                while ends and ends[0] <= a:
                    heapq.heappop(ends)
                admitted.append(len(ends) < slots)
                if admitted[-1]:
                    heapq.heappush(ends, math.inf if b is None or b != b else b)
                active.append(len(ends))
            yield pdf.assign(active=active, admitted=admitted)

    return jobs.repartition(key).sortWithinPartitions(key, start, "job_id").mapInPandas(run, schema)

"""Streams of calls, log records and job events; each gives what its batch form gives once the stream is read up."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textmill.operators.logs import ENDED, QUIET_US, RING


def _in_order(frames: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    rows = list(frames)
    return pd.concat(rows).sort_values(by, kind="stable") if rows else pd.DataFrame()


def burst_stream(calls: DataFrame, key: str, quiet: int = QUIET_US) -> DataFrame:
    """calls(key, call_id, start_us, end_us) -> key, call_id, burst_id. State of a key: its burst and the latest end; calls of a batch are taken by start."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        burst, latest = state.get if state.exists else (0, None)
        out = []
        for r in _in_order(frames, ["start_us", "call_id"]).itertuples():
            if latest is None or r.start_us >= latest + quiet:
                burst, latest = burst + 1, r.end_us
            latest = max(latest, r.end_us)
            out.append((k[0], r.call_id, burst))
        state.update((burst, latest))
        yield pd.DataFrame(out, columns=[key, "call_id", "burst_id"])

    kind = calls.schema[key].dataType.simpleString()
    return calls.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, call_id long, burst_id long", "burst long, latest long", "append", GroupStateTimeout.NoTimeout)


def allowance_stream(calls: DataFrame, key: str, limit: int, quiet: int = QUIET_US) -> DataFrame:
    """events(key, call_id, at_us, kind begin | claim | finish, tokens) -> key, call_id, burst_id, allowance: what each claim may use.

    A claim gets the tokens left (limit less those spent and reserved) shared among calls that haven't claimed.
    """

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        burst, active, unclaimed, spent, ended, held = state.get if state.exists else (0, 0, 0, 0, None, {})
        held = dict(held)
        out = []
        for r in _in_order(frames, ["at_us", "call_id"]).itertuples():
            if r.kind == "begin":
                if burst == 0 or (active == 0 and ended is not None and r.at_us - ended >= quiet):
                    burst, spent, ended, held = burst + 1, 0, None, {}
                active, unclaimed = active + 1, unclaimed + 1
            elif r.kind == "claim" and r.call_id not in held:
                held[r.call_id] = max(0, limit - spent - sum(held.values())) // max(1, unclaimed)
                unclaimed = max(0, unclaimed - 1)
                out.append((k[0], r.call_id, burst, held[r.call_id]))
            elif r.kind == "finish":
                if held.pop(r.call_id, None) is None:
                    unclaimed = max(0, unclaimed - 1)
                spent, active = spent + int(r.tokens), max(0, active - 1)
                if active == 0:
                    ended = r.at_us
        state.update((burst, active, unclaimed, spent, ended, held))
        yield pd.DataFrame(out, columns=[key, "call_id", "burst_id", "allowance"])

    kind = calls.schema[key].dataType.simpleString()
    return calls.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, call_id long, burst_id long, allowance long", "burst long, active long, unclaimed long, spent long, ended long, held map<long,long>", "append", GroupStateTimeout.NoTimeout)


def recorder_stream(log: DataFrame, instance: str, ring: int = RING) -> DataFrame:
    """log(instance, record_id, is_error) -> instance, record_id, context. State: the last ring records since the last error. Records of a batch are taken by record_id."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        out = []
        for r in _in_order(frames, ["record_id"]).itertuples():
            if r.is_error:
                out += [(k[0], x, True) for x in kept] + [(k[0], r.record_id, False)]
                kept = []
            else:
                kept = (kept + [r.record_id])[-ring:]
        state.update((kept,))
        yield pd.DataFrame(out, columns=[instance, "record_id", "context"])

    kind = log.schema[instance].dataType.simpleString()
    return log.groupBy(instance).applyInPandasWithState(run, f"{instance} {kind}, record_id long, context boolean", "kept array<long>", "append", GroupStateTimeout.NoTimeout)


def job_stream(events: DataFrame) -> DataFrame:
    """events(job_id, at_us, state, timeout_ms) -> job_id, at_us, state: each change of a job's state.

    The first terminal event wins. A job past its timeout times out at its deadline, which the next event of the
    job shows (a row with state `tick` does nothing else), so a result depends on the events alone.
    """

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, deadline = state.get if state.exists else (None, None)
        out = []
        for r in _in_order(frames, ["at_us"]).itertuples():
            if now not in ENDED and deadline is not None and r.at_us >= deadline:
                now = "timed_out"
                out.append((k[0], deadline, now))
            if r.state == "tick" or now in ENDED or r.state == now:
                continue
            now = r.state
            out.append((k[0], r.at_us, now))
            if r.timeout_ms and r.timeout_ms > 0:
                deadline = r.at_us + int(r.timeout_ms) * 1000
        state.update((now, deadline))
        yield pd.DataFrame(out, columns=["job_id", "at_us", "state"])

    return events.groupBy("job_id").applyInPandasWithState(run, "job_id long, at_us long, state string", "state string, deadline long", "append", GroupStateTimeout.NoTimeout)


def read_up(spark: SparkSession, stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream over what is there now into Parquet below folder (a shared one) and give its rows."""
    q = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start(f"{folder}/rows")
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")

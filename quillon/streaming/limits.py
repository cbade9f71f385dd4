"""Keyed state machines over event logs as batch folds, and a windowed count of a stream."""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def admit_each(times: list[float], limit: int, seconds: float, held: list[float]) -> tuple[list[bool], list[int | None], list[float]]:
    """(whether each hit is admitted, seconds until another would be, admitted times of the last window). Admitted: fewer than limit admitted hits in the trailing window; others are not recorded."""
    held, out, wait = list(held), [], []
    for t in times:
        held = [h for h in held if h > t - seconds]
        out.append(len(held) < limit)
        wait.append(None if out[-1] else math.ceil(seconds - (t - held[0])))
        if out[-1]:
            held.append(t)
    return out, wait, held


def admit(times: list[float], limit: int, seconds: float, held: list[float] | None = None) -> tuple[list[bool], list[float]]:
    out, _, held = admit_each(times, limit, seconds, held or [])
    return out, held


def _carried(events: DataFrame, key: str, ts: str, order: str, fold: Callable, flag: str, kind: str, used: tuple[str, ...] = ()) -> DataFrame:
    """events with the flag that fold(rows of one key, state) -> (flags, state) gives each row, in order of ts and `order`.

    Rows are dealt by ranges of key and time, so a key's long log is cut and each task holds one batch. A task starts with the state
    that the one before it ended with, where both have the same key: all tasks run from no state first, then those whose
    start has changed run again until none has. A round settles one more task at least, mostly nearly all."""
    columns = events.columns
    timed = events.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")))
    rows = timed.repartitionByRange(F.col(key), F.col("_t"), F.col(order)).sortWithinPartitions(key, "_t", order).withColumn("_key", F.col(key).cast("string")).withColumn("_part", F.spark_partition_id()).persist(StorageLevel.DISK_ONLY)

    def run(batches: Iterator[pa.RecordBatch], carry: dict, ends: bool) -> Iterator[pa.RecordBatch]:
        part = first = last = state = None
        for batch in batches:
            flags: list = []
            # the other columns stay as they are
            for k, some in batch.select(["_key", "_t", "_part", *used]).to_pandas().groupby("_key", sort=False, dropna=False):
                k = None if pd.isna(k) else k
                if part is None:
                    part, first, last = int(some["_part"].iloc[0]), k, k
                    state = carry.get(part)
                elif k != last:
                    last, state = k, None
                got, state = fold(some, state)
                flags += got
            if not ends:
                yield pa.RecordBatch.from_arrays([*(batch[n] for n in columns), pa.array(flags, pa.bool_() if kind == "boolean" else pa.int32())], [*columns, flag])
        if ends and part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([int(part)], pa.int32()), pa.array([pickle.dumps((first, last, state))], pa.binary())], ["part", "end"])

    carry: dict = {}
    found: dict = {}
    todo = None
    while todo is None or todo:
        some = rows if todo is None else rows.where(F.col("_part").isin(sorted(todo)))
        found |= {r["part"]: pickle.loads(r["end"]) for r in some.mapInArrow(lambda x, c=carry: run(x, c, True), "part int, end binary").collect()}  # a row for each task
        parts = sorted(found)
        new = {q: found[p][2] for p, q in zip(parts, parts[1:]) if found[p][1] == found[q][0]}
        todo, carry = {p for p in parts if new.get(p) != carry.get(p)}, new
    schema = ", ".join(f"`{n}` {t}" for n, t in events.dtypes) + f", {flag} {kind}"
    return rows.mapInArrow(lambda x: run(x, carry, False), schema)


def rate_limit(events: DataFrame, key: str, ts: str, order: str, limit: int, seconds: float) -> DataFrame:
    """Add admitted. Only the admitted hits of one window are held."""
    return _carried(events.where(F.col(key).isNotNull()), key, ts, order, lambda rows, held: admit((rows["_t"] / 1e6).tolist(), limit, seconds, held), "admitted", "boolean")


def fixed_window(events: DataFrame, key: str, ts: str, order: str, limit: int, seconds: int) -> DataFrame:
    """(key, hits, admitted): windows of a fixed length from the first hit after the last window's end."""

    def fold(rows: pd.DataFrame, state: tuple | None) -> tuple[list[int], tuple]:
        (start, n), out = state or (-(2**62), 0), []
        for t in rows["_t"].tolist():
            start, n = (t, 1) if t - start >= seconds * 1_000_000 else (start, n + 1)
            out.append(int(n <= limit))
        return out, (start, n)

    flagged = _carried(events.select(key, ts, order), key, ts, order, fold, "_ok", "int")
    return flagged.groupBy(key).agg(F.count(F.lit(1)).cast("int").alias("hits"), F.sum("_ok").cast("int").alias("admitted"))


def breaker(events: DataFrame, key: str, ts: str, order: str, failed: str, trips_at: int = 3, open_seconds: int = 30) -> DataFrame:
    """(key, trips, refused): opens after trips_at failures in a row, for open_seconds; success resets the count."""

    def fold(rows: pd.DataFrame, state: tuple | None) -> tuple[list[int], tuple]:
        (run, until), out = state or (0, -(2**62)), []
        for t, bad in zip(rows["_t"].tolist(), (rows[failed] == True).tolist()):  # noqa: E712
            if t < until:
                out.append(2)
                continue
            run = run + 1 if bad else 0
            trip = bad and run >= trips_at
            until = t + open_seconds * 1_000_000 if trip else until
            out.append(int(trip))
        return out, (run, until)

    flagged = _carried(events.select(key, ts, order, failed), key, ts, order, fold, "_flag", "int", (failed,))
    return flagged.groupBy(key).agg(F.count_if(F.col("_flag") == 1).cast("int").alias("trips"), F.count_if(F.col("_flag") == 2).cast("int").alias("refused"))


def streaming_counts(events: DataFrame, ts: str, key: str, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Hits per key and window of a stream, with a watermark for late events."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window), key).count()

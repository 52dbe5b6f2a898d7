"""User jobs: a named filter with a reduction, and emit-style map/reduce."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from jobledger.operators.lineage import run_until  # noqa: F401  (iterative jobs)


@dataclass(frozen=True)
class Job:
    """A filter over reports and what to make of the reports that pass."""

    where: Callable[[DataFrame], Column]
    reduce: Callable[[DataFrame], DataFrame]


_JOBS: dict[str, Job] = {}


def _count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def register_job(name: str, where: Callable[[DataFrame], Column],
                 reduce: Callable[[DataFrame], DataFrame] | None = None) -> Job:
    """Register a job; without a reduction, or with a name ending in Counter, it counts."""
    if reduce is None or name.endswith("Counter"):
        reduce = _count
    _JOBS[name] = Job(where, reduce)
    return _JOBS[name]


def run_job(df: DataFrame, name: str | None = None) -> DataFrame:
    """Run a registered job; without a name, count the documents."""
    if name is None:
        return _count(df)
    job = _JOBS[name]
    return job.reduce(df.where(job.where(df)))


def filter_rows(df: DataFrame, keep: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """Filter by any Python predicate, one Arrow batch at a time."""
    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[keep(frame)]

    return df.mapInPandas(batches, df.schema)


def emit(df: DataFrame, mapper: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Rows emitted by a mapper (none, one or many per report), one Arrow batch at a time."""
    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield mapper(frame)

    return df.mapInPandas(batches, schema)


# Partial results are passed on once this many keys wait in a task.
MAX_WAITING_KEYS = 100_000


def emit_reduce(df: DataFrame, mapper: Callable[[pd.DataFrame], pd.DataFrame],
                merge: Callable[[pd.DataFrame], pd.DataFrame], schema: str, key: str = "key") -> DataFrame:
    """Map/reduce with a Python mapper and an associative Python merge.

    ``merge`` takes emitted rows and returns one row per key in the same schema;
    it is applied to its own results, as a combiner is.  It first runs inside
    every map task, so one key leaves a task as one row and a key that holds
    most rows reaches its reducer as about one row per task.  The reducer reads
    rows sorted by key and holds back only the last key of a batch.  Rows with a
    null key are a group like any other, so ``merge`` must keep them (``groupby``
    needs ``dropna=False``).  How many keys wait in a task changes no result:
    what is passed on early is merged again by the reducer.
    """
    def combine(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting = None
        for frame in frames:
            emitted = merge(mapper(frame))
            waiting = emitted if waiting is None else merge(pd.concat([waiting, emitted], ignore_index=True))
            if len(waiting) > MAX_WAITING_KEYS:
                yield waiting
                waiting = None
        if waiting is not None:
            yield waiting

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            merged = merge(frame if held is None else pd.concat([held, frame], ignore_index=True))
            end = frame[key].iloc[-1] if len(frame) else None
            last = merged[key].isna() if pd.isna(end) else merged[key] == end
            yield merged[~last]
            held = merged[last]
        if held is not None:
            yield held

    partial = df.mapInPandas(combine, schema)
    return partial.repartition(F.col(key)).sortWithinPartitions(key).mapInPandas(finish, schema)

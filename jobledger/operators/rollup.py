"""Roll-ups: one row per time bucket and job scope.

A roll-up row keeps the sum and the number of every metric, not its average, so
rows can be merged and made coarser exactly, in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from jobledger.functions.nested import job_metric, job_metric_group, total_events
from jobledger.functions.scalar import bucket_end, bucket_start, scope_hash, timestamp_of
from jobledger.operators.extract import scope_of_job
from jobledger.schema import ROLLUP_KEYS, SCOPE_KEYS, TREE_METRICS, metric_column

MEASURES = ["count", "events_sum", "events_n"]


def measure_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c in MEASURES or c.endswith(("_sum", "_n"))]


def job_facts(df: DataFrame, exit_policy: str = "first_valid", perf_policy: str = "first",
              metrics: list[str] | None = None) -> DataFrame:
    """One flat row per report: time, scope keys, events and metrics."""
    metrics = TREE_METRICS if metrics is None else metrics
    scoped = scope_of_job(df, exit_policy)
    groups = sorted({m.split(".")[0] for m in metrics})
    if perf_policy == "first":
        # Pick each metric map once per report, then read single metrics from it.
        scoped = scoped.withColumns({f"_{g}": job_metric_group(g) for g in groups})
        values = {m: F.try_element_at(F.col(f"_{m.split('.')[0]}"), F.lit(m.split(".")[1])) for m in metrics}
    else:
        values = {m: job_metric(m, perf_policy) for m in metrics}
    return scoped.select(
        timestamp_of(F.col("meta.ts")).alias("ts"), *SCOPE_KEYS, total_events().alias("events"),
        *[values[m].alias(metric_column(m)) for m in metrics])


def closed(df: DataFrame, precision: str, columns: list[str] | None = None) -> DataFrame:
    """Add end and precision of the buckets, in the order of roll-up columns."""
    whole = df.withColumns({"end_date": bucket_end(F.col("start_date"), precision), "precision": F.lit(precision)})
    return whole.select(*(columns or [*ROLLUP_KEYS, *measure_columns(df)]))


def _sum_and_n(name: str) -> list[Column]:
    """Sum and number of the values present; NaN counts as missing."""
    value = F.when(~F.isnan(name), F.col(name)) if name != "events" else F.col(name)
    return [F.sum(value).alias(f"{name}_sum"), F.count(value).alias(f"{name}_n")]


def rollup(df: DataFrame, precision: str = "day", exit_policy: str = "first_valid",
           perf_policy: str = "first", metrics: list[str] | None = None) -> DataFrame:
    """Reports to roll-up rows, by one hash aggregation with map-side partial sums.

    The end of a bucket and the precision follow from its start, so they are
    added to the result instead of widening the grouping key.
    """
    metrics = TREE_METRICS if metrics is None else metrics
    facts = job_facts(df, exit_policy, perf_policy, metrics).withColumn("start_date", bucket_start(F.col("ts"), precision))
    sums = facts.groupBy("start_date", *SCOPE_KEYS).agg(*rollup_measures(metrics))
    return closed(sums, precision)


def rollup_measures(metrics: list[str]) -> list[Column]:
    measures = [F.count("*").alias("count"), *_sum_and_n("events")]
    for metric in metrics:
        measures += _sum_and_n(metric_column(metric))
    return measures


def with_hash(df: DataFrame) -> DataFrame:
    """Add the hash of the whole scope, the key of a stored roll-up row."""
    return df.withColumn("hash", scope_hash(*ROLLUP_KEYS))


def _resum(df: DataFrame) -> DataFrame:
    return df.groupBy(*ROLLUP_KEYS).agg(*[F.sum(c).alias(c) for c in measure_columns(df)])


def merge_rollups(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two roll-ups as one, as if their reports had been rolled up together."""
    return _resum(first.unionByName(second, allowMissingColumns=True))


# What each precision can be made into without splitting a bucket.
COARSER = {"hour": ["day", "week", "month"], "day": ["week", "month"], "week": [], "month": []}


def coarsen(df: DataFrame, source: str, target: str) -> DataFrame:
    """Roll-up rows of one precision at a coarser one, exactly.

    Weeks cross month borders, so week to month is refused.
    """
    if target not in COARSER[source]:
        raise ValueError(f"{source} rows cannot be made into {target} rows")
    wider = df.withColumn("start_date", bucket_start(F.col("start_date"), target))
    sums = wider.groupBy("start_date", *SCOPE_KEYS).agg(*[F.sum(c).alias(c) for c in measure_columns(df)])
    return closed(sums, target)


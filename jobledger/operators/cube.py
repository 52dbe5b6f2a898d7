"""Queries over a roll-up: metric by axis, filters, suggestions, totals."""

from __future__ import annotations

import datetime as dt
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from jobledger.functions.scalar import iso_ts
from jobledger.schema import SCOPE_KEYS, metric_column


def _key_test(key: str, wanted: str) -> Column:
    """Regular expression found anywhere; an exit code must be equal instead."""
    if key not in SCOPE_KEYS:
        raise ValueError(f"no such scope key: {key}")
    if key == "exitCode":
        return F.col(key) == str(wanted)
    return F.col(key).rlike(wanted)


def _all(tests: list[Column]) -> Column:
    return reduce(and_, tests, F.lit(True))


def scope_filter(df: DataFrame, **wanted: str | None) -> DataFrame:
    return df.where(_all([_key_test(k, w) for k, w in wanted.items() if w is not None]))


def timeframe_test(start: dt.date | None = None, end: dt.date | None = None) -> Column:
    tests = []
    if start is not None:
        tests.append(F.col("start_date") >= F.lit(f"{start} 00:00:00").cast("timestamp_ntz"))
    if end is not None:
        after = end + dt.timedelta(days=1)
        tests.append(F.col("end_date") <= F.lit(f"{after} 00:00:00").cast("timestamp_ntz"))
    return _all(tests)


def timeframe(df: DataFrame, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """Buckets from the start of one day up to the end of another, inclusive.

    A stored roll-up has its month as partition columns; the frame prunes them.
    """
    if {"year", "month"} <= set(df.columns):
        month = F.col("year") * 12 + F.col("month")
        for day, test in ((start, month.__ge__), (end, month.__le__)):
            if day is not None:
                df = df.where(test(day.year * 12 + day.month))
    return df.where(timeframe_test(start, end))


def axis_label(axis: str) -> Column:
    """Label of a row on an axis: a scope key, ``time`` or ``_summary``."""
    if axis == "_summary":
        return F.lit("_summary")
    if axis == "time":
        return F.concat(iso_ts(F.col("start_date")), F.lit("/"), iso_ts(F.col("end_date")))
    return F.col(axis)


def _measure(metric: str) -> tuple[Column, Column]:
    name = "events" if metric == "data.events" else metric_column(metric)
    return F.col(f"{name}_sum"), F.col(f"{name}_n")


def _axis_keys(df: DataFrame, axis: str) -> tuple[DataFrame, list[str]]:
    return df.withColumn("label", axis_label(axis)), ["label"]


def metric_by(df: DataFrame, metric: str, axis: str = "_summary") -> DataFrame:
    """Average and number of a metric along an axis; rows below zero do not count.

    ``average`` weights each row by its number of values, ``average_unweighted``
    is the plain mean of the rows' means.
    """
    total, n = _measure(metric)
    rows, keys = _axis_keys(df.where((n > 0) & (total / n >= 0)), axis)
    return rows.groupBy(*keys).agg(
        (F.sum(total) / F.sum(n)).alias("average"),
        F.avg(total / n).alias("average_unweighted"),
        F.sum(n).alias("count"))


def jobstate_by(df: DataFrame, axis: str = "_summary", nested: bool = False) -> DataFrame:
    """Jobs per state along an axis; ``nested`` gives one row per label."""
    rows, keys = _axis_keys(df, axis)
    states = rows.groupBy(*keys, "jobstate").agg(F.sum("count").alias("count"))
    if not nested:
        return states
    # States are few (one row each after the sum above), so the list is short.
    return states.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("jobstate", "count"))).alias("jobstates"))


def exitcodes_by(df: DataFrame, axis: str = "exitCode") -> DataFrame:
    """Roll-up rows and jobs with an exit code along an axis."""
    rows, keys = _axis_keys(df.where(F.col("exitCode").isNotNull()), axis)
    return rows.groupBy(*keys).agg(F.count("*").alias("rows"), F.sum("count").alias("jobs")).orderBy(*keys)


def status(df: DataFrame, start: dt.date | None = None, end: dt.date | None = None,
           **wanted: str | None) -> DataFrame:
    """One row: jobs and dates of the rows that match, and dates of all rows, in one pass."""
    match = timeframe_test(start, end) & _all([_key_test(k, w) for k, w in wanted.items() if w is not None])
    return df.withColumn("_match", match).agg(
        F.coalesce(F.sum(F.when(F.col("_match"), F.col("count"))), F.lit(0)).alias("total_matched_jobs"),
        iso_ts(F.min(F.when(F.col("_match"), F.col("start_date")))).alias("start_date"),
        iso_ts(F.max(F.when(F.col("_match"), F.col("end_date")))).alias("end_date"),
        iso_ts(F.min("start_date")).alias("min_date"), iso_ts(F.max("end_date")).alias("max_date"))


def suggestions(df: DataFrame, keys: list[str] | None = None, filters: dict[str, str] | None = None,
                limit: int | None = None) -> DataFrame:
    """Distinct values of each key under all filters but the key's own, in one pass.

    Every filter becomes a boolean; a row offers its value for a key when the
    other booleans hold.  ``limit`` keeps the first values of each key.
    """
    keys = keys or SCOPE_KEYS
    filters = {k: w for k, w in (filters or {}).items() if w is not None}
    tests = {k: F.coalesce(_key_test(k, w), F.lit(False)) for k, w in filters.items()}
    # Results are columns of the row below the unfolding, so each filter is evaluated once.
    offers = [
        F.struct(F.lit(key).alias("key"), F.col(key).alias("value"),
                 _all([F.get("_tests", F.lit(i)) for i, k in enumerate(tests) if k != key]).alias("keep"))
        for key in keys
    ]
    values = (df.withColumn("_tests", F.array(*tests.values())).select(F.explode(F.array(*offers)).alias("o"))
                .where("o.keep").select("o.key", "o.value").distinct())
    if limit is None:
        return values
    from jobledger.operators.ranking import first_per_group
    return first_per_group(values, ["key"], [F.col("value").asc_nulls_first()], limit)


def performance(df: DataFrame, metrics: list[str], axes: list[str]) -> DataFrame:
    """All requested metrics along all requested axes by one aggregation.

    Each row is unfolded to (axis, label) pairs, then all metrics are summed
    under (axis, label), and the few result rows are unfolded by metric.
    """
    pairs = [F.struct(F.lit(a).alias("axis"), axis_label(a).alias("label")) for a in axes]
    tree = [m for m in metrics if m not in ("jobstate", "data.exitcodes")]
    wide = df.select("*", F.explode(F.array(*pairs)).alias("_on"))
    measures = [F.sum("count").alias("_jobs"),
                F.sum(F.when(F.col("exitCode").isNotNull(), F.col("count"))).alias("_coded"),
                F.count(F.when(F.col("exitCode").isNotNull(), 1)).alias("_coded_rows")]
    for metric in tree:
        total, n = _measure(metric)
        good = (n > 0) & (total / n >= 0)
        name = metric_column(metric)
        measures += [F.sum(F.when(good, total)).alias(f"_{name}_sum"), F.sum(F.when(good, n)).alias(f"_{name}_n")]
    summed = wide.groupBy(F.col("_on.axis").alias("axis"), F.col("_on.label").alias("label")).agg(*measures)
    results = []
    for metric in metrics:
        if metric == "jobstate":
            average, number = F.col("_jobs").cast("double"), F.col("_jobs")
        elif metric == "data.exitcodes":
            average, number = F.col("_coded_rows").cast("double"), F.col("_coded")
        else:
            name = metric_column(metric)
            average, number = F.col(f"_{name}_sum") / F.col(f"_{name}_n"), F.col(f"_{name}_n")
        results.append(F.struct(F.lit(metric).alias("metric"), average.alias("average"), number.alias("count")))
    return (summed.select("axis", "label", F.explode(F.array(*results)).alias("r"))
                  .where(F.col("r.count") > 0)
                  .select("r.metric", "axis", "label", "r.average", "r.count"))

"""Ordering, top lists and shares over labelled values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Job states.
JOB_STATES = ["success", "jobfailed", "submitfailed"]


def top_labels(df: DataFrame, value: str = "count", k: int = 5, page: int = 0, label: str = "label") -> DataFrame:
    """One page of labels by descending value, as a distributed top-k with an offset."""
    return (df.orderBy(F.col(value).desc_nulls_last(), F.col(label).asc_nulls_first())
              .offset(page * k).limit(k))


def all_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows by label; a missing label sorts as an empty text."""
    return df.withColumn(label, F.coalesce(label, F.lit(""))).orderBy(label)


def share(df: DataFrame, value: str = "count") -> DataFrame:
    """Each value as a share of the total; the total is a scalar subquery, not a window over all rows."""
    return df.withColumn("share", F.col(value) / df.agg(F.sum(value)).scalar())


def relative(df: DataFrame, value: str = "count") -> DataFrame:
    """Each value relative to the largest."""
    return df.withColumn("relative", F.col(value) / df.agg(F.max(value)).scalar())


def state_share(states: DataFrame, label: str = "label") -> DataFrame:
    """Share of each state within its label; a label has one row per state."""
    return states.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy(label)))


def stack_states(states: DataFrame, label: str = "label") -> DataFrame:
    """Start and end of each state when a label's states are stacked by name, absent states as zero.

    Every row brings the zeros along, which the partial sums remove again, so the input is read once.
    """
    own = F.struct(F.col("jobstate"), F.col("count").cast("bigint").alias("count"))
    zeros = [F.struct(F.lit(s).alias("jobstate"), F.lit(0).cast("bigint").alias("count")) for s in JOB_STATES]
    filled = states.select(label, F.explode(F.array(own, *zeros)).alias("s")) \
                   .groupBy(label, F.col("s.jobstate").alias("jobstate")).agg(F.sum("s.count").alias("count"))
    running = Window.partitionBy(label).orderBy("jobstate").rowsBetween(Window.unboundedPreceding, 0)
    return (filled.withColumn("end", F.sum("count").over(running))
                  .withColumn("start", F.col("end") - F.col("count")))


def time_series(df: DataFrame, when: str = "start_date") -> DataFrame:
    """Newest first."""
    return df.orderBy(F.col(when).desc())


def first_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """First k rows of each group; Spark drops later rows before the shuffle already."""
    numbered = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered.where(F.col("_rank") <= k).drop("_rank")

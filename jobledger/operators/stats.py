"""Statistics over reports and roll-ups, and catalogue joins."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from jobledger.functions.nested import job_metric
from jobledger.functions.scalar import is_cmsrun
from jobledger.operators.cube import timeframe
from jobledger.operators.search import at_site, succeeded
from jobledger.schema import METRIC_CATALOGUE, STORAGE_ATTRIBUTES


def daily_counts(df: DataFrame, kind: str, year: int, months: list[int]) -> DataFrame:
    """Reports per day of some months; other months are never read."""
    rows = df.where((F.col("year") == year) & F.col("month").isin(months) & (F.col("kind") == kind))
    return rows.groupBy("year", "month", "day").agg(F.count("*").alias("n"))


def _first_cmsrun_storage() -> Column:
    zipped = F.arrays_zip(F.col("steps.name"), F.col("steps.performance.storage"))
    return F.get(F.filter(zipped, lambda s: is_cmsrun(s["name"])), F.lit(0))["storage"]


def storage_values(df: DataFrame, sites: list[str]) -> DataFrame:
    """One row per successful report at the sites and storage attribute."""
    reports = at_site(succeeded(df), sites).select("report_id", _first_cmsrun_storage().alias("storage"))
    pairs = [F.struct(F.lit(a).alias("attribute"), F.try_element_at("storage", F.lit(a)).alias("value"))
             for a in STORAGE_ATTRIBUTES]
    return reports.select("report_id", F.explode(F.array(*pairs)).alias("p")).select("report_id", "p.*")


def storage_stats(df: DataFrame, sites: list[str]) -> DataFrame:
    """Per storage attribute: zeros, missing, present, mean, smallest non-zero, largest; and all records."""
    return storage_values(df, sites).groupBy("attribute").agg(
        F.count_if(F.col("value") == 0).alias("count0"),
        F.count_if(F.col("value").isNull()).alias("count1"),
        F.count("value").alias("total"),
        F.avg("value").alias("mean"),
        F.coalesce(F.min(F.nullif("value", F.lit(0.0))), F.lit(0.0)).alias("min"),
        F.greatest(F.max("value"), F.lit(0.0)).alias("max"),
        F.count("*").alias("nrecords"))


def storage_extremes(df: DataFrame, sites: list[str], attribute: str = "writeTotalSecs") -> DataFrame:
    """The reports with the largest and the smallest non-zero value; ties go to the lower id."""
    value = F.try_element_at(_first_cmsrun_storage(), F.lit(attribute))
    rows = at_site(succeeded(df), sites).select(
        "report_id", F.col("meta.job_id").alias("job_id"), F.col("meta.host").alias("host"), value.alias("value"))
    found = F.struct("report_id", "job_id", "host", "value")
    # min_by on (-value, id) is the largest value with the lowest id.
    best = rows.where("value is not null").agg(
        F.min_by(found, F.when(F.col("value") > 0, F.struct(-F.col("value"), F.col("report_id")))).alias("largest"),
        F.min_by(found, F.when(F.col("value") != 0, F.struct(F.col("value"), F.col("report_id")))).alias("smallest"))
    return best.select(F.explode(F.array(
        F.struct(F.lit("max").alias("which"), F.col("largest").alias("r")),
        F.struct(F.lit("min").alias("which"), F.col("smallest").alias("r")))).alias("e")) \
        .select("e.which", "e.r.*").where("report_id is not null")


def avg_event_cpu(df: DataFrame) -> DataFrame:
    """Average CPU per event by task and how many jobs had none; jobs without the metric count as ``empty``."""
    rows = df.select("task", job_metric("cpu.AvgEventCPU").alias("cpu"))
    valid = F.when(~F.isnan("cpu"), F.col("cpu"))
    return rows.groupBy(F.when(F.col("cpu").isNull(), "empty").otherwise(F.col("task")).alias("task")).agg(
        F.avg(valid).alias("average"), (F.count("*") - F.count(valid)).alias("failed"))


def tasks_by_job(df: DataFrame) -> DataFrame:
    """Tasks of each job id, with the number of reports.

    One row per job and task: a job id that holds a large part of all reports is
    pre-aggregated and never gathered into one list.
    """
    return (df.select(F.col("meta.job_id").alias("job_id"), "task").where(F.col("job_id").isNotNull())
              .groupBy("job_id", "task").agg(F.count("*").alias("n")))


def day_stats(rollup: DataFrame, date: str, approximate: bool = False) -> DataFrame:
    """One day of a roll-up: rows, distinct workflows, tasks and pairs, events."""
    distinct = (lambda *c: F.approx_count_distinct(F.struct(*c))) if approximate else F.count_distinct
    day = dt.date.fromisoformat(date)
    rows = timeframe(rollup, day, day).where(F.col("start_date") == F.lit(f"{date} 00:00:00").cast("timestamp_ntz"))
    return rows.agg(
        F.count("*").alias("records"), distinct("workflow").alias("workflows"), distinct("task").alias("tasks"),
        distinct("workflow", "task").alias("task_names"),
        F.coalesce(F.sum("events_sum"), F.lit(0)).alias("events"))


def state_totals(rollup: DataFrame) -> DataFrame:
    """Jobs per state, and their total in a row of its own."""
    return (rollup.rollup("jobstate").agg(F.sum("count").alias("count"), F.grouping("jobstate").alias("_total"))
                  .select(F.when(F.col("_total") == 1, "total").otherwise(F.col("jobstate")).alias("jobstate"), "count"))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """Ids that occur more than once."""
    return (df.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("n"))
              .where((F.col("n") > 1) & F.col("id").isNotNull()))


def table_stats(df: DataFrame, *columns: str) -> DataFrame:
    """Documents, their total and mean size in bytes of JSON (or of one text column)."""
    text = F.col(columns[0]) if columns else F.to_json(F.struct(*[F.col(c) for c in df.columns]))
    size = F.octet_length(text).cast("bigint")
    return df.agg(F.count("*").alias("documents"), F.sum(size).alias("bytes"),
                  (F.sum(size) / F.count("*")).alias("mean_bytes"))


def merge_catalogues(*sources: DataFrame) -> DataFrame:
    """One text per code from several (code, text) sources; a later source wins."""
    marked = [s.select("code", "text", F.lit(i).alias("_rank")) for i, s in enumerate(sources)]
    union = marked[0]
    for other in marked[1:]:
        union = union.unionByName(other)
    return union.groupBy("code").agg(F.max_by("text", F.struct("_rank", "text")).alias("text"))


def with_exit_text(df: DataFrame, codes: DataFrame) -> DataFrame:
    """Add the description of each exit code; Spark broadcasts the catalogue when it is small."""
    return df.join(codes.select(F.col("code").alias("exitCode"), F.col("text").alias("exit_text")), "exitCode", "left")


def metric_catalogue(spark: SparkSession) -> DataFrame:
    """The fixed metric catalogue as a table."""
    return spark.createDataFrame(METRIC_CATALOGUE, "metric string, title string, description string, unit string")


def with_metric_info(df: DataFrame) -> DataFrame:
    return df.join(metric_catalogue(df.sparkSession), "metric", "left")


def union_reports(*frames: DataFrame) -> DataFrame:
    """All rows of several report sets; a column one of them lacks is null."""
    union = frames[0]
    for other in frames[1:]:
        union = union.unionByName(other, allowMissingColumns=True)
    return union


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column, or of the elements of an array column."""
    if dict(df.dtypes).get(column, "").startswith("array"):
        return df.select(F.explode(column).alias("value")).distinct()
    return df.select(F.col(column).alias("value")).distinct()


def compare(source: DataFrame, copy: DataFrame, ignore: list[str] | None = None) -> DataFrame:
    """Rows one side has more often, with the side's name and how many more (``n``).

    Envelope columns can be ignored.  One aggregation of the difference in
    number: equal rows are counted before the shuffle and never written out as
    often as they occur.
    """
    names = [c for c in source.columns if c not in (ignore or [])]
    both = (source.select(*names, F.lit(1).alias("_sign"))
            .unionByName(copy.select(*names, F.lit(-1).alias("_sign"))))
    surplus = both.groupBy(*names).agg(F.sum("_sign").alias("_surplus")).where("_surplus <> 0")
    return surplus.select(*names, F.when(F.col("_surplus") > 0, "source").otherwise("copy").alias("side"),
                          F.abs("_surplus").alias("n"))


def same_rows(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row: whether both hold the same rows the same number of times."""
    return compare(first, second).agg((F.count("*") == 0).alias("same"))

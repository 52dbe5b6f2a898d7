"""Roll-ups, their merging and coarsening, and the flagship query."""

from __future__ import annotations

import datetime as dt
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, functions as F

from jobledger.functions.nested import split_task
from jobledger.operators.cube import metric_by
from jobledger.operators.lifecycle import age_rollup, expire_rollup
from jobledger.operators.maintain import SKETCHED, aggregate_range, day_sketches, range_stats
from jobledger.operators.ranking import top_labels
from jobledger.operators.rollup import coarsen, merge_rollups, rollup, with_hash
from jobledger.plans.oracle import KEYS, sums
from jobledger.plans.registry import query
from jobledger.schema import ROLLUP_KEYS, SCOPE_KEYS, TREE_METRICS
from jobledger.session import materialise, new_dir
from jobledger.sources.archive import LAYOUT, archive
from jobledger.sources.reports import prune
from jobledger.sources.sinks import write


# Metrics whose sums over steps the check spells out.
SUMMED = ["cpu.TotalJobTime", "storage.readTotalMB", "memory.PeakValueRss"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = rollup(archive(spark, sf_dir), "day", metrics=["cpu.TotalJobTime"])
    by_site = metric_by(daily, "cpu.TotalJobTime", "site").drop("average_unweighted")
    return top_labels(by_site, "average", 5)


def _show(df: DataFrame) -> DataFrame:
    """Dates of a roll-up as text."""
    return df.withColumns({d: F.date_format(d, "yyyy-MM-dd HH:mm:ss") for d in ("start_date", "end_date")})


def _sql(precision: str, metrics: list[str], step: str) -> str:
    return f"""
    SELECT strftime(date_trunc('{precision}', ts), '%Y-%m-%d %H:%M:%S') AS start_date,
      strftime(date_trunc('{precision}', ts) + INTERVAL {step}, '%Y-%m-%d %H:%M:%S') AS end_date,
      '{precision}' AS precision, {KEYS}, count(*) AS count, {sums(metrics)}
    FROM facts GROUP BY ALL"""


query("flagship_top_sites", """
  SELECT label, sum(s) / sum(n) AS average, CAST(sum(n) AS BIGINT) AS count
  FROM (SELECT site AS label, cpu_TotalJobTime_sum AS s, cpu_TotalJobTime_n AS n FROM roll)
  WHERE n > 0 AND s / n >= 0 GROUP BY label ORDER BY average DESC, label NULLS FIRST LIMIT 5""")(flagship)


@query("a07_rollup_hour", _sql("hour", TREE_METRICS, "1 HOUR"))
def rollup_hour(spark, sf):
    return _show(rollup(archive(spark, sf), "hour", metrics=TREE_METRICS))


@query("a07_rollup_day", _sql("day", TREE_METRICS, "1 DAY"))
def rollup_day(spark, sf):
    return _show(rollup(archive(spark, sf), "day"))


@query("a07_rollup_week", _sql("week", TREE_METRICS, "7 DAY"))
def rollup_week(spark, sf):
    return _show(rollup(archive(spark, sf), "week", metrics=TREE_METRICS))


@query("a07_rollup_month", _sql("month", TREE_METRICS, "1 MONTH"))
def rollup_month(spark, sf):
    return _show(rollup(archive(spark, sf), "month", metrics=TREE_METRICS))


@query("a07_rollup_first_exit_summed_perf", f"""
  , firsts AS (SELECT report_id, min_by(struct_pack(c := code, s := name), pos * 10 + epos) AS e FROM errors GROUP BY ALL),
  summed AS (SELECT f.* EXCLUDE (exitCode, exitStep, cpu_TotalJobTime, storage_readTotalMB),
      x.e.c AS exitCode, x.e.s AS exitStep,
      CASE WHEN pk % 50 = 7 THEN NULL WHEN q > 40 THEN coalesce(cpu_TotalJobTime, 0) + 100
           ELSE cpu_TotalJobTime END AS cpu_TotalJobTime,
      CASE WHEN q > 40 THEN storage_readTotalMB + 1 ELSE storage_readTotalMB END AS storage_readTotalMB
    FROM facts f JOIN (SELECT report_id, q FROM reports) USING (report_id)
      LEFT JOIN firsts x USING (report_id))
  SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start_date,
    strftime(date_trunc('day', ts) + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS end_date, 'day' AS precision,
    {KEYS}, count(*) AS count, {sums(SUMMED)} FROM summed GROUP BY ALL""")
def rollup_policies(spark, sf):
    return _show(rollup(archive(spark, sf), "day", exit_policy="first", perf_policy="sum", metrics=SUMMED))


@query("a17_coarsen_hour_to_day", _sql("day", TREE_METRICS, "1 DAY"))
def coarsen_hour_day(spark, sf):
    return _show(coarsen(rollup(archive(spark, sf), "hour", metrics=TREE_METRICS), "hour", "day"))


@query("a17_coarsen_day_to_week", _sql("week", TREE_METRICS, "7 DAY"))
def coarsen_day_week(spark, sf):
    return _show(coarsen(rollup(archive(spark, sf), "day", metrics=TREE_METRICS), "day", "week"))


@query("a17_coarsen_day_to_month", _sql("month", TREE_METRICS, "1 MONTH"))
def coarsen_day_month(spark, sf):
    return _show(coarsen(rollup(archive(spark, sf), "day", metrics=TREE_METRICS), "day", "month"))


@query("a18_scope_hash", """
  SELECT count(*) AS rows, count(*) AS hashes, CAST(sum(count) AS BIGINT) AS jobs, 32 AS hash_length FROM roll""")
def hashes(spark, sf):
    rows = with_hash(rollup(archive(spark, sf), "day", metrics=[]))
    # The hash is a function of the grouping keys: equal counts mean no two scopes share one.
    return rows.agg(F.count("*").alias("rows"), F.count_distinct("hash").alias("hashes"),
                    F.sum("count").alias("jobs"), F.max(F.length("hash")).alias("hash_length"))


@query("a20_merge_rollups", _sql("day", TREE_METRICS, "1 DAY"))
def merged(spark, sf):
    reports = archive(spark, sf)
    good = rollup(reports.where("meta.jobtype = 'Processing'"), "day", metrics=TREE_METRICS)
    rest = rollup(reports.where("meta.jobtype <> 'Processing'"), "day", metrics=TREE_METRICS)
    return _show(merge_rollups(good, rest))


def _maintained(spark, sf):
    """A stored roll-up after three runs: of part of the archive, of all of it, and of a range in which nothing changed."""
    source, target = new_dir(spark, "source"), new_dir(spark, "target")
    reports = archive(spark, sf).drop("day").withColumn("day", F.dayofmonth(F.timestamp_seconds("meta.ts")))
    late = (F.col("meta.jobtype") == "Cleanup") & (F.col("year") == 1997) & F.col("month").isin(3, 4)
    whole = (dt.date(1990, 1, 1), dt.date(2010, 12, 31))
    write(reports.where(~late), source, partition_by=LAYOUT)
    runs = [aggregate_range(spark, source, target, *whole, by=LAYOUT, metrics=[])]
    write(reports.where(late), source, partition_by=LAYOUT)
    # The first of these runs looks at one of the two months that changed only.
    runs.append(aggregate_range(spark, source, target, dt.date(1997, 4, 1), dt.date(1997, 12, 31), by=LAYOUT, metrics=[]))
    runs.append(aggregate_range(spark, source, target, *whole, by=LAYOUT, metrics=[]))
    runs.append(aggregate_range(spark, source, target, *whole, by=LAYOUT, metrics=[]))
    return target, runs


@query("a21_aggregate_range", f"""
  SELECT strftime(start_date, '%Y-%m-%d') AS day, count(*) AS rows, CAST(sum(count) AS BIGINT) AS jobs,
    CAST(sum(events_sum) AS BIGINT) AS events FROM roll GROUP BY ALL""")
def every_day(spark, sf):
    rows = spark.read.parquet(f"{_maintained(spark, sf)[0]}/rows")
    return rows.groupBy(F.date_format("start_date", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("rows"), F.sum("count").alias("jobs"), F.sum("events_sum").alias("events"))


@query("a21_partitions_read", """
  , months AS (SELECT count(DISTINCT (year(ship_day), month(ship_day))) AS n FROM reports),
  late AS (SELECT DISTINCT month(ship_day) AS m FROM reports WHERE jobtype = 'Cleanup' AND year(ship_day) = 1997 AND month(ship_day) IN (3, 4))
  SELECT 1 AS run, (SELECT n FROM months) AS partitions UNION ALL SELECT 2, count_if(m = 4) FROM late
  UNION ALL SELECT 3, count_if(m = 3) FROM late UNION ALL SELECT 4, 0""")
def partitions_read(spark, sf):
    runs = _maintained(spark, sf)[1]
    return spark.createDataFrame([(k + 1, len(units)) for k, units in enumerate(runs)], "run int, partitions long")


@query("a15_range_stats", """
  SELECT count(*) AS records, count(DISTINCT report_id) AS jobs, count(DISTINCT workflow) AS workflows, count(DISTINCT task) AS tasks,
    count(DISTINCT (workflow, task)) AS task_names, true AS within FROM reports
  WHERE ship_day BETWEEN DATE '1996-02-10' AND DATE '1997-09-20'""")
def ranged(spark, sf):
    """Exact counts, and whether the united sketches come within 5 % of each."""
    first, last = dt.date(1996, 2, 10), dt.date(1997, 9, 20)
    about = range_stats(materialise(day_sketches(archive(spark, sf)), "sketches"), first, last)
    task = split_task(F.col("task"))
    rows = prune(archive(spark, sf), (first, last)).select("report_id", task["workflow"].alias("w"), task["task"].alias("t"))
    exact = rows.agg(F.count("*").alias("records"), F.count_distinct("report_id").alias("jobs"), F.count_distinct("w").alias("workflows"),
                     F.count_distinct("t").alias("tasks"), F.count_distinct("w", "t").alias("task_names"))
    near = [F.abs(F.col(f"a.{c}") - F.col(f"e.{c}")) <= 0.05 * F.col(f"e.{c}") for c in SKETCHED]
    both = exact.alias("e").join(about.alias("a"), F.col("a.records") == F.col("e.records"), "left")
    return both.select("e.*", F.coalesce(reduce(and_, near), F.lit(False)).alias("within"))


@query("t05_expire_rollup", """
  SELECT start_date <= TIMESTAMP '1998-05-31' AS dropped, count(*) AS rows, CAST(sum(count) AS BIGINT) AS jobs
  FROM roll GROUP BY ALL""")
def expire(spark, sf):
    rows = rollup(archive(spark, sf), "day", metrics=[])
    cutoff = dt.datetime(1998, 6, 1)
    gone = expire_rollup(rows, cutoff, dry_run=True).withColumn("dropped", F.lit(True))
    kept = expire_rollup(rows, cutoff).withColumn("dropped", F.lit(False))
    return gone.unionByName(kept).groupBy("dropped").agg(F.count("*").alias("rows"), F.sum("count").alias("jobs"))


@query("t05_age_rollup_day_to_week", f"""
  , aged AS (
    SELECT CASE WHEN start_date + INTERVAL 1 DAY <= TIMESTAMP '1998-05-25' THEN 'week' ELSE 'day' END AS precision,
      CASE WHEN start_date + INTERVAL 1 DAY <= TIMESTAMP '1998-05-25' THEN date_trunc('week', start_date)
           ELSE start_date END AS start_date, {KEYS}, count, events_sum FROM roll)
  SELECT precision, strftime(start_date, '%Y-%m-%d') AS start_date, {KEYS}, CAST(sum(count) AS BIGINT) AS count,
    CAST(sum(events_sum) AS BIGINT) AS events_sum FROM aged GROUP BY ALL""")
def aged(spark, sf):
    rows = rollup(archive(spark, sf), "day", metrics=[])
    kept = age_rollup(rows, dt.datetime(1998, 6, 1), "day", "week")
    return kept.select("precision", F.date_format("start_date", "yyyy-MM-dd").alias("start_date"),
                       *SCOPE_KEYS, "count", "events_sum")

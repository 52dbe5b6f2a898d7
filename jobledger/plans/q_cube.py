"""Metric-by-axis queries over the daily roll-up."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from jobledger.operators import cube
from jobledger.operators.stats import with_metric_info
from jobledger.plans.registry import query
from jobledger.sources.archive import daily_rollup

START, END = dt.date(1997, 2, 1), dt.date(1999, 8, 31)
IN_FRAME = "start_date >= TIMESTAMP '1997-02-01' AND end_date <= TIMESTAMP '1999-09-01'"


def daily(spark, sf):
    return daily_rollup(spark, sf)


def _metric_sql(metric: str, label: str, where: str = "true") -> str:
    return f"""
    SELECT {label} AS label, sum(s) / sum(n) AS average, avg(s / n) AS average_unweighted, CAST(sum(n) AS BIGINT) AS count
    FROM (SELECT *, {metric}_sum AS s, {metric}_n AS n FROM roll WHERE {where})
    WHERE n > 0 AND s / n >= 0 GROUP BY ALL"""


ISO = "concat(strftime(start_date, '%Y-%m-%dT%H:%M:%S.000Z'), '/', strftime(end_date, '%Y-%m-%dT%H:%M:%S.000Z'))"


@query("a08_metric_by_site", _metric_sql("cpu_TotalJobTime", "site"))
def by_site(spark, sf):
    return cube.metric_by(daily(spark, sf), "cpu.TotalJobTime", "site")


@query("a08_metric_by_time", _metric_sql("storage_readTotalMB", ISO))
def by_time(spark, sf):
    return cube.metric_by(daily(spark, sf), "storage.readTotalMB", "time")


@query("a08_events_by_workflow", _metric_sql("events", "workflow"))
def events_by_workflow(spark, sf):
    return cube.metric_by(daily(spark, sf), "data.events", "workflow")


@query("p19_sentinels_dropped", _metric_sql("cpu_AvgEventTime", "jobtype"))
def sentinels(spark, sf):
    return cube.metric_by(daily(spark, sf), "cpu.AvgEventTime", "jobtype")


@query("a09_jobstate_by_site", """
  SELECT site AS label, jobstate, CAST(sum(count) AS BIGINT) AS count FROM roll GROUP BY ALL""")
def states(spark, sf):
    return cube.jobstate_by(daily(spark, sf), "site")


@query("a09_jobstate_nested", """
  SELECT label, string_agg(concat(jobstate, '=', n), ',' ORDER BY jobstate) AS jobstates
  FROM (SELECT jobtype AS label, jobstate, CAST(sum(count) AS BIGINT) AS n FROM roll GROUP BY ALL) GROUP BY ALL""")
def states_nested(spark, sf):
    rows = cube.jobstate_by(daily(spark, sf), "jobtype", nested=True)
    return rows.select("label", F.concat_ws(",", F.transform(
        "jobstates", lambda s: F.concat(s["jobstate"], F.lit("="), s["count"]))).alias("jobstates"))


@query("a10_exitcodes_by_code", """
  SELECT exitCode AS label, count(*) AS rows, CAST(sum(count) AS BIGINT) AS jobs FROM roll
  WHERE exitCode IS NOT NULL GROUP BY ALL""")
def exit_codes(spark, sf):
    return cube.exitcodes_by(daily(spark, sf))


@query("a10_exitcodes_by_time", f"""
  SELECT {ISO} AS label, count(*) AS rows, CAST(sum(count) AS BIGINT) AS jobs FROM roll
  WHERE exitCode IS NOT NULL GROUP BY ALL""")
def exit_codes_time(spark, sf):
    return cube.exitcodes_by(daily(spark, sf), "time")


@query("a11_summary", _metric_sql("memory_PeakValueRss", "'_summary'"))
def summary(spark, sf):
    return cube.metric_by(daily(spark, sf), "memory.PeakValueRss")


_F = "'%Y-%m-%dT%H:%M:%S.000Z'"


@query("a12_status", f"""
  SELECT CAST(coalesce(sum(count) FILTER (WHERE ok), 0) AS BIGINT) AS total_matched_jobs,
    strftime(min(start_date) FILTER (WHERE ok), {_F}) AS start_date, strftime(max(end_date) FILTER (WHERE ok), {_F}) AS end_date,
    strftime(min(start_date), {_F}) AS min_date, strftime(max(end_date), {_F}) AS max_date
  FROM (SELECT *, {IN_FRAME} AND regexp_matches(site, 'NATION_1') AND exitCode = '8003' AS ok FROM roll)""")
def status(spark, sf):
    return cube.status(daily(spark, sf), START, END, site="NATION_1", exitCode="8003")


_SUGGEST = """
  , m AS (SELECT *, coalesce(regexp_matches(site, '^T1'), false) AS a, regexp_matches(jobtype, 'Pro') AS b,
            coalesce(exitCode = '8005', false) AS c FROM roll),
  v AS (
    SELECT DISTINCT 'site' AS key, site AS value FROM m WHERE b AND c
    UNION ALL SELECT DISTINCT 'jobtype', jobtype FROM m WHERE a AND c
    UNION ALL SELECT DISTINCT 'exitCode', exitCode FROM m WHERE a AND b
    UNION ALL SELECT DISTINCT 'workflow', workflow FROM m WHERE a AND b AND c
    UNION ALL SELECT DISTINCT 'task', task FROM m WHERE a AND b AND c
    UNION ALL SELECT DISTINCT 'host', host FROM m WHERE a AND b AND c
    UNION ALL SELECT DISTINCT 'jobstate', jobstate FROM m WHERE a AND b AND c
    UNION ALL SELECT DISTINCT 'acquisitionEra', acquisitionEra FROM m WHERE a AND b AND c
    UNION ALL SELECT DISTINCT 'exitStep', exitStep FROM m WHERE a AND b AND c)"""
_SUGGEST_FILTERS = {"site": "^T1", "jobtype": "Pro", "exitCode": "8005"}


@query("a13_suggestions", _SUGGEST + " SELECT key, value FROM v")
def suggest(spark, sf):
    return cube.suggestions(daily(spark, sf), filters=_SUGGEST_FILTERS)


@query("a13_suggestions_first_ten", _SUGGEST + """
  SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY value NULLS FIRST) AS r FROM v) WHERE r <= 10""")
def suggest_ten(spark, sf):
    return cube.suggestions(daily(spark, sf), filters=_SUGGEST_FILTERS, limit=10)


_AXES = ["site", "jobtype", "_summary"]


def _bundle_sql() -> str:
    parts = []
    for axis in _AXES:
        label = "'_summary'" if axis == "_summary" else axis
        for metric, name in (("cpu.TotalJobTime", "cpu_TotalJobTime"), ("storage.readAveragekB", "storage_readAveragekB"),
                             ("data.events", "events")):
            parts.append(f"""SELECT '{metric}' AS metric, '{axis}' AS axis, {label} AS label,
              sum({name}_sum) / sum({name}_n) AS average, CAST(sum({name}_n) AS BIGINT) AS count FROM roll
              WHERE {IN_FRAME} AND {name}_n > 0 AND {name}_sum / {name}_n >= 0 GROUP BY ALL""")
        parts.append(f"""SELECT 'jobstate', '{axis}', {label}, CAST(sum(count) AS DOUBLE), CAST(sum(count) AS BIGINT)
              FROM roll WHERE {IN_FRAME} GROUP BY ALL""")
        parts.append(f"""SELECT 'data.exitcodes', '{axis}', {label}, CAST(count(*) AS DOUBLE), CAST(sum(count) AS BIGINT)
              FROM roll WHERE {IN_FRAME} AND exitCode IS NOT NULL GROUP BY ALL""")
    return " UNION ALL ".join(parts)


@query("a14_performance_bundle", _bundle_sql())
def bundle(spark, sf):
    rows = cube.timeframe(daily(spark, sf), START, END)
    return cube.performance(
        rows, ["cpu.TotalJobTime", "storage.readAveragekB", "data.events", "jobstate", "data.exitcodes"], _AXES)


@query("j08_metric_info", """
  SELECT m.metric, m.title, m.unit, r.average, r.count FROM (
    SELECT 'cpu.TotalJobTime' AS metric, sum(cpu_TotalJobTime_sum) / sum(cpu_TotalJobTime_n) AS average,
      CAST(sum(cpu_TotalJobTime_n) AS BIGINT) AS count FROM roll WHERE cpu_TotalJobTime_n > 0 AND cpu_TotalJobTime_sum >= 0
    UNION ALL SELECT 'storage.readMBSec', sum(storage_readMBSec_sum) / sum(storage_readMBSec_n),
      CAST(sum(storage_readMBSec_n) AS BIGINT) FROM roll WHERE storage_readMBSec_n > 0) r
  JOIN (VALUES ('cpu.TotalJobTime', 'Total Job Time', 's'), ('storage.readMBSec', 'Read Rate', 'MB/ms')) m(metric, title, unit)
    USING (metric)""")
def info(spark, sf):
    metrics = ["cpu.TotalJobTime", "storage.readMBSec"]
    rows = cube.performance(daily(spark, sf), metrics, ["_summary"])
    return with_metric_info(rows).select("metric", "title", "unit", "average", "count")


@query("p16_scope_filter", """
  SELECT host, jobtype, CAST(sum(count) AS BIGINT) AS jobs FROM roll
  WHERE regexp_matches(workflow, '[0-9]7') AND regexp_matches(site, '_1$') AND regexp_matches(jobstate, 'failed') GROUP BY ALL""")
def scope(spark, sf):
    rows = cube.scope_filter(daily(spark, sf), workflow="[0-9]7", site="_1$", jobstate="failed", task=None)
    return rows.groupBy("host", "jobtype").agg(F.sum("count").alias("jobs"))


@query("p17_exit_code_filter", """
  SELECT exitStep, CAST(sum(count) AS BIGINT) AS jobs FROM roll WHERE exitCode = '8004' GROUP BY ALL""")
def exit_code_filter(spark, sf):
    return cube.scope_filter(daily(spark, sf), exitCode=8004).groupBy("exitStep").agg(F.sum("count").alias("jobs"))


@query("p18_timeframe", f"""
  SELECT strftime(start_date, '%Y-%m') AS month, CAST(sum(count) AS BIGINT) AS jobs FROM roll WHERE {IN_FRAME} GROUP BY ALL""")
def frame(spark, sf):
    rows = cube.timeframe(daily(spark, sf), START, END)
    return rows.groupBy(F.date_format("start_date", "yyyy-MM").alias("month")).agg(F.sum("count").alias("jobs"))

"""Top lists, shares and orderings over labelled results."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobledger.operators import cube, ranking
from jobledger.plans.q_cube import daily
from jobledger.plans.registry import query

_BY_WF = "SELECT workflow AS label, CAST(sum(count) AS BIGINT) AS count FROM roll GROUP BY ALL"
_BY_ERA = "SELECT acquisitionEra AS label, CAST(sum(count) AS BIGINT) AS count FROM roll GROUP BY ALL"
_STATES = "SELECT site AS label, jobstate, CAST(sum(count) AS BIGINT) AS count FROM roll GROUP BY ALL"


def _labels(spark, sf, key):
    return daily(spark, sf).groupBy(F.col(key).alias("label")).agg(F.sum("count").alias("count"))


@query("w01_top_labels", f", v AS ({_BY_WF}) SELECT * FROM v ORDER BY count DESC, label LIMIT 5")
def top(spark, sf):
    return ranking.top_labels(_labels(spark, sf, "workflow"))


@query("w01_top_labels_third_page", f", v AS ({_BY_WF}) SELECT * FROM v ORDER BY count DESC, label LIMIT 5 OFFSET 10")
def top_page(spark, sf):
    return ranking.top_labels(_labels(spark, sf, "workflow"), page=2)


@query("w02_all_labels", f", v AS ({_BY_ERA}) SELECT coalesce(label, '') AS label, count FROM v ORDER BY label")
def labels(spark, sf):
    return ranking.all_labels(_labels(spark, sf, "acquisitionEra"))


@query("w03_share", f", v AS ({_BY_WF}) SELECT label, count, count / (SELECT sum(count) FROM v) AS share FROM v")
def shares(spark, sf):
    return ranking.share(_labels(spark, sf, "workflow"))


@query("w04_state_share", f", v AS ({_STATES}) SELECT *, count / sum(count) OVER (PARTITION BY label) AS share FROM v")
def state_shares(spark, sf):
    return ranking.state_share(cube.jobstate_by(daily(spark, sf), "site"))


@query("w05_stack_states", f"""
  , v AS (SELECT exitCode AS label, jobstate, CAST(sum(count) AS BIGINT) AS count FROM roll GROUP BY ALL),
  z AS (SELECT l.label, s.jobstate, coalesce(v.count, 0) AS count FROM (SELECT DISTINCT label FROM v) l
        CROSS JOIN (VALUES ('jobfailed'), ('submitfailed'), ('success')) s(jobstate)
        LEFT JOIN v ON v.label IS NOT DISTINCT FROM l.label AND v.jobstate = s.jobstate)
  SELECT label, jobstate, count, CAST(sum(count) OVER w - count AS BIGINT) AS "start", CAST(sum(count) OVER w AS BIGINT) AS "end"
  FROM z WINDOW w AS (PARTITION BY label ORDER BY jobstate ROWS UNBOUNDED PRECEDING)""")
def stacked(spark, sf):
    return ranking.stack_states(cube.jobstate_by(daily(spark, sf), "exitCode"))


@query("w06_time_series", """
  SELECT strftime(start_date, '%Y-%m-%d') AS day, CAST(sum(count) AS BIGINT) AS jobs FROM roll GROUP BY start_date ORDER BY start_date DESC""")
def series(spark, sf):
    rows = daily(spark, sf).groupBy("start_date").agg(F.sum("count").alias("jobs"))
    return ranking.time_series(rows).select(F.date_format("start_date", "yyyy-MM-dd").alias("day"), "jobs")


@query("w08_relative", f", v AS ({_BY_ERA}) SELECT label, count, count / (SELECT max(count) FROM v) AS relative FROM v")
def relative(spark, sf):
    return ranking.relative(_labels(spark, sf, "acquisitionEra"))

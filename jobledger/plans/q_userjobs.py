"""User jobs over the archive."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from jobledger.functions.nested import job_metric
from jobledger.operators import jobs, lineage
from jobledger.plans.registry import query
from jobledger.session import materialise
from jobledger.sources.archive import archive
from jobledger.sources.tables import table

jobs.register_job("SlowJobsByHost", lambda df: F.col("wall_s") > 400,
                  lambda df: df.groupBy("meta.host").agg(F.count("*").alias("n"), F.max("wall_s").alias("longest")))
jobs.register_job("FailureCounter", lambda df: F.col("meta.jobstate") != "success")


@query("x01_user_job", "SELECT host, count(*) AS n, max(wall_s) AS longest FROM reports WHERE wall_s > 400 GROUP BY ALL")
def user_job(spark, sf):
    return jobs.run_job(archive(spark, sf), "SlowJobsByHost")


@query("x01_counter_job", "SELECT count(*) AS n FROM reports WHERE failed")
def counter_job(spark, sf):
    return jobs.run_job(archive(spark, sf), "FailureCounter")


def _digits(frame: pd.DataFrame) -> pd.Series:
    return frame["task"].str.count("[0-9]") % 2 == 1


@query("x01_python_predicate", """
  SELECT report_id, path AS task FROM reports WHERE length(regexp_replace(path, '[^0-9]', '', 'g')) % 2 = 1""")
def python_predicate(spark, sf):
    return jobs.filter_rows(archive(spark, sf).select("report_id", "task"), _digits)


@query("x02_iterate", """
  , RECURSIVE_STEP AS (SELECT o_orderkey AS k FROM orders)
  SELECT k AS "start", k // 32 AS value, 5 AS passes FROM RECURSIVE_STEP""")
def iterate(spark, sf):
    """Halve all order keys five times, as a job that hands its result back to itself."""
    state = {"rows": table(spark, sf, "orders").select(F.col("o_orderkey").alias("start"), F.col("o_orderkey").alias("value"))}

    def halve(rows, number):
        state["rows"] = materialise(rows.withColumn("value", F.floor(F.col("value") / 2)), "iterate")
        return state["rows"]

    passes = lineage.run_until(halve, state["rows"], max_iter=5)
    return state["rows"].withColumn("passes", F.lit(passes))


def _emit_cpu(frame: pd.DataFrame) -> pd.DataFrame:
    cpu = frame["cpu"]
    usable = cpu.notna()
    return pd.DataFrame({"key": frame["task"].where(frame["reported"]), "total": cpu.fillna(0.0),
                         "valid": usable.astype("int64"), "seen": 1})


def _merge_cpu(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.groupby("key", as_index=False, dropna=False)[["total", "valid", "seen"]].sum()


@query("x03_emit_reduce", """
  , v AS (SELECT path, CASE WHEN pk % 50 = 7 THEN NULL WHEN sk % 19 = 0 THEN 'NaN'::DOUBLE WHEN sk % 23 = 0 THEN -2
            WHEN sk % 29 = 0 THEN NULL ELSE q * 3 + disc END AS cpu FROM reports)
  SELECT CASE WHEN cpu IS NOT NULL THEN path END AS key, coalesce(sum(cpu) FILTER (WHERE NOT isnan(cpu)), 0) AS total,
    count(cpu) FILTER (WHERE NOT isnan(cpu)) AS valid, count(*) AS seen FROM v GROUP BY ALL""")
def emit_reduce(spark, sf):
    cpu = job_metric("cpu.AvgEventCPU")
    rows = archive(spark, sf).select("task", cpu.alias("cpu"), cpu.isNotNull().alias("reported"))
    return jobs.emit_reduce(rows, _emit_cpu, _merge_cpu, "key string, total double, valid bigint, seen bigint")


@query("x04_default_job", "SELECT count(*) AS n FROM reports")
def default_job(spark, sf):
    return jobs.run_job(archive(spark, sf))

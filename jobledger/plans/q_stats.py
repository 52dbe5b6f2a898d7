"""Statistics, catalogues, set operations and user-visible comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobledger.operators import stats
from jobledger.operators.hashtree import build_and_compare
from jobledger.plans.q_cube import daily
from jobledger.plans.registry import query
from jobledger.schema import STORAGE_ATTRIBUTES
from jobledger.session import new_dir
from jobledger.sources.archive import LAYOUT, archive
from jobledger.sources.reports import read_reports
from jobledger.sources.sinks import new_rows, write
from jobledger.sources.tables import table

SITES = ["T1_NATION_0", "T2_NATION_4"]
_AT = """SELECT * FROM facts WHERE jobstate = 'success' AND report_id IN (
  SELECT report_id FROM steps WHERE site IN ('T1_NATION_0', 'T2_NATION_4') AND name LIKE 'cmsRun%')"""


@query("a02_daily_counts", """
  SELECT CAST(year(ship_day) AS INTEGER) AS year, CAST(month(ship_day) AS INTEGER) AS month,
    CAST(day(ship_day) AS INTEGER) AS day, count(*) AS n FROM reports
  WHERE year(ship_day) = 1998 AND month(ship_day) IN (3, 4, 5) GROUP BY ALL""")
def daily_counts(spark, sf):
    return stats.daily_counts(archive(spark, sf), "fwjr", 1998, [3, 4, 5])


@query("a03_storage_stats", f", here AS ({_AT}) " + " UNION ALL ".join(f"""
  SELECT '{a}' AS attribute, count(*) FILTER (WHERE v = 0) AS count0, count(*) FILTER (WHERE v IS NULL) AS count1,
    count(v) AS total, avg(v) AS mean, coalesce(min(nullif(v, 0)), 0) AS min, greatest(max(v), 0) AS max, count(*) AS nrecords
  FROM (SELECT storage_{a} AS v FROM here)""" for a in STORAGE_ATTRIBUTES))
def storage(spark, sf):
    return stats.storage_stats(archive(spark, sf), SITES)


@query("a04_storage_extremes", f"""
  , here AS (SELECT a.report_id, r.job_id, r.host, storage_writeTotalSecs AS value FROM ({_AT}) a JOIN reports r USING (report_id))
  SELECT 'max' AS which, * FROM (SELECT * FROM here WHERE value > 0 ORDER BY value DESC, report_id LIMIT 1)
  UNION ALL SELECT 'min', * FROM (SELECT * FROM here WHERE value <> 0 ORDER BY value, report_id LIMIT 1)""")
def extremes(spark, sf):
    return stats.storage_extremes(archive(spark, sf), SITES)


@query("a05_avg_event_cpu", """
  , v AS (SELECT path, CASE WHEN pk % 50 = 7 THEN NULL WHEN sk % 19 = 0 THEN 'NaN'::DOUBLE WHEN sk % 23 = 0 THEN -2
            WHEN sk % 29 = 0 THEN NULL ELSE q * 3 + disc END AS cpu FROM reports)
  SELECT CASE WHEN cpu IS NULL THEN 'empty' ELSE path END AS task, avg(cpu) FILTER (WHERE NOT isnan(cpu)) AS average,
    count(*) - count(cpu) FILTER (WHERE NOT isnan(cpu)) AS failed FROM v GROUP BY ALL""")
def event_cpu(spark, sf):
    return stats.avg_event_cpu(archive(spark, sf))


@query("a06_tasks_by_job", "SELECT job_id, path AS task, count(*) AS n FROM reports WHERE job_id IS NOT NULL GROUP BY ALL")
def tasks(spark, sf):
    return stats.tasks_by_job(archive(spark, sf))


@query("a15_day_stats", """
  SELECT count(*) AS records, count(DISTINCT workflow) AS workflows, count(DISTINCT task) AS tasks,
    count(DISTINCT (workflow, task)) AS task_names, CAST(coalesce(sum(events_sum), 0) AS BIGINT) AS events
  FROM roll WHERE start_date = TIMESTAMP '1998-07-04'""")
def day_stats(spark, sf):
    return stats.day_stats(daily(spark, sf), "1998-07-04")


@query("a16_state_totals", """
  SELECT coalesce(jobstate, 'total') AS jobstate, CAST(sum(count) AS BIGINT) AS count FROM roll GROUP BY ROLLUP (jobstate)""")
def totals(spark, sf):
    return stats.state_totals(daily(spark, sf))


@query("a19_duplicate_jobs", "SELECT job_id AS id, count(*) AS n FROM reports WHERE job_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def duplicates(spark, sf):
    return stats.duplicates(archive(spark, sf), "meta.job_id")


@query("a22_document_bytes", """
  SELECT count(*) AS documents, CAST(sum(strlen(text)) AS BIGINT) AS bytes, sum(strlen(text)) / count(*) AS mean_bytes FROM documents""",
       plain=True)
def document_bytes(spark, sf):
    return stats.table_stats(table(spark, sf, "documents"), "text")


@query("a22_archive_bytes")
def archive_bytes(spark, sf):
    return stats.table_stats(archive(spark, sf))


def exit_catalogue(spark, sf):
    """Descriptions of exit codes from three sources; the last source wins."""
    parts = table(spark, sf, "part")
    code = (8000 + F.col("p_partkey") % 12).cast("string")
    first = parts.groupBy(code.alias("code")).agg(F.min("p_name").alias("text"))
    second = parts.where("p_size > 25").groupBy(code.alias("code")).agg(F.max("p_brand").alias("text")).where("code > '8006'")
    third = table(spark, sf, "region").select(
        (8000 + F.col("r_regionkey") * 3).cast("string").alias("code"), F.col("r_name").alias("text"))
    return stats.merge_catalogues(first, second, third)


_CODES = """
  , codes AS (SELECT coalesce(a.code, b.code, c.code) AS code, coalesce(c.text, b.text, a.text) AS text
    FROM (SELECT CAST(8000 + p_partkey % 12 AS VARCHAR) AS code, min(p_name) AS text FROM part GROUP BY ALL) a
    FULL JOIN (SELECT * FROM (SELECT CAST(8000 + p_partkey % 12 AS VARCHAR) AS code, max(p_brand) AS text FROM part WHERE p_size > 25
                GROUP BY ALL) WHERE code > '8006') b ON a.code = b.code
    FULL JOIN (SELECT CAST(8000 + r_regionkey * 3 AS VARCHAR) AS code, r_name AS text FROM region) c ON coalesce(a.code, b.code) = c.code)"""


@query("j07_exit_text", _CODES + """
  SELECT label AS "exitCode", jobs, text AS exit_text FROM (
    SELECT exitCode AS label, CAST(sum(count) AS BIGINT) AS jobs FROM roll WHERE exitCode IS NOT NULL GROUP BY ALL)
  LEFT JOIN codes ON code = label""")
def exit_text(spark, sf):
    rows = daily(spark, sf).where("exitCode is not null").groupBy("exitCode").agg(F.sum("count").alias("jobs"))
    return stats.with_exit_text(rows, exit_catalogue(spark, sf))


@query("d09_exit_catalogue", _CODES + " SELECT code, text FROM codes")
def codes(spark, sf):
    return exit_catalogue(spark, sf)


@query("u01_union", "SELECT jobtype, host, count(*) AS n FROM reports GROUP BY ALL")
def union(spark, sf):
    rows = archive(spark, sf)
    slim = rows.where("meta.jobstate <> 'success'").drop("lfns", "campaign")
    both = stats.union_reports(rows.where("meta.jobstate = 'success'"), slim)
    return both.groupBy("meta.jobtype", "meta.host").agg(F.count("*").alias("n"))


@query("u02_distinct_files", "SELECT DISTINCT file AS value FROM lfns")
def distinct_files(spark, sf):
    return stats.distinct_values(archive(spark, sf), "lfns")


@query("u02_distinct_tasks", "SELECT DISTINCT path AS value FROM reports")
def distinct_tasks(spark, sf):
    return stats.distinct_values(archive(spark, sf), "task")


@query("u03_new_ids", "SELECT report_id FROM reports WHERE NOT (host = 'host1' OR failed)")
def new_ids(spark, sf):
    rows = archive(spark, sf).select("report_id", "meta.host", "meta.jobstate")
    stored = rows.where("host = 'host1' or jobstate <> 'success'")
    return new_rows(rows, stored, "report_id").select("report_id")


@query("u04_same_rows", """
  SELECT (SELECT count(*) FROM (FROM lineitem EXCEPT ALL FROM lineitem)) = 0 AS same,
    (SELECT count(*) FROM lineitem WHERE l_linenumber = 7) = 0 AS changed""", plain=True)
def same(spark, sf):
    lines = table(spark, sf, "lineitem")
    again = lines.repartition(4)
    changed = lines.withColumn("l_tax", F.when(F.col("l_linenumber") == 7, F.lit(0.5)).otherwise(F.col("l_tax")))
    return stats.same_rows(lines, again).withColumn("changed", stats.same_rows(lines, changed).scalar())


@query("j09_compare", """
  SELECT side, count(*) AS n FROM (
    SELECT 'source' AS side FROM orders WHERE o_orderstatus = 'P'
    UNION ALL SELECT 'copy' FROM orders WHERE o_orderstatus = 'P') GROUP BY ALL""", plain=True)
def compared(spark, sf):
    orders = table(spark, sf, "orders")
    copy = orders.withColumn("o_orderstatus", F.regexp_replace("o_orderstatus", "P", "Q")) \
                 .withColumn("o_totalprice", F.col("o_totalprice") + 1)
    return stats.compare(orders, copy, ignore=["o_totalprice"]).groupBy("side").agg(F.sum("n").alias("n"))


# Distinct reports: the copy has other wall times for one host in May 1997, lacks clean-up jobs of June 1996 and one host's of 1998.
_COPY_TESTS = {
    "other": "year(ship_day) = 1997 AND month(ship_day) = 5 AND host = 'host2'",
    "lost": "((year(ship_day) = 1996 AND month(ship_day) = 6 AND jobtype = 'Cleanup') OR (year(ship_day) = 1998 AND host = 'host4' AND month(ship_day) = 2))"}


@query("j09_hash_tree", f"""
  SELECT report_id, 'both' AS side, 'meta wall_s' AS fields FROM reports WHERE {_COPY_TESTS['other']}
  UNION ALL SELECT report_id, 'source', '' FROM reports WHERE {_COPY_TESTS['lost']}""")
def hash_tree(spark, sf):
    root = new_dir(spark, "copies")
    source = archive(spark, sf)
    month = lambda y, m: (F.col("year") == y) & (F.col("month") == m)
    other = month(1997, 5) & (F.col("meta.host") == "host2")
    lost = (month(1996, 6) & (F.col("meta.jobtype") == "Cleanup")) | (month(1998, 2) & (F.col("meta.host") == "host4"))
    changed = source.where(~lost).withColumn("wall_s", F.when(other, F.col("wall_s") + 1).otherwise(F.col("wall_s"))).withColumn(
        "meta", F.when(other, F.col("meta").withField("agent_ver", F.lit("2"))).otherwise(F.col("meta")))
    write(changed, f"{root}/copy", partition_by=LAYOUT)
    rows = build_and_compare(spark, source, read_reports(spark, f"{root}/copy"), f"{root}/trees", by=LAYOUT)
    return rows.withColumn("fields", F.array_join(F.array_sort("fields"), " "))

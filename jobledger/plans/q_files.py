"""Reading and writing: formats, layouts, tiers, saved results, topics."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window, functions as F

from jobledger.operators.extract import flatten_errors
from jobledger.operators.rollup import rollup, with_hash
from jobledger.operators.search import find
from jobledger.plans.registry import query
from jobledger.session import new_dir
from jobledger.schema import REPORT_DDL
from jobledger.sources import sinks
from jobledger.sources.archive import LAYOUT, archive, full_archive
from jobledger.sources.reports import prune, read_documents, read_reports, resolve_source, tiered_read

BY_TYPE = "SELECT jobtype, count(*) AS n, CAST(sum(wall_s) AS BIGINT) AS wall FROM reports GROUP BY ALL"
TODAY = dt.date(1998, 7, 1)
RANGE = (dt.date(1998, 5, 10), dt.date(1998, 6, 20))


def by_type(df):
    return df.groupBy("meta.jobtype").agg(F.count("*").alias("n"), F.sum("wall_s").alias("wall"))


def envelope(spark, sf):
    """Whole reports."""
    return archive(spark, sf)


def _flat(row: str) -> str:
    return f"SELECT {row} AS jobtype, count(*) AS n, CAST(sum(wall_s) AS BIGINT) AS wall FROM reports GROUP BY ALL"


@query("s01_read_parquet", BY_TYPE)
def parquet(spark, sf):
    return by_type(archive(spark, sf))


@query("s01_read_orc", BY_TYPE)
def orc(spark, sf):
    path = new_dir(spark, "orc")
    sinks.write(archive(spark, sf), path, fmt="orc", compression="snappy")
    return by_type(read_reports(spark, path, fmt="orc"))


@query("s02_read_many_folders", BY_TYPE + """
  UNION ALL SELECT 'Merge', count(*), count(*) * 600 FROM orders
  UNION ALL SELECT 'MergeSuper', count(*), count(*) * 600 FROM orders WHERE o_orderkey % 4 = 0
  UNION ALL SELECT 'LogCollect', count(*), count(*) * 600 FROM orders""")
def many(spark, sf):
    return by_type(full_archive(spark, sf))


@query("s03_prune_dates", """
  SELECT CAST(month(ship_day) AS INTEGER) AS month, count(*) AS n FROM reports
  WHERE ship_day BETWEEN DATE '1998-05-10' AND DATE '1998-06-20' GROUP BY ALL""")
def pruned(spark, sf):
    return prune(archive(spark, sf), RANGE).groupBy("month").agg(F.count("*").alias("n"))


@query("s03_default_range", "SELECT report_id FROM reports WHERE ship_day BETWEEN DATE '1998-06-30' AND DATE '1998-07-01'")
def default_range(spark, sf):
    return prune(archive(spark, sf), today=TODAY).select("report_id")


@query("k05_s04_daily_layout", """
  SELECT 'all' AS source, count(*) AS n FROM reports
  UNION ALL SELECT 'day', count(*) FROM reports WHERE ship_day = DATE '2000-03-14'
  UNION ALL SELECT 'ago', count(*) FROM reports WHERE ship_day = DATE '1998-06-28'""")
def daily_layout(spark, sf):
    root = new_dir(spark, "daily")
    sinks.write_daily(archive(spark, sf), root)
    sources = {"all": "all", "day": "20000314", "ago": "3d"}
    parts = [resolve_source(spark, root, s, TODAY).agg(F.count("*").alias("n")).withColumn("source", F.lit(name))
             for name, s in sources.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("k05_copy_check", """
  SELECT CAST(year(ship_day) AS INTEGER) AS year, count(*) AS source_rows, count(*) FILTER (WHERE year(ship_day) <> 1999) AS copy_rows,
    year(ship_day) <> 1999 AS same FROM reports GROUP BY ALL""")
def copy_check(spark, sf):
    source, path = envelope(spark, sf), new_dir(spark, "copy")
    sinks.write_daily(source.where("year <> 1999"), path, by=LAYOUT)
    rows = sinks.check_copy(source, spark.read.parquet(path))
    return rows.groupBy("year").agg(F.sum("source_rows").alias("source_rows"), F.sum("copy_rows").alias("copy_rows"),
                                    F.bool_and("same").alias("same"))


@query("s06_k08_json_gz", BY_TYPE)
def json_gz(spark, sf):
    path = new_dir(spark, "json")
    sinks.write(archive(spark, sf), path, fmt="json", compression="gzip")
    return by_type(read_reports(spark, path, fmt="json"))


_DOCUMENTS = """
  SELECT * FROM (SELECT jobtype, count(*) AS n, CAST(sum(wall_s) AS BIGINT) AS wall FROM reports GROUP BY ALL)
    JOIN (SELECT jobtype, CAST(sum(CAST(code AS BIGINT)) AS BIGINT) AS codes FROM errors GROUP BY ALL) USING (jobtype)
    JOIN (SELECT jobtype, count(site) AS sites, CAST(sum(CASE WHEN name = 'cmsRun1' THEN cents // 2 END) AS BIGINT) AS cpu
          FROM steps GROUP BY ALL) USING (jobtype)"""


def _archived(spark, sf, steps):
    """Reports written as the archive writes them, read back."""
    path = new_dir(spark, "documents")
    step = lambda s: s.withField("site", F.coalesce(s["site"], F.lit("{}"))).withField(
        "errors", F.transform(s["errors"], lambda e: e.withField("exitCode", e["exitCode"].cast("int"))))
    meta = [F.col(f"meta.{n}").alias("fwjr_id" if n == "job_id" else n) for n in (
        "agent_ver", "job_id", "crab_id", "host", "wn_name", "jobtype", "jobstate", "ts")]
    shaped = archive(spark, sf).select(
        F.col("report_id").alias("wmaid"), F.col("ingest_ts").alias("wmats"), "task", F.col("campaign").alias("Campaign"),
        F.struct(*meta).alias("meta_data"), F.col("lfns").alias("LFNArray"),
        F.struct(F.col("wall_s").alias("WMTotalWallClockTime")).alias("WMTiming"), steps(F.transform("steps", step)).alias("steps"))
    shaped.select(F.to_json(F.struct("*"))).write.option("compression", "gzip").text(path)
    rows = read_documents(spark, path)
    codes = F.flatten(F.transform("steps", lambda s: F.transform(s["errors"], lambda e: e["exitCode"].try_cast("bigint"))))
    total = lambda xs: F.aggregate(F.filter(xs, lambda x: x.isNotNull()), F.lit(0).cast("bigint"), lambda a, x: a + x)
    cpu = F.transform(F.filter("steps", lambda s: s["name"] == "cmsRun1"), lambda s: s["performance"]["cpu"]["TotalJobCPU"].cast("bigint"))
    present = lambda xs, x: F.when(F.size(F.filter(xs, lambda v: v.isNotNull())) > 0, x)
    return rows.groupBy("meta.jobtype").agg(
        F.count("*").alias("n"), F.sum("wall_s").alias("wall"), F.sum(present(codes, total(codes))).alias("codes"),
        F.sum(F.size(F.filter("steps", lambda s: s["site"].isNotNull()))).cast("bigint").alias("sites"), F.sum(total(cpu)).alias("cpu"))


@query("s06_raw_documents", _DOCUMENTS)
def raw_documents(spark, sf):
    return _archived(spark, sf, lambda steps: steps)


@query("s06_legacy_documents", _DOCUMENTS)
def legacy_documents(spark, sf):
    return _archived(spark, sf, lambda steps: F.map_from_entries(F.transform(steps, lambda s: F.struct(s["name"], s))))


@query("w07_first_rows", "SELECT report_id, path AS task FROM reports ORDER BY report_id, task LIMIT 20")
def first_rows(spark, sf):
    return archive(spark, sf).select("report_id", "task").orderBy("report_id", "task").limit(20)


@query("s08_tiered_read", """
  SELECT CASE WHEN ship_day < DATE '1998-06-01' THEN 'cold' ELSE 'hot' END AS stage, count(*) AS n FROM reports
  WHERE ship_day BETWEEN DATE '1998-05-10' AND DATE '1998-06-20' GROUP BY ALL""")
def tiered(spark, sf):
    reports = envelope(spark, sf)
    root = new_dir(spark, "tiers")
    sinks.write_daily(reports, f"{root}/hot", by=LAYOUT)
    old = reports.where("ingest_ts < unix_date(date'1998-06-01') * 86400 + 3600")
    sinks.write_daily(old.withColumn("stage", F.lit("cold")), f"{root}/cold", by=LAYOUT)
    hot, cold = (spark.read.parquet(f"{root}/{tier}") for tier in ("hot", "cold"))
    return tiered_read(hot, cold, RANGE, 30, TODAY).groupBy("stage").agg(F.count("*").alias("n"))


ONCE_BY_TYPE = """SELECT jobtype, count(*) AS n, CAST(sum(wall_s) AS BIGINT) AS wall
  FROM (SELECT DISTINCT report_id, jobtype, wall_s FROM reports) GROUP BY ALL"""


@query("k01_append_new", ONCE_BY_TYPE)
def append_new(spark, sf):
    path = new_dir(spark, "appended")
    rows = envelope(spark, sf)
    sinks.append_new(rows.where("meta.jobstate = 'success'"), path, replayable=True)
    sinks.append_new(rows.unionByName(rows), path, replayable=True)
    sinks.append_new(rows, path, replayable=True)
    return by_type(spark.read.parquet(path))


@query("k03_repartitioned_write", BY_TYPE)
def repartitioned(spark, sf):
    path = new_dir(spark, "parts")
    sinks.write(envelope(spark, sf), path, n=3)
    return by_type(spark.read.parquet(path))


@query("k06_file_rollover", """
  SELECT count(*) AS rows, true AS within_limit FROM reports""")
def rollover(spark, sf):
    path = new_dir(spark, "rolled")
    sinks.write(envelope(spark, sf), path, max_records=5000)
    per_file = spark.read.parquet(path).groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n"))
    return per_file.agg(F.sum("n").alias("rows"), F.bool_and(F.col("n") <= 5000).alias("within_limit"))


@query("k06_target_bytes", """
  SELECT count(*) AS rows, count(DISTINCT year(ship_day)) AS years, true AS within FROM reports""")
def target_bytes(spark, sf):
    """A dozen files' worth over the years: all but the last file of a year within a fifth of the target."""
    plain, path = new_dir(spark, "plain"), new_dir(spark, "sized")
    sinks.write(archive(spark, sf), plain)
    stored = spark.read.parquet(plain)
    total = stored.select("_metadata.file_path", "_metadata.file_size").distinct().agg(F.sum("file_size")).first()[0]
    target = total // 20
    sinks.write_sized(stored, path, target, by=["year"])
    per_file = spark.read.parquet(path).groupBy("year", F.col("_metadata.file_path").alias("f")).agg(
        F.first("_metadata.file_size").alias("size"), F.count("*").alias("n"))
    last = F.row_number().over(Window.partitionBy("year").orderBy("n", "f")) == 1
    near = F.abs(F.col("size") - target) <= 0.2 * target
    return per_file.withColumn("last", last).agg(
        F.sum("n").alias("rows"), F.count_distinct("year").alias("years"), F.bool_and(F.col("last") | near).alias("within"))


@query("k07_upsert_rollup", """
  , months AS (SELECT date_trunc('month', ts) AS start_date, workflow, task, host, site, jobtype, jobstate, acquisitionEra, exitCode, exitStep,
      count(*) AS count FROM facts GROUP BY ALL)
  SELECT strftime(start_date, '%Y') AS year, count(*) AS rows, CAST(sum(count) AS BIGINT) AS jobs FROM months GROUP BY ALL""")
def upsert(spark, sf):
    path = new_dir(spark, "rollup")
    reports = archive(spark, sf)
    # A first run over part of the reports stores counts that the second run replaces.
    sinks.upsert_rollup(with_hash(rollup(reports.where("meta.jobtype <> 'Cleanup' and year < 1998"), "month")), path)
    sinks.upsert_rollup(with_hash(rollup(reports, "month")), path)
    return spark.read.parquet(path).groupBy(F.date_format("start_date", "yyyy").alias("year")).agg(
        F.count("*").alias("rows"), F.sum("count").alias("jobs"))


@query("k09_dump", "SELECT CAST(least(25, count(*)) AS INTEGER) AS n FROM lineitem", plain=True)
def dump(spark, sf):
    path = new_dir(spark, "dump")
    sinks.dump(archive(spark, sf), 25, path)
    return spark.read.schema(REPORT_DDL).json(path).agg(F.count("*").cast("int").alias("n"))


@query("k10_convert", """
  SELECT * FROM (SELECT jobtype, count(*) AS n, CAST(sum(wall_s) AS BIGINT) AS wall FROM reports GROUP BY ALL)
    JOIN (SELECT jobtype, count(*) AS steps, count(site) AS sites, CAST(sum(CASE WHEN name = 'cmsRun1' THEN cents // 2 END) AS BIGINT) AS cpu
          FROM steps GROUP BY ALL) USING (jobtype)""")
def convert(spark, sf):
    """Whole reports from JSON to ORC to Parquet; nested parts are counted in the last."""
    root = new_dir(spark, "convert")
    sinks.write(envelope(spark, sf), f"{root}/json", fmt="json")
    sinks.convert(spark, f"{root}/json", f"{root}/orc", REPORT_DDL, "json", "orc")
    sinks.convert(spark, f"{root}/orc", f"{root}/parquet", None, "orc", "parquet")
    main = F.filter("steps", lambda s: s["name"] == "cmsRun1")
    return spark.read.parquet(f"{root}/parquet").groupBy("meta.jobtype").agg(
        F.count("*").alias("n"), F.sum("wall_s").alias("wall"), F.sum(F.size("steps")).cast("bigint").alias("steps"),
        F.sum(F.size(F.filter("steps", lambda s: s["site"].isNotNull()))).cast("bigint").alias("sites"),
        F.sum(F.get(main, F.lit(0))["performance"]["cpu"]["TotalJobCPU"]).cast("bigint").alias("cpu"))


@query("k11_saved_results", """
  SELECT which, wmaid, task FROM (
    SELECT 'first' AS which, report_id AS wmaid, path AS task FROM reports WHERE jobtype = 'Cleanup' AND host = 'host1'
    UNION ALL SELECT 'second', report_id, path FROM reports WHERE regexp_matches(path, '^task3'))""")
def saved(spark, sf):
    path, fields = new_dir(spark, "results"), ["wmaid", "task"]
    specs = {"first": {"jobtype": "Cleanup", "meta.host": "host1"}, "second": {"task": "task3"}}
    parts = []
    for name, spec in specs.items():
        qid = sinks.query_id(spec, fields)
        sinks.save_result(find(archive(spark, sf), spec, fields), path, qid)
        result = sinks.get_result(spark, path, qid)
        parts.append(result.select(F.lit(name).alias("which"), F.from_json("payload", "wmaid string, task string").alias("p")))
    return parts[0].unionByName(parts[1]).select("which", "p.*")


@query("k11_list_results", "SELECT 2 AS results, 1 AS replaced", plain=True)
def listed(spark, sf):
    path = new_dir(spark, "results")
    for spec in ({"jobtype": "Cleanup"}, {"jobtype": "Harvesting"}, {"jobtype": "Cleanup"}):
        sinks.save_result(find(archive(spark, sf), spec, ["wmaid"]).agg(F.count("*").alias("n")), path, sinks.query_id(spec))
    rows = sinks.get_result(spark, path, sinks.query_id({"jobtype": "Cleanup"}))
    return sinks.list_results(spark, path).agg(F.count("*").cast("int").alias("results")) \
        .withColumn("replaced", rows.agg(F.count("*").cast("int")).scalar())


TOPICS = ["jobs.T1_", "jobs.T2_", "jobs.T3_", "jobs.exitCode", "jobs.all"]
ROUTED = """
  , flat AS (SELECT s.site, CAST(coalesce(e.code, '0') AS INTEGER) AS code FROM steps s
    LEFT JOIN (SELECT report_id, name, code FROM errors WHERE code IS NOT NULL) e USING (report_id, name) WHERE s.site IS NOT NULL)
  SELECT topic, count(*) AS n FROM (
    SELECT 'jobs.T1_' AS topic FROM flat WHERE contains(site, 'T1_') UNION ALL SELECT 'jobs.T2_' FROM flat WHERE contains(site, 'T2_')
    UNION ALL SELECT 'jobs.T3_' FROM flat WHERE contains(site, 'T3_') UNION ALL SELECT 'jobs.exitCode' FROM flat WHERE code > 0
    UNION ALL SELECT 'jobs.all' FROM flat) GROUP BY ALL"""


@query("k12_route", ROUTED)
def route(spark, sf):
    path = new_dir(spark, "topics")
    sinks.write_topics(sinks.route(flatten_errors(archive(spark, sf)), TOPICS, "jobs.all"), path)
    return spark.read.schema("value string, topic string").json(path).groupBy("topic").agg(F.count("*").alias("n"))


@query("k13_publishable", "SELECT report_id, ts + 3600 AS wmats_num FROM reports")
def publishable(spark, sf):
    return sinks.publishable(archive(spark, sf)).select("report_id", "wmats_num")

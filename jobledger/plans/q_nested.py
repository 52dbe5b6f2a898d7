"""Extraction from nested documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobledger.functions import nested
from jobledger.functions.scalar import step_kind, valid_exit_code
from jobledger.operators import extract
from jobledger.plans.registry import query
from jobledger.sources.sinks import route
from jobledger.sources.archive import archive

_NAME = """CASE i WHEN 0 THEN concat('/store/in/', pk, '.root') WHEN 1 THEN concat('/store/unmerged/', ok, '/', ln, '.root')
  WHEN 2 THEN concat('/store/logs/', ok, '/', ln, '.tar.gz') WHEN 3 THEN concat('/store/unmerged/', ok, '/', ln, '_b.root') END"""


@query("n01_dereference", f"""
  SELECT report_id, CAST(row_number() OVER (PARTITION BY report_id ORDER BY pos, opos) - 1 AS INTEGER) AS pos,
    {_NAME.replace('CASE i', 'CASE in_index')} AS input_file, {_NAME.replace('CASE i', 'CASE out_index')} AS output_file
  FROM outputs""")
def deref(spark, sf):
    rows = extract.deref(archive(spark, sf))
    return rows.select("report_id", "pos", F.get("input_files", F.lit(0)).alias("input_file"),
                       F.get("output_files", F.lit(0)).alias("output_file"))


@query("n02_files_of_cmsrun_steps", f"""
  SELECT DISTINCT report_id, {_NAME.replace('CASE i', 'CASE out_index')} AS file FROM outputs
  WHERE name LIKE 'cmsRun%' AND out_index < 4""")
def step_files(spark, sf):
    return extract.files_of_steps(archive(spark, sf), "CMSRUN")


@query("n03_output_files", f"""
  SELECT DISTINCT report_id, {_NAME.replace('CASE i', 'CASE out_index')} AS file FROM outputs WHERE out_index < 4""")
def output_files(spark, sf):
    return extract.files_written(archive(spark, sf))


@query("n04_first_site", "SELECT r.report_id, s.site FROM reports r LEFT JOIN first_site s USING (report_id)")
def first_site(spark, sf):
    return archive(spark, sf).select("report_id", nested.first_site().alias("site"))


@query("n05_first_era", "SELECT r.report_id, o.era FROM reports r LEFT JOIN output_sums o USING (report_id)")
def first_era(spark, sf):
    return archive(spark, sf).select("report_id", nested.first_era().alias("era"))


@query("n06_exit_info", "SELECT r.report_id, e.code, e.step FROM reports r LEFT JOIN exits e USING (report_id)")
def exit_info(spark, sf):
    rows = archive(spark, sf).select("report_id", nested.exit_info().alias("e"))
    return rows.select("report_id", F.col("e.exitCode").alias("code"), F.col("e.exitStep").alias("step"))


@query("n06_exit_info_first", """
  SELECT report_id, e.c AS code, e.s AS step FROM reports LEFT JOIN (
    SELECT report_id, min_by(struct_pack(c := code, s := name), pos * 10 + epos) AS e FROM errors GROUP BY ALL) USING (report_id)""")
def exit_info_first(spark, sf):
    rows = archive(spark, sf).select("report_id", nested.exit_info("first").alias("e"))
    return rows.select("report_id", F.col("e.exitCode").alias("code"), F.col("e.exitStep").alias("step"))


@query("n07_events", "SELECT r.report_id, o.events FROM reports r LEFT JOIN output_sums o USING (report_id)")
def events(spark, sf):
    return archive(spark, sf).select("report_id", nested.total_events().alias("events"))


@query("n08_split_task", "SELECT DISTINCT path, workflow, task FROM reports")
def split_task(spark, sf):
    parts = nested.split_task(F.col("task"))
    return archive(spark, sf).select(F.col("task").alias("path"), parts["workflow"].alias("workflow"),
                                     parts["task"].alias("task")).distinct()


@query("n09_job_performance", """
  SELECT report_id, cpu_TotalJobTime AS job_time, storage_readAveragekB AS read_rate, memory_PeakValueRss AS rss FROM facts""")
def performance(spark, sf):
    return archive(spark, sf).select(
        "report_id", nested.job_metric("cpu.TotalJobTime").alias("job_time"),
        nested.job_metric("storage.readAveragekB").alias("read_rate"),
        nested.job_metric("memory.PeakValueRss").alias("rss"))


@query("n10_summed_performance", """
  SELECT report_id, CASE WHEN r.q > 40 AND r.pk % 50 <> 7 THEN coalesce(f.cpu_TotalJobTime, 0) + 100
    ELSE f.cpu_TotalJobTime END AS job_time FROM facts f JOIN reports r USING (report_id)""")
def summed_performance(spark, sf):
    return archive(spark, sf).select("report_id", nested.job_metric("cpu.TotalJobTime", "sum").alias("job_time"))


@query("n11_failures", """
  SELECT r.report_id, jobtype, workflow, e.code AS exitCode, e.step AS exitStep, s.site
  FROM reports r LEFT JOIN exits e USING (report_id) LEFT JOIN first_site s USING (report_id)
  WHERE jobstate = 'jobfailed' AND report_id IN (SELECT report_id FROM outputs WHERE regexp_matches(dataset, '^/ds1.*RECO'))""")
def failures(spark, sf):
    return extract.failures(archive(spark, sf), {"outputDataset": "/ds1.*RECO"})


# Codes of each step straight from the tables: none is 0.
_FLAT_ERRORS = """
  , flat AS (
    SELECT path AS task, coalesce(campaign, '') AS campaign, '' AS dataset,
      CASE WHEN name = 'stageOut1' AND pk % 11 = 0 THEN NULL WHEN name = 'cmsRun1' AND pk % 22 = 0 THEN NULL ELSE site0 END AS site,
      unnest(CASE WHEN NOT failed THEN [0] WHEN name = 'stageOut1' AND sk % 3 = 0 THEN [99999]
        WHEN name = 'cmsRun1' AND sk % 3 = 0 AND pk % 5 = 0 THEN [8000 + pk % 12, 8501] WHEN name = 'cmsRun1' AND sk % 3 = 1 THEN [99999]
        WHEN name = 'cmsRun1' THEN [8000 + pk % 12] ELSE [0] END) AS code
    FROM reports, (VALUES ('stageOut1'), ('cmsRun1'), ('cmsRun2'), ('logArch1')) s(name)
    WHERE pk % 50 <> 7 AND (name <> 'cmsRun2' OR q > 40))"""


@query("n12_flatten_errors", _FLAT_ERRORS + """
  SELECT task, campaign, site, dataset, CAST(code AS INTEGER) AS "exitCode" FROM flat WHERE site IS NOT NULL""")
def flat_errors(spark, sf):
    return extract.flatten_errors(archive(spark, sf))


def _with_text_codes(df):
    """Reports whose code 8003 is the text None, and 99999 a text that is no number."""
    known = F.create_map(*[F.lit(x) for x in ("8003", "None", "99999", "unknown")])
    errors = lambda s: F.transform(s["errors"], lambda e: e.withField(
        "exitCode", F.coalesce(F.try_element_at(known, e["exitCode"]), e["exitCode"])))
    return df.withColumn("steps", F.transform("steps", lambda s: s.withField("errors", errors(s))))


@query("n12_text_codes", _FLAT_ERRORS + """
  SELECT CAST(CASE WHEN code NOT IN (8003, 99999) THEN code END AS INTEGER) AS "exitCode", count(*) AS n FROM flat WHERE site IS NOT NULL GROUP BY ALL""")
def text_codes(spark, sf):
    return extract.flatten_errors(_with_text_codes(archive(spark, sf))).groupBy("exitCode").agg(F.count("*").alias("n"))


@query("k12_route_text_codes", _FLAT_ERRORS + """
  SELECT 'jobs.exitCode' AS topic, count(*) AS n FROM flat WHERE site IS NOT NULL AND code > 0
  UNION ALL SELECT 'jobs.all', count(*) FROM flat WHERE site IS NOT NULL""")
def route_text_codes(spark, sf):
    rows = route(extract.flatten_errors(_with_text_codes(archive(spark, sf))), ["jobs.exitCode", "jobs.all"], "jobs.all")
    return rows.groupBy("topic").agg(F.count("*").alias("n"))


@query("n13_flatten_outputs", """
  SELECT o.path AS task, coalesce(o.campaign, 'NA') AS campaign, o.site, coalesce(o.dataset, 'NA') AS dataset,
    e.code AS "exitCode"
  FROM outputs o LEFT JOIN (
    SELECT report_id, name, coalesce(max_by(coalesce(code, '-1'), epos), '-1') AS code FROM errors GROUP BY ALL) e USING (report_id, name)
  WHERE o.site IS NOT NULL""")
def flat_outputs(spark, sf):
    return extract.flatten_outputs(archive(spark, sf))


@query("n13_attribute_subset", "SELECT path AS task, prep_id FROM reports")
def subset(spark, sf):
    return extract.flatten_outputs(archive(spark, sf), ["task", "prep_id"])


@query("n14_unpack", """
  SELECT agent_ver, job_id, crab_id, host, wn_name, jobtype, jobstate, ts FROM reports""")
def unpack(spark, sf):
    return extract.unpack(archive(spark, sf), "meta")


@query("n15_step_histogram", """
  SELECT regexp_replace(name, '[0-9]+$', '') AS kind, count(*) AS n,
    count(*) / (SELECT count(*) FROM steps) AS share FROM steps GROUP BY kind""")
def histogram(spark, sf):
    return extract.step_histogram(archive(spark, sf))


@query("f11_f13_functions", """
  SELECT regexp_replace(name, '[0-9]+$', '') AS kind, code IS NOT NULL AND code NOT IN ('None', '99999') AS valid, count(*) AS n
  FROM errors GROUP BY ALL""")
def codes(spark, sf):
    steps = archive(spark, sf).select(F.explode(nested.steps_of("name", "errors")).alias("s"))
    rows = steps.select(step_kind(F.col("s.name")).alias("kind"), F.explode("s.errors.exitCode").alias("code"))
    return rows.groupBy("kind", valid_exit_code(F.col("code")).alias("valid")).agg(F.count("*").alias("n"))

"""Search specs, projections and gates over the archive."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from jobledger.operators import search
from jobledger.plans.registry import query
from jobledger.sources.archive import archive


def _found(spark, sf, spec, fields=("report_id",), **options):
    return search.find(archive(spark, sf), spec, list(fields), **options)


@query("p01_project", "SELECT report_id AS wmaid, path AS task, host AS \"meta_data.host\", agent_ver AS agent, jobtype, jobstate AS \"meta.jobstate\" FROM reports")
def project(spark, sf):
    return search.project(archive(spark, sf), ["wmaid", "task", "meta_data.host", "agent", "jobtype", "meta.jobstate"])


@query("p02_alias_view", """
  SELECT r.report_id, l.lfn, agent_ver AS agent, jobtype, e.error, e.errorcode
  FROM reports r
  JOIN (SELECT report_id, string_agg(file, ' ' ORDER BY i) AS lfn FROM lfns GROUP BY ALL) l USING (report_id)
  LEFT JOIN (SELECT report_id, string_agg(coalesce(code, '-'), ' ' ORDER BY pos, epos) AS errorcode,
      string_agg(CASE WHEN what = 'main' THEN concat('fault in job ', ok, '-', ln) WHEN what = 'second' THEN 'second fault'
                      WHEN what = 'none' THEN 'code missing' ELSE 'no code' END, ' ' ORDER BY pos, epos) AS error
    FROM (SELECT *, CASE WHEN code IS NULL THEN 'none' WHEN code = '8501' THEN 'second' WHEN code = '99999' THEN 'bad'
                         ELSE 'main' END AS what FROM errors) GROUP BY ALL) e USING (report_id)""")
def aliases(spark, sf):
    rows = search.alias_view(archive(spark, sf))
    text = lambda c: F.nullif(F.concat_ws(" ", F.transform(c, lambda x: F.coalesce(x, F.lit("-")))), F.lit(""))
    return rows.withColumns({c: text(c) for c in ("lfn", "error", "errorcode")})


@query("p03_equality", "SELECT report_id FROM reports WHERE wall_s = 110")
def equality(spark, sf):
    return _found(spark, sf, {"wall_s": 110})


@query("p04_anchored_regex", "SELECT report_id, path AS task FROM reports WHERE regexp_matches(path, '^(/wf_1.*/T0|task1)')")
def regex(spark, sf):
    return _found(spark, sf, {"task": "/wf_1.*/T0|task1"}, ["report_id", "task"])


@query("p05_file_pattern", "SELECT DISTINCT report_id FROM lfns WHERE regexp_matches(file, '^/store/unmerged/1[0-9]*/7.root')")
def files(spark, sf):
    return _found(spark, sf, {"lfn": "/store/unmerged/1[0-9]*/7.root"})


@query("p06_output_attribute", "SELECT DISTINCT report_id FROM outputs WHERE module = 'AODoutput' OR module LIKE 'RERUN%'")
def output_attribute(spark, sf):
    return _found(spark, sf, {"MODULE_LABEL": "AOD|RERUN"})


@query("p06_prep_id", "SELECT report_id FROM reports WHERE regexp_matches(prep_id, '^Prep-1')")
def prep_id(spark, sf):
    return _found(spark, sf, {"prep_id": "Prep-1"})


@query("p07_membership", "SELECT report_id, host AS \"meta_data.host\" FROM reports WHERE host IN ('host1', 'host4') AND agent_ver IN ('1.0.1', '1.0.2')")
def membership(spark, sf):
    return _found(spark, sf, {"meta_data.host": ["host1", "host4"], "agent": ["1.0.1", "1.0.2"]}, ["report_id", "meta_data.host"])


@query("p08_all_runs", """
  SELECT report_id FROM reports WHERE pk % 50 <> 7 AND q % 2 = 0 AND 1000 + sk % 50 = 1004""")
def all_runs(spark, sf):
    return _found(spark, sf, {"run": [1004, 1005]})


@query("p09_comparisons", """
  SELECT report_id FROM reports r WHERE pk % 50 <> 7 AND (1000 + sk % 50 + CASE WHEN q % 2 = 0 THEN 1 ELSE 0 END) > 1040
    AND wall_s >= 200 AND wall_s < 400 AND jobtype <> 'Cleanup' AND host IN ('host0', 'host2')""")
def comparisons(spark, sf):
    return _found(spark, sf, {"run": {"$gt": 1040}, "wall_s": {"$gte": 200, "$lt": 400},
                              "jobtype": {"$ne": "Cleanup"}, "meta.host": {"$in": ["host0", "host2"]}})


@query("p10_disjunction", """
  SELECT report_id FROM reports WHERE (wall_s = 110 OR (path LIKE '/wf_2%' AND host = 'host3'))
    AND jobstate = 'success'""")
def disjunction(spark, sf):
    return _found(spark, sf, {"$or": [{"wall_s": 110}, {"task": "/wf_2", "meta.host": "host3"}],
                              "meta.jobstate": "success"})


@query("p10_match_any", "SELECT report_id FROM reports WHERE wall_s = 110 OR host = 'host3'")
def match_any(spark, sf):
    return _found(spark, sf, {"wall_s": 110, "meta.host": "host3"}, match="any")


@query("p11_path_through_arrays", """
  SELECT DISTINCT report_id FROM errors e WHERE code = '8501'
    AND EXISTS (SELECT 1 FROM outputs o WHERE o.report_id = e.report_id AND o.events > 30)""")
def through_arrays(spark, sf):
    return _found(spark, sf, {"errorcode": "8501", "steps.output.events": {"$gt": 30}})


@query("p11_path_through_map", """
  SELECT report_id FROM reports WHERE pk % 50 <> 7 AND sk % 13 <> 0 AND sk % 17 <> 0 AND cents > 9000000""")
def through_map(spark, sf):
    return _found(spark, sf, {"steps.performance.cpu.TotalJobTime": {"$gt": 9000000}})


@query("p12_failed", "SELECT report_id FROM reports WHERE jobstate = 'jobfailed'")
def failed(spark, sf):
    return search.failed(archive(spark, sf)).select("report_id")


@query("p12_succeeded", "SELECT jobtype, count(*) AS n FROM reports WHERE jobstate = 'success' GROUP BY ALL")
def succeeded(spark, sf):
    return search.succeeded(archive(spark, sf)).groupBy(F.col("meta.jobtype").alias("jobtype")).agg(F.count("*").alias("n"))


@query("p13_at_site", """
  SELECT DISTINCT report_id FROM steps WHERE site IN ('T2_NATION_1', 'T1_NATION_3') AND name LIKE 'cmsRun%'""")
def at_site(spark, sf):
    return search.at_site(archive(spark, sf), ["T2_NATION_1", "T1_NATION_3"]).select("report_id")


@query("p14_where_eq", "SELECT report_id FROM reports WHERE jobtype = 'Processing' AND host = 'host2' AND campaign = 'Camp5'")
def where_eq(spark, sf):
    conditions = {"meta.jobtype": "Processing", "meta.host": "host2", "campaign": "Camp5"}
    return search.where_eq(archive(spark, sf), conditions).select("report_id")


@query("p15_classify", """
  SELECT CASE WHEN crab_id IS NOT NULL THEN 'crab' WHEN job_id IS NOT NULL THEN 'fwjr' ELSE 'Unknown' END AS document_class,
    count(*) AS n FROM reports GROUP BY ALL""")
def classes(spark, sf):
    return search.classify(archive(spark, sf)).groupBy("document_class").agg(F.count("*").alias("n"))


@query("p20_find_in_timerange", """
  SELECT report_id AS wmaid, path AS task, job_id AS "meta_data.fwjr_id" FROM reports
  WHERE ship_day BETWEEN DATE '1997-11-15' AND DATE '1998-02-10' AND regexp_matches(path, '^/wf_')
    AND report_id IN (SELECT report_id FROM errors WHERE code = '8003')""")
def find(spark, sf):
    days = [dt.date(1997, 11, 15), dt.date(1998, 2, 10)]
    spec = {"timerange": days, "task": "/wf_", "errorcode": "8003"}
    return _found(spark, sf, spec, ["wmaid", "task", "meta_data.fwjr_id"])


@query("a01_count_all", "SELECT count(*) AS n FROM reports")
def count_all(spark, sf):
    return search.count(archive(spark, sf), {})


@query("a01_count_spec", "SELECT count(*) AS n FROM reports WHERE regexp_matches(path, '^task') AND jobtype = 'Cleanup'")
def count_spec(spark, sf):
    return search.count(archive(spark, sf), {"task": "task", "jobtype": "Cleanup"})

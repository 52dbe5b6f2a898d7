"""The reports of :mod:`jobledger.sources.tables` as flat relations in plain SQL.

Every check query starts from these common table expressions.  They are written
relationally (one row per step, error or output), not as nested documents, so
they test the nested operators independently.
"""

from __future__ import annotations

import re

from jobledger.schema import SCOPE_KEYS, TREE_METRICS, metric_column

# The metrics the documents carry, in terms of the columns of ``reports``.
METRIC_SQL = {
    "cpu.TotalJobTime": "CASE WHEN sk % 13 = 0 THEN NULL WHEN sk % 17 = 0 THEN -1 ELSE cents END",
    "cpu.TotalJobCPU": "cents // 2",
    "cpu.AvgEventTime": "CASE WHEN q > 45 THEN -1 ELSE q * 4 END",
    "storage.writeTotalMB": "q",
    "storage.readTotalMB": "q * tax",
    "storage.readAveragekB": "CASE WHEN pk % 6 = 0 THEN NULL ELSE pk % 1000 END",
    "storage.readMBSec": "disc",
    "storage.readMaxMSec": "sk % 100",
    "storage.readTotalSecs": "cents % 1000",
    "storage.writeTotalSecs": "CASE WHEN pk % 7 = 0 THEN 0 WHEN pk % 13 = 0 THEN NULL ELSE cents % 5000 END",
    "memory.PeakValueRss": "100 + q",
    "memory.peakValueVsize": "200 + q * 2",
}


def _metric(path: str) -> str:
    value = METRIC_SQL.get(path, "NULL")
    return f"CAST(CASE WHEN pk % 50 <> 7 THEN {value} END AS DOUBLE) AS {metric_column(path)}"


_FACT_METRICS = ",\n    ".join(_metric(m) for m in TREE_METRICS)
KEYS = ", ".join(SCOPE_KEYS)


def sums(metrics: list[str]) -> str:
    parts = ["CAST(sum(events) AS BIGINT) AS events_sum", "count(events) AS events_n"]
    for metric in metrics:
        name = metric_column(metric)
        parts += [f"sum({name}) AS {name}_sum", f"count({name}) AS {name}_n"]
    return ", ".join(parts)


PRELUDE = f"""
WITH base AS (
  SELECT l_orderkey AS ok, CAST(l_linenumber AS BIGINT) AS ln, l_partkey AS pk, l_suppkey AS sk,
    CAST(l_quantity AS BIGINT) AS q, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
    CAST(round(l_discount * 100) AS BIGINT) AS disc, CAST(round(l_tax * 100) AS BIGINT) AS tax,
    l_returnflag = 'R' AS failed, l_returnflag AS rf, l_linestatus AS ls, CAST(l_shipdate AS DATE) AS ship_day
  FROM lineitem),
reports AS (
  SELECT b.*,
    md5(concat_ws('|', ok, ln, pk, sk, q, cents, disc, tax, rf, ls, date_diff('day', DATE '1970-01-01', ship_day))) AS report_id,
    date_diff('day', DATE '1970-01-01', ship_day) * 86400 + (pk * 37) % 86400 AS ts,
    CASE WHEN pk % 33 <> 0 THEN concat('T', n_regionkey % 3 + 1, '_', n_name) END AS site0,
    CASE WHEN pk % 20 = 0 THEN concat('task', pk % 40)
         WHEN pk % 20 = 1 THEN concat(date_diff('day', DATE '1970-01-01', ship_day) % 500, ':user', sk % 2, ':crab', pk % 2)
         ELSE concat('/wf_', date_diff('day', DATE '1970-01-01', ship_day) % 500, '/block', ln, '/T', pk % 2) END AS path,
    CASE WHEN pk % 20 = 0 THEN 'workflow-NA' WHEN pk % 20 = 1 THEN concat('user', sk % 2)
         ELSE concat('wf_', date_diff('day', DATE '1970-01-01', ship_day) % 500) END AS workflow,
    CASE WHEN pk % 20 = 0 THEN 'task-NA' WHEN pk % 20 = 1 THEN concat('crab', pk % 2)
         ELSE concat('T', pk % 2) END AS task,
    CASE WHEN sk % 6 <> 0 THEN concat('Camp', sk % 6) END AS campaign,
    concat('Prep-', pk % 25) AS prep_id, concat('1.0.', sk % 4) AS agent_ver,
    CASE WHEN sk % 10 <> 0 THEN concat(ok, '-', ln) END AS job_id,
    CASE WHEN sk % 10 = 0 AND sk % 20 <> 0 THEN concat('c', ok) END AS crab_id,
    concat('host', sk % 5) AS host, concat('wn', ok % 100) AS wn_name, 60 + q * 10 AS wall_s,
    CASE WHEN ln <= 4 THEN 'Processing' WHEN ln = 5 THEN 'Production'
         WHEN ln = 6 THEN 'Harvesting' ELSE 'Cleanup' END AS jobtype,
    CASE WHEN NOT failed THEN 'success' WHEN ls = 'O' THEN 'jobfailed' ELSE 'submitfailed' END AS jobstate
  FROM base b LEFT JOIN nation ON n_nationkey = sk % 5),
lfns AS (
  SELECT report_id, 0 AS i, concat('/store/in/', pk, '.root') AS file FROM reports
  UNION ALL SELECT report_id, 1, concat('/store/unmerged/', ok, '/', ln, '.root') FROM reports
  UNION ALL SELECT report_id, 2, concat('/store/logs/', ok, '/', ln, '.tar.gz') FROM reports
  UNION ALL SELECT report_id, 3, concat('/store/unmerged/', ok, '/', ln, '_b.root') FROM reports),
steps AS (
  SELECT r.*, s.pos, s.name,
    CASE WHEN s.name = 'stageOut1' AND pk % 11 = 0 THEN NULL
         WHEN s.name = 'cmsRun1' AND pk % 22 = 0 THEN NULL ELSE site0 END AS site
  FROM reports r, (VALUES (0, 'stageOut1'), (1, 'cmsRun1'), (2, 'cmsRun2'), (3, 'logArch1')) s(pos, name)
  WHERE pk % 50 <> 7 AND (s.name <> 'cmsRun2' OR q > 40)),
errors AS (
  SELECT s.*, e.epos,
    CASE e.what WHEN 'none' THEN NULL WHEN 'bad' THEN '99999' WHEN 'second' THEN '8501'
         ELSE CAST(8000 + pk % 12 AS VARCHAR) END AS code
  FROM steps s, (VALUES ('stageOut1', 0, 0, 'bad'), ('cmsRun1', 0, 0, 'main'), ('cmsRun1', 0, 1, 'second'),
                        ('cmsRun1', 1, 0, 'bad'), ('cmsRun1', 2, 0, 'none'), ('cmsRun1', 2, 1, 'main'))
       e(step, third, epos, what)
  WHERE failed AND s.name = e.step AND sk % 3 = e.third AND (e.what <> 'second' OR pk % 5 = 0)),
outputs AS (
  SELECT s.*, o.opos, o.what,
    CASE o.what WHEN 'first' THEN CASE WHEN pk % 9 = 0 THEN NULL ELSE q END
                WHEN 'second' THEN CASE WHEN q % 10 = 0 THEN 0 ELSE q + ln END WHEN 'rerun' THEN 7 END AS events,
    CASE o.what WHEN 'first' THEN CASE WHEN pk % 8 = 0 THEN NULL ELSE concat('Era', year(ship_day)) END
                WHEN 'second' THEN concat('EraB', ln) WHEN 'rerun' THEN 'EraR' END AS era,
    CASE o.what WHEN 'first' THEN concat('/ds', pk % 40, '/RECO')
                WHEN 'second' THEN concat('/ds', pk % 40, '/AOD') END AS dataset,
    CASE WHEN o.what IN ('first', 'second') THEN prep_id END AS out_prep,
    CASE o.what WHEN 'first' THEN 'RECOoutput' WHEN 'second' THEN 'AODoutput' WHEN 'rerun' THEN 'RERUN' END AS module,
    CASE o.what WHEN 'first' THEN CASE WHEN pk % 37 = 0 THEN 9 ELSE 1 END WHEN 'log' THEN 2 ELSE 3 END AS out_index,
    CASE o.what WHEN 'log' THEN NULL WHEN 'rerun' THEN 1 ELSE 0 END AS in_index
  FROM steps s, (VALUES ('cmsRun1', 0, 'first'), ('cmsRun1', 1, 'second'), ('cmsRun2', 0, 'rerun'), ('logArch1', 0, 'log'))
       o(step, opos, what)
  WHERE s.name = o.step AND (o.what <> 'second' OR ln >= 4)),
first_site AS (
  SELECT report_id, min_by(site, pos) AS site FROM steps WHERE site IS NOT NULL GROUP BY report_id),
output_sums AS (
  SELECT report_id, min_by(era, pos * 10 + opos) FILTER (WHERE era IS NOT NULL) AS era,
    CAST(nullif(sum(coalesce(events, 0)), 0) AS BIGINT) AS events FROM outputs GROUP BY report_id),
exits AS (
  SELECT report_id, coalesce(valid_code, last_code) AS code,
    CASE WHEN valid_code IS NOT NULL THEN valid_step ELSE last_step END AS step
  FROM (SELECT report_id,
          min_by(code, pos * 10 + epos) FILTER (WHERE code NOT IN ('None', '99999')) AS valid_code,
          min_by(name, pos * 10 + epos) FILTER (WHERE code NOT IN ('None', '99999')) AS valid_step,
          max_by(code, pos * 10 + epos) AS last_code, max_by(name, pos * 10 + epos) AS last_step
        FROM errors GROUP BY report_id)),
facts AS (
  SELECT r.report_id, r.ok, r.pk, r.sk, TIMESTAMP '1970-01-01' + to_seconds(r.ts) AS ts,
    r.workflow, r.task, r.host, s.site, r.jobtype, r.jobstate, o.era AS acquisitionEra,
    e.code AS exitCode, e.step AS exitStep, o.events,
    {_FACT_METRICS}
  FROM reports r LEFT JOIN first_site s USING (report_id) LEFT JOIN output_sums o USING (report_id)
    LEFT JOIN exits e USING (report_id)),
roll AS (
  SELECT date_trunc('day', ts) AS start_date, date_trunc('day', ts) + INTERVAL 1 DAY AS end_date,
    {KEYS}, count(*) AS count, {sums(TREE_METRICS)}
  FROM facts GROUP BY ALL)
"""

_PARTS = re.split(r"(?m)^(?:WITH )?(\w+) AS \($", PRELUDE.strip())[1:]
RELATIONS = {name: body.strip().rstrip(",").removesuffix(")") for name, body in zip(_PARTS[::2], _PARTS[1::2], strict=True)}


def _mentions(text: str) -> set[str]:
    return {name for name in RELATIONS if re.search(rf"\b{name}\b", text)}


def prelude(sql: str) -> str:
    """The relations a check needs, each computed once."""
    needed, fresh = set(), _mentions(sql)
    while fresh:
        needed |= fresh
        fresh = set().union(*[_mentions(RELATIONS[name]) for name in fresh]) - needed
    parts = [f"{name} AS MATERIALIZED ({body})" for name, body in RELATIONS.items() if name in needed]
    return "WITH " + ",\n".join(parts or ["base AS (SELECT 1)"]) + "\n"

"""Job reports derived from the star-schema tables.

Every line item is one job that ran one to four steps; every order is one merge
job and one log-collect job, every fourth order also a second-level merge.  All
of it is row-local: a report is bounded by construction (at most four steps and
nine file names), so building reports needs no grouping and no shuffle however
unevenly the keys are spread.  The same expressions serve batch and streaming.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from jobledger.schema import ERRORS, INPUTS, META, METRICS, OUTPUTS, PERFORMANCE, STEPS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for heavy row-local work when a scan has fewer splits than cores.

    A table of many row groups is left alone, so this never shuffles large data.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def _no(kind: str) -> str:
    return f"cast(array() as {kind})"


# One entry of steps[].output, missing attributes null.
def _output(**known: str) -> str:
    plain = {
        "events": "bigint", "size": "bigint", "acquisitionEra": "string", "outputDataset": "string",
        "inputDataset": "string", "prep_id": "string", "globalTag": "string", "module_label": "string",
        "applicationVersion": "string", "validStatus": "string", "merged": "boolean",
        "inputLFNs": "array<int>", "outputLFNs": "array<int>",
        "runs": "array<struct<runNumber:bigint,lumis:array<bigint>>>",
    }
    parts = [f"'{name}', cast({known.get(name, 'null')} as {kind})" for name, kind in plain.items()]
    return f"named_struct({', '.join(parts)})"


def _step(name: str, site: str, seconds: str, errors: str, inputs: str, outputs: str, performance: str) -> str:
    return (
        f"named_struct('name', '{name}', 'site', {site}, 'status', cast(if(failed, 1, 0) as int), "
        f"'start', ts, 'stop', ts + {seconds}, 'errors', {errors}, 'input', {inputs}, "
        f"'output', {outputs}, 'performance', {performance})"
    )


def _performance(cpu: dict, storage: dict, memory: dict) -> str:
    def metrics(group: dict) -> str:
        pairs = ", ".join(f"'{k}', cast({v} as double)" for k, v in group.items())
        return f"cast(map({pairs}) as {METRICS})"

    return f"named_struct('cpu', {metrics(cpu)}, 'storage', {metrics(storage)}, 'memory', {metrics(memory)})"


_NO_PERFORMANCE = f"cast(null as {PERFORMANCE})"

_CMSRUN_ERRORS = f"""
  case when not failed then {_no(ERRORS)}
       when sk % 3 = 0 and pk % 5 = 0 then array(
            named_struct('exitCode', cast(8000 + pk % 12 as string), 'type', 'FatalError', 'details', concat('fault in job ', job_id)),
            named_struct('exitCode', '8501', 'type', 'FileError', 'details', 'second fault'))
       when sk % 3 = 0 then array(
            named_struct('exitCode', cast(8000 + pk % 12 as string), 'type', 'FatalError', 'details', concat('fault in job ', job_id)))
       when sk % 3 = 1 then array(
            named_struct('exitCode', '99999', 'type', 'Unknown', 'details', 'no code'))
       else array(
            named_struct('exitCode', cast(null as string), 'type', 'NoCode', 'details', 'code missing'),
            named_struct('exitCode', cast(8000 + pk % 12 as string), 'type', 'FatalError', 'details', concat('fault in job ', job_id)))
  end"""

_STAGEOUT_ERRORS = f"""
  if(failed and sk % 3 = 0,
     array(named_struct('exitCode', '99999', 'type', 'StageOutError', 'details', 'no code')),
     {_no(ERRORS)})"""

_RUNS = """
  if(q % 2 = 0,
     array(named_struct('runNumber', 1000 + sk % 50, 'lumis', array(q, q + 1)),
           named_struct('runNumber', 1001 + sk % 50, 'lumis', array(q))),
     array(named_struct('runNumber', 1000 + sk % 50, 'lumis', array(q))))"""

_FIRST_OUTPUT = _output(
    events="if(pk % 9 = 0, null, q)", size="cents * 10",
    acquisitionEra="if(pk % 8 = 0, null, concat('Era', year(ship_day)))",
    outputDataset="concat('/ds', pk % 40, '/RECO')", inputDataset="concat('/in', pk % 10, '/RAW')",
    prep_id="concat('Prep-', pk % 25)", globalTag="concat('GT', sk % 3)", module_label="'RECOoutput'",
    applicationVersion="concat('V', ln)", merged="ln = 1", inputLFNs="array(0)",
    outputLFNs="array(if(pk % 37 = 0, 9, 1))", runs=_RUNS,
)
_SECOND_OUTPUT = _output(
    events="if(q % 10 = 0, 0, q + ln)", size="cents", acquisitionEra="concat('EraB', ln)",
    outputDataset="concat('/ds', pk % 40, '/AOD')", prep_id="concat('Prep-', pk % 25)",
    module_label="'AODoutput'", merged="false", inputLFNs="array(0)", outputLFNs="array(3)",
    runs="array()",
)
_RERUN_OUTPUT = _output(
    events="7", acquisitionEra="'EraR'", module_label="'RERUN'", merged="false",
    inputLFNs="array(1)", outputLFNs="array(3)", runs="array()",
)

_FULL_PERFORMANCE = _performance(
    cpu={
        "TotalJobTime": "case when sk % 13 = 0 then null when sk % 17 = 0 then -1 else cents end",
        "TotalJobCPU": "cents div 2",
        "AvgEventCPU": "case when sk % 19 = 0 then double('NaN') when sk % 23 = 0 then -2 "
                       "when sk % 29 = 0 then null else q * 3 + disc end",
        "AvgEventTime": "if(q > 45, -1, q * 4)",
    },
    storage={
        "readTotalMB": "q * tax", "readMBSec": "disc",
        "readAveragekB": "if(pk % 6 = 0, null, pk % 1000)", "readMaxMSec": "sk % 100",
        "readTotalSecs": "cents % 1000",
        "writeTotalSecs": "case when pk % 7 = 0 then 0 when pk % 13 = 0 then null else cents % 5000 end",
        "writeTotalMB": "q",
    },
    memory={"PeakValueRss": "100 + q", "peakValueVsize": "200 + q * 2"},
)
_RERUN_PERFORMANCE = (
    "named_struct('cpu', map('TotalJobTime', 100D, 'TotalJobCPU', 50D), "
    f"'storage', map('readTotalMB', 1D), 'memory', cast(map() as {METRICS}))"
)

_STAGEOUT = _step("stageOut1", "if(pk % 11 = 0, null, site0)", "60", _STAGEOUT_ERRORS,
                  _no(INPUTS), _no(OUTPUTS), _NO_PERFORMANCE)
_CMSRUN = _step("cmsRun1", "if(pk % 22 = 0, null, site0)", "60 + q * 10", _CMSRUN_ERRORS,
                "array(named_struct('lfn', 0, 'pfn', 0, 'events', q, 'runs', "
                "cast(array() as array<struct<runNumber:bigint,lumis:array<bigint>>>)))",
                f"if(ln >= 4, array({_FIRST_OUTPUT}, {_SECOND_OUTPUT}), array({_FIRST_OUTPUT}))",
                _FULL_PERFORMANCE)
_RERUN = _step("cmsRun2", "site0", "30", _no(ERRORS), _no(INPUTS), f"array({_RERUN_OUTPUT})", _RERUN_PERFORMANCE)
_LOGARCH = _step("logArch1", "site0", "5", _no(ERRORS), _no(INPUTS),
                 f"array({_output(outputLFNs='array(2)')})", _NO_PERFORMANCE)

_STEPS = f"""
  case when pk % 50 = 7 then {_no(STEPS)}
       when q > 40 then array({_STAGEOUT}, {_CMSRUN}, {_RERUN}, {_LOGARCH})
       else array({_STAGEOUT}, {_CMSRUN}, {_LOGARCH})
  end"""


def _with_partitions(df: DataFrame) -> DataFrame:
    day = F.date_from_unix_date((F.col("meta.ts") / 86400).cast("int"))
    return df.withColumns({"year": F.year(day), "month": F.month(day), "day": F.dayofmonth(day)})


def processing_reports(lines: DataFrame, nation: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """One report per line item; ``nation`` names the sites.

    ``order`` sorts the short columns that reports are made of within each task, before documents are built.
    """
    base = lines.selectExpr(
        "l_orderkey ok", "l_linenumber ln", "l_partkey pk", "l_suppkey sk",
        "cast(l_quantity as bigint) q",
        "cast(round(l_extendedprice * 100) as bigint) cents",
        "cast(round(l_discount * 100) as bigint) disc",
        "cast(round(l_tax * 100) as bigint) tax",
        "l_returnflag = 'R' failed", "l_returnflag rf", "l_linestatus ls", "to_date(l_shipdate) ship_day",
    )
    sites = nation.selectExpr(
        "cast(n_nationkey as bigint) site_no",
        "concat('T', n_regionkey % 3 + 1, '_', n_name) site_name",
    )
    named = base.withColumn("site_no", F.expr("sk % 5")).join(sites, "site_no", "left").selectExpr(
        "*",
        "if(pk % 33 = 0, null, site_name) site0",
        "unix_date(ship_day) day_no",
        "unix_date(ship_day) * 86400L + (pk * 37) % 86400 ts",
        "concat(ok, '-', ln) job_id",
    )
    if order:
        named = named.sortWithinPartitions(*order)
    documents = named.selectExpr(
        "md5(concat_ws('|', ok, ln, pk, sk, q, cents, disc, tax, rf, ls, unix_date(ship_day))) report_id",
        "cast(ts + 3600 as double) ingest_ts",
        "'hot' stage",
        "'fwjr' kind",
        "case when pk % 20 = 0 then concat('task', pk % 40) "
        "     when pk % 20 = 1 then concat(day_no % 500, ':user', sk % 2, ':crab', pk % 2) "
        "     else concat('/wf_', day_no % 500, '/block', ln, '/T', pk % 2) end task",
        "if(sk % 6 = 0, null, concat('Camp', sk % 6)) campaign",
        "concat('Prep-', pk % 25) prep_id",
        f"""cast(named_struct(
              'agent_ver', concat('1.0.', sk % 4),
              'job_id', if(sk % 10 = 0, null, job_id),
              'crab_id', if(sk % 10 = 0 and sk % 20 <> 0, concat('c', ok), null),
              'host', concat('host', sk % 5), 'wn_name', concat('wn', ok % 100),
              'jobtype', case when ln <= 4 then 'Processing' when ln = 5 then 'Production'
                              when ln = 6 then 'Harvesting' else 'Cleanup' end,
              'jobstate', case when not failed then 'success' when ls = 'O' then 'jobfailed'
                               else 'submitfailed' end,
              'ts', ts) as {META}) meta""",
        "array(concat('/store/in/', pk, '.root'), concat('/store/unmerged/', ok, '/', ln, '.root'), "
        "      concat('/store/logs/', ok, '/', ln, '.tar.gz'), concat('/store/unmerged/', ok, '/', ln, '_b.root')) lfns",
        "array(concat('root://host', sk % 5, '/store/in/', pk, '.root')) pfns",
        "cast(if(pk % 41 = 0, array(0), array()) as array<int>) skipped",
        "cast(array() as array<int>) fallback",
        "60 + q * 10 wall_s",
        f"{_STEPS} steps",
    )
    return _with_partitions(documents)


def _file_list(pattern: str, first: str, last: str) -> str:
    return f"transform(sequence({first}, {last}), i -> concat({pattern}))"


def _order_document(orders: DataFrame, jobtype: str, lfns: str, inputs: str, output: str,
                    step: str, log: str | None) -> DataFrame:
    """One report per order that reads ``inputs`` and writes ``output`` (indexes into ``lfns``)."""
    head = orders.selectExpr(
        "o_orderkey k", "false failed", "concat('host', o_custkey % 5) host",
        "unix_date(to_date(o_orderdate)) * 86400L + o_custkey % 86400 ts",
        "concat('T1_HUB', o_custkey % 3) site0",
    )
    steps = [_step(step, "site0", "600", _no(ERRORS), _no(INPUTS),
                   f"array({_output(inputLFNs=inputs, outputLFNs=f'array({output})', merged='true')})",
                   _NO_PERFORMANCE)]
    if log:
        steps.append(_step("logArch1", "site0", "5", _no(ERRORS), _no(INPUTS),
                           f"array({_output(outputLFNs=f'array({log})')})", _NO_PERFORMANCE))
    documents = head.selectExpr(
        f"md5(concat_ws('|', '{jobtype}', '{step}', k, {len(steps)}, '{output}')) report_id",
        "cast(ts + 3600 as double) ingest_ts", "'hot' stage", "'fwjr' kind",
        f"concat('/wf_', k % 500, '/{jobtype}') task", "cast(null as string) campaign",
        "cast(null as string) prep_id",
        f"""cast(named_struct('agent_ver', '1.0.0', 'job_id', concat('{jobtype}', k), 'crab_id', null,
              'host', host, 'wn_name', null, 'jobtype', '{jobtype}', 'jobstate', 'success', 'ts', ts)
            as {META}) meta""",
        f"{lfns} lfns", "cast(array() as array<string>) pfns", "cast(array() as array<int>) skipped",
        "cast(array() as array<int>) fallback", "cast(600 as bigint) wall_s",
        f"array({', '.join(steps)}) steps",
    )
    return _with_partitions(documents)


def merge_reports(orders: DataFrame) -> DataFrame:
    """Merge jobs: line-item outputs into one file per order, then four orders into one."""
    first = _order_document(
        orders, "Merge",
        "concat(" + _file_list("'/store/unmerged/', k, '/', i, '.root'", "1", "7")
        + ", array(concat('/store/merged/', k, '.root'), concat('/store/logs/merge/', k, '.tar.gz')))",
        "sequence(0, 6)", "7", "cmsRun1", "8")
    second = _order_document(
        orders.where("o_orderkey % 4 = 0"), "MergeSuper",
        "concat(" + _file_list("'/store/merged/', k + i, '.root'", "0", "3")
        + ", array(concat('/store/super/', k, '.root')))",
        "sequence(0, 3)", "4", "cmsRun1", None)
    return first.unionByName(second)


def log_collect_reports(orders: DataFrame) -> DataFrame:
    """LogCollect jobs: the log archives of one order into one tar file."""
    return _order_document(
        orders, "LogCollect",
        "concat(" + _file_list("'/store/logs/', k, '/', i, '.tar.gz'", "1", "7")
        + ", array(concat('/store/logs/merge/', k, '.tar.gz'), concat('/srm/collected/', k, '.tar')))",
        "sequence(0, 7)", "8", "logCollect1", None)


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processing reports of all line items."""
    return processing_reports(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "nation"))


def all_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processing, merge and log-collect reports: the whole file lineage."""
    orders = table(spark, sf_dir, "orders")
    return (reports(spark, sf_dir)
            .unionByName(merge_reports(orders))
            .unionByName(log_collect_reports(orders)))


def raw_documents(lines: DataFrame) -> DataFrame:
    """Reports as JSON text, some of them malformed, for validation and ingest.

    Faults: a text time stamp, a missing job type, a number inside a text list,
    a site that is an object, text events inside an output record.
    """
    return lines.selectExpr(
        "l_orderkey ok", "l_linenumber ln", "l_partkey pk", "l_suppkey sk",
        "cast(l_quantity as bigint) q", "cast(round(l_extendedprice * 100) as bigint) cents",
        "cast(round(l_discount * 100) as bigint) disc", "cast(round(l_tax * 100) as bigint) tax",
        "l_returnflag rf", "l_linestatus ls", "to_date(l_shipdate) ship_day",
    ).selectExpr(
        "concat_ws('-', ok, ln, pk, sk, q, cents, disc, tax, rf, ls, unix_date(ship_day)) doc_key",
        """concat(
          '{"task": "/wf_', ok % 500, '/T', pk % 4, '", "wall": ', if(pk % 12 = 0, concat(cents % 1000, '.5'), string(q)),
          ', "ok": ', if(sk % 2 = 0, 'true', 'false'),
          ', "meta": {"ts": ', if(pk % 31 = 0, '"soon"', string(cents)),
          if(pk % 17 = 0, '', concat(', "jobtype": "', if(ln = 4, 'Merge', 'Processing'), '"')),
          ', "note": ', if(sk % 7 = 0, 'null', '"n"'), '}',
          ', "files": [', if(pk % 23 = 0, '"a", 5', if(pk % 29 = 0, '', '"a", "b"')), ']',
          ', "steps": [{"name": "cmsRun1", "site": ', if(sk % 14 = 0, '{}', '"T1"'), ', "events": ', if(pk % 19 = 0, '"many"', string(q)),
          '}, {"name": "logArch1", "site": "T2", "events": null}]}') doc""",
    )

"""Shapes and fixed names of the report model."""

from __future__ import annotations

RUNS = "array<struct<runNumber:bigint,lumis:array<bigint>>>"
ERRORS = "array<struct<exitCode:string,type:string,details:string>>"
INPUTS = f"array<struct<lfn:int,pfn:int,events:bigint,runs:{RUNS}>>"
OUTPUTS = (
    "array<struct<events:bigint,size:bigint,acquisitionEra:string,outputDataset:string,"
    "inputDataset:string,prep_id:string,globalTag:string,module_label:string,"
    "applicationVersion:string,validStatus:string,merged:boolean,"
    f"inputLFNs:array<int>,outputLFNs:array<int>,runs:{RUNS}>>"
)
METRICS = "map<string,double>"
PERFORMANCE = f"struct<cpu:{METRICS},storage:{METRICS},memory:{METRICS}>"
STEPS = (
    "array<struct<name:string,site:string,status:int,start:bigint,stop:bigint,"
    f"errors:{ERRORS},input:{INPUTS},output:{OUTPUTS},performance:{PERFORMANCE}>>"
)
META = (
    "struct<agent_ver:string,job_id:string,crab_id:string,host:string,wn_name:string,"
    "jobtype:string,jobstate:string,ts:bigint>"
)
REPORT_COLUMNS = {
    "report_id": "string",
    "ingest_ts": "double",
    "stage": "string",
    "kind": "string",
    "task": "string",
    "campaign": "string",
    "prep_id": "string",
    "meta": META,
    "lfns": "array<string>",
    "pfns": "array<string>",
    "skipped": "array<int>",
    "fallback": "array<int>",
    "wall_s": "bigint",
    "steps": STEPS,
}
PARTITION_COLUMNS = ["year", "month", "day"]
REPORT_DDL = ", ".join(f"{n} {t}" for n, t in REPORT_COLUMNS.items()) + ", year int, month int, day int"

# A document as the archive holds it: its own names, and steps as text because their shape varies.
DOCUMENT_DDL = (
    "wmaid string, wmats double, stype string, dtype string, task string, Campaign string, PrepID string, "
    "meta_data struct<agent_ver:string,fwjr_id:string,crab_id:string,host:string,wn_name:string,"
    "jobtype:string,jobstate:string,ts:bigint>, LFNArray array<string>, PFNArray array<string>, "
    "skippedFiles array<int>, fallbackFiles array<int>, WMTiming struct<WMTotalWallClockTime:bigint>, steps string"
)

# The scope keys of a roll-up row that users can filter by.
SCOPE_KEYS = [
    "workflow", "task", "host", "site", "jobtype", "jobstate",
    "acquisitionEra", "exitCode", "exitStep",
]
BUCKET_KEYS = ["start_date", "end_date", "precision"]
ROLLUP_KEYS = BUCKET_KEYS + SCOPE_KEYS

# Short search names and the document paths they stand for.
ALIASES = {
    "lfn": "LFNArray",
    "agent": "meta_data.agent_ver",
    "jobtype": "meta_data.jobtype",
    "error": "steps.errors.details",
    "errorcode": "steps.errors.exitCode",
}

# Names used by archived documents, and where this model keeps them.
DOCUMENT_NAMES = {
    "LFNArray": "lfns",
    "PFNArray": "pfns",
    "meta_data": "meta",
    "meta_data.fwjr_id": "meta.job_id",
    "Campaign": "campaign",
    "PrepID": "prep_id",
    "skippedFiles": "skipped",
    "fallbackFiles": "fallback",
    "wmaid": "report_id",
    "wmats": "ingest_ts",
    "stype": "stage",
    "dtype": "kind",
}

# The metric catalogue (path, title, description, unit).
METRIC_CATALOGUE = [
    ("jobstate", "Job State", "Number of jobs and their success rate.", ""),
    ("cpu.TotalJobTime", "Total Job Time", "Job wall time.", "s"),
    ("cpu.TotalJobCPU", "Total Job CPU", "", "s"),
    ("cpu.MinEventTime", "Min. Event Time", "Shortest event wall time.", "s"),
    ("cpu.MaxEventTime", "Max. Event Time", "Longest event wall time", "s"),
    ("cpu.AvgEventTime", "Avg. Event Time", "Average event wall time.", "s"),
    ("cpu.EventThroughput", "Event Throughput", "Number of events per second.", "/s"),
    ("cpu.TotalLoopCPU", "Total Loop CPU", "", "s"),
    ("storage.writeTotalMB", "Write", "Total storage layer written data.", "MB"),
    ("storage.readTotalMB", "Read", "Total storage layer read data.", "MB"),
    ("storage.readPercentageOps", "Read Percentage ROOT",
     "Percentage of operations by the ROOT layer vs. storage layer.", "%"),
    ("storage.readAveragekB", "Read Rate", "Read rate of storage layer per operation.", "KB"),
    ("storage.readNumOps", "Read Operations", "Storage-based read operations.", ""),
    ("storage.readCachePercentageOps", "Read Cache Operations",
     "Percentage of successful operations by ROOT layer vs. storage layer.", "%"),
    ("storage.readMBSec", "Read Rate", "Read rate.", "MB/ms"),
    ("storage.readMaxMSec", "Max. Read Time", "The longest read time.", "ms"),
    ("storage.readTotalSecs", "ROOT Read Time", "Total time for ROOT-based read.", "s"),
    ("storage.writeTotalSecs", "Write Time", "Total writing time.", "microseconds"),
    ("memory.PeakValueRss", "Peak Value Rss", "", "MB"),
    ("memory.peakValueVsize", "Peak Value Vsize", "", "MB"),
    ("data.events", "Events", "", ""),
    ("data.exitcodes", "ExitCodes", "Total number of exit codes", ""),
]

# Metrics that live in the performance tree, hence are averaged by a roll-up.
TREE_METRICS = [p for p, *_ in METRIC_CATALOGUE if p.split(".")[0] in ("cpu", "storage", "memory")]

# Storage attributes summarised for a site.
STORAGE_ATTRIBUTES = [
    "readTotalMB", "readMBSec", "readAveragekB", "readMaxMSec",
    "readTotalSecs", "writeTotalSecs", "writeTotalMB",
]

# Age at which a roll-up of each precision becomes too fine to keep.
PRECISION_HOURS = {"hour": 48, "day": 7 * 24, "week": 4 * 7 * 24, "month": 24 * 7 * 24}


def metric_column(path: str) -> str:
    """Column stem of a metric in a roll-up, e.g. ``cpu_TotalJobTime``."""
    return path.replace(".", "_")

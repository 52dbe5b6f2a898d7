"""Semantics that need care, on hand-built reports."""

import datetime as dt

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from reports import report, step
from jobledger.functions import nested, scalar
from jobledger.operators import cube, extract, search, stats
from jobledger.operators.rollup import coarsen, merge_rollups, rollup
from jobledger.sources.reports import check_timerange, choose_tier, normalise_steps, prune, tiered_read


def ids(df):
    return sorted(r.report_id for r in df.select("report_id").collect())


@pytest.fixture
def two(make):
    return make(
        report("a", step("cmsRun1", "T1_X", output=[{"events": 5, "prep_id": "P-1", "merged": True,
                                                      "runs": [{"runNumber": 1, "lumis": [1]}, {"runNumber": 2, "lumis": []}]}]),
               task="/abc/1", lfns=["/store/x.root"]),
        report("b", step("logArch1", "T1_X", output=[{"prep_id": "P-1"}]),
               step("CMSRUN1", "T2_Y", output=[{"events": 50, "prep_id": "Q-1", "runs": [{"runNumber": 2, "lumis": []}]}]),
               task="zz/abc/2", lfns=["/other/x.root"], state="jobfailed"))


@pytest.mark.parametrize("spec, wanted", [
    ({}, ["a", "b"]),                                        # an empty spec holds everywhere
    ({"task": "/abc"}, ["a"]),                               # anchored at the start
    ({"task": "/abc|zz"}, ["a", "b"]),                       # the anchor covers alternatives
    ({"lfn": "/store/.*"}, ["a"]),
    ({"PREP_ID": "P-"}, ["a"]),                              # only cmsRun steps, any case
    ({"prep_id": "Q"}, ["b"]),
    ({"merged": True}, ["a"]),
    ({"run": [1, 2]}, ["a"]),                                # all runs must occur
    ({"run": [2]}, ["a", "b"]),
    ({"run": {"$gt": 1}, "task": "zz"}, ["b"]),
    ({"steps.output.events": {"$gte": 50}}, ["b"]),
    ({"$or": [{"task": "zz"}, {"steps.output.events": 5}]}, ["a", "b"]),
    ({"site": ["T2_Y"]}, ["b"]),
    ({"site": "T1_X"}, ["a"]),                               # logArch steps do not count
    ({"jobtype": ["Merge", "Processing"]}, ["a", "b"]),
    ({"campaign": "x"}, []),                                 # null never matches
])
def test_spec(two, spec, wanted):
    assert ids(search.find(two, spec)) == wanted


def test_spec_any_and_errors(two):
    assert ids(search.find(two, {"task": "zz", "lfn": "/store"}, match="any")) == ["a", "b"]
    with pytest.raises(ValueError):
        search.find(two, {"nosuchkey": 1})
    with pytest.raises(ValueError):
        search.find(two, {"task": {"$near": 1}})


def test_exit_info(make):
    df = make(
        report("valid", step("s1", errors=["99999", "None"]), step("s2", errors=["8001", "8002"])),
        report("last", step("s1", errors=["99999"]), step("s2", errors=["None"])),
        report("none", step("s1")), report("nosteps"))
    found = {r.report_id: (r.c, r.s) for r in df.withColumn("e", nested.exit_info()).select(
        "report_id", F.col("e.exitCode").alias("c"), F.col("e.exitStep").alias("s")).collect()}
    assert found == {"valid": ("8001", "s2"), "last": ("None", "s2"), "none": (None, None), "nosteps": (None, None)}
    first = {r.report_id: r.c for r in df.withColumn("e", nested.exit_info("first")).select(
        "report_id", F.col("e.exitCode").alias("c")).collect()}
    assert first["valid"] == "99999"


def test_events_and_metrics_of_job(make):
    df = make(
        report("a", step("cmsRun1", cpu={"TotalJobTime": 1.0}, output=[{"events": 3}, {"events": None}]),
               step("cmsRun2", cpu={"TotalJobTime": 2.0}, output=[{"events": 4}])),
        report("b", step("cmsrun1", cpu={"TotalJobTime": 9.0}, output=[{"events": 0}])))
    rows = {r.report_id: r for r in df.select(
        "report_id", nested.total_events().alias("events"), nested.job_metric("cpu.TotalJobTime").alias("first"),
        nested.job_metric("cpu.TotalJobTime", "sum").alias("sum")).collect()}
    assert (rows["a"].events, rows["a"].first, rows["a"].sum) == (7, 1.0, 3.0)
    assert (rows["b"].events, rows["b"].first, rows["b"].sum) == (None, None, 9.0)  # 0 is null; case matters here


@pytest.mark.parametrize("task, wanted", [
    ("/wf/x/T", ("wf", "T")), ("12:user:name", ("user", "name")), ("plain", ("workflow-NA", "task-NA")), (None, ("workflow-NA", "task-NA"))])
def test_split_task(spark, task, wanted):
    parts = nested.split_task(F.col("task"))
    row = spark.createDataFrame([(task,)], "task string").select(parts["workflow"].alias("w"), parts["task"].alias("t")).first()
    assert (row.w, row.t) == wanted


def test_index_outside_dictionary(make):
    df = make(report("a", step("cmsRun1", output=[{"outputLFNs": [0, 7], "inputLFNs": None}]), lfns=["f"]))
    assert df.select(nested.output_files().alias("f")).first().f == ["f"]
    assert extract.deref(df).first().output_files == ["f", None]


def test_flatten_errors_and_outputs(make):
    df = make(report("a", step("s1", "T1_A", errors=["5", None], output=[{"outputDataset": "d"}]),
                     step("s2", None, errors=["6"], output=[{}]), step("s3", "T2_B", output=[{}])))
    assert sorted((r.site, r.exitCode) for r in extract.flatten_errors(df).collect()) == [("T1_A", 5), ("T2_B", 0)]
    # The code of one step does not stick to the next, a step without site is skipped alone.
    assert sorted((r.site, r.dataset, r.exitCode) for r in extract.flatten_outputs(df).collect()) == [
        ("T1_A", "d", "-1"), ("T2_B", "NA", None)]


def test_bucket_bounds(spark):
    df = spark.sql("select timestamp_ntz'2017-01-31 13:20:00' as t")
    wanted = {"hour": ("31 13:00", "31 14:00"), "day": ("31 00:00", "01 00:00"), "week": ("30 00:00", "06 00:00"),
              "month": ("01 00:00", "01 00:00")}
    for precision, (start, end) in wanted.items():
        begin = scalar.bucket_start(F.col("t"), precision)
        row = df.select(F.date_format(begin, "dd HH:mm").alias("s"),
                        F.date_format(scalar.bucket_end(begin, precision), "dd HH:mm").alias("e")).first()
        assert (row.s, row.e) == (start, end)


def test_nan_and_missing_metrics(make):
    nan = {"AvgEventCPU": "NaN"}
    df = make(report("a", step("cmsRun1", cpu=nan), task="t"), report("b", step("cmsRun1", cpu={"AvgEventCPU": 4.0}), task="t"),
              report("c", step("cmsRun1", cpu={}), task="t"), report("d", step("cmsRun1", cpu=nan), task="u"))
    rows = {r.task: (r.average, r.failed) for r in stats.avg_event_cpu(df).collect()}
    assert rows == {"t": (4.0, 1), "empty": (None, 1), "u": (None, 1)}


def test_storage_stats_min_ignores_zero(make):
    df = make(*[report(str(i), step("cmsRun1", "S", storage={"writeTotalSecs": v} if v is not None else {}))
                for i, v in enumerate([0.0, 7.0, 3.0, None])])
    row = stats.storage_stats(df, ["S"]).where("attribute = 'writeTotalSecs'").first()
    assert (row.count0, row.count1, row.total, row["min"], row["max"], row.nrecords) == (1, 1, 3, 3.0, 7.0, 4)
    empty = stats.storage_stats(df, ["S"]).where("attribute = 'readMBSec'").first()
    assert (empty["mean"], empty["min"], empty["max"]) == (None, 0.0, 0.0)
    extremes = {r.which: r.report_id for r in stats.storage_extremes(df, ["S"]).collect()}
    assert extremes == {"max": "1", "min": "2"}


def test_metric_filters_are_independent(make):
    df = make(report("a", step("cmsRun1", "S", cpu={"TotalJobTime": -1.0, "TotalJobCPU": 5.0})))
    rows = rollup(df, metrics=["cpu.TotalJobTime", "cpu.TotalJobCPU"])
    found = {r.metric for r in cube.performance(rows, ["cpu.TotalJobTime", "cpu.TotalJobCPU", "jobstate"], ["_summary"]).collect()}
    assert found == {"cpu.TotalJobCPU", "jobstate"}


def test_weighted_and_plain_average(make):
    df = make(*[report(str(i), step("cmsRun1", "S", cpu={"TotalJobTime": v}), jobtype=t)
                for i, (v, t) in enumerate([(1.0, "x"), (1.0, "x"), (1.0, "x"), (5.0, "y")])])
    row = cube.metric_by(rollup(df, metrics=["cpu.TotalJobTime"]), "cpu.TotalJobTime").first()
    assert (row.average, row.average_unweighted, row["count"]) == (2.0, 3.0, 4)


def test_timerange_checks(make):
    today = dt.date(2017, 2, 1)
    for bad in ([20170102, 20170101], ["x", "y"], [20170101], ["2d", "3d"]):
        with pytest.raises(ValueError):
            check_timerange(bad, today)
    assert check_timerange(["1d", 20170201], today) == (dt.date(2017, 1, 31), today)
    df = make(report("a", ts="2016-12-31 23:59:59"), report("b", ts="2017-01-31 00:00:00"), report("c", ts="2017-02-01 10:00:00"))
    assert ids(prune(df, today=today)) == ["b", "c"]
    assert ids(prune(df, [20161231, 20170131])) == ["a", "b"]
    assert ids(prune(df, [20161231, 20161231])) == ["a"]


def test_tiers(make):
    today = dt.date(2017, 2, 1)
    hot = make(report("a", ts="2017-01-15 00:00:00"), report("b", ts="2016-12-15 00:00:00"))
    cold = make(report("b", ts="2016-12-15 00:00:00"), report("c", ts="2016-11-15 00:00:00"))
    assert choose_tier([20161101, 20161130], 30, today) == "cold"
    assert ids(tiered_read(hot, cold, [20161101, 20170131], 30, today)) == ["a", "b", "c"]
    assert ids(tiered_read(hot, cold, [20161101, 20161231], 30, today)) == ["b", "c"]


def test_sites_written_as_objects(make):
    df = make(report("a", step("s", "{}"), step("t", "T1")))
    assert normalise_steps(df).select("steps.site").first().site == [None, "T1"]


def test_scalar_vectors(spark):
    one = spark.range(1)
    text = lambda c: one.select(c.alias("x")).first().x
    assert text(scalar.human_duration(F.lit(90061))) == "1 day, 1 hour, 1 minute, 1 second"
    assert text(scalar.human_duration(F.lit(0))) == ""
    assert text(scalar.human_size(F.lit("x"))) == "N/A"
    assert text(scalar.human_size(F.lit(1.5e18))) is None
    assert text(scalar.epoch_of(F.lit("20170101"), F.lit(0))) == 1483228800
    assert text(scalar.epoch_of(F.lit("20171399"), F.lit(0))) is None
    with pytest.raises(ValueError):
        scalar.cutoff("3y", dt.datetime(2017, 1, 1))
    days = one.select(F.explode(scalar.date_range(F.lit("2016-02-28").cast("date"), F.lit("2016-03-01").cast("date"))).alias("d"))
    assert [r.p for r in days.select(scalar.date_path(F.col("d")).alias("p")).collect()] == ["2016/02/28", "2016/02/29", "2016/03/01"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(min_value=0, max_value=1e14, allow_nan=False), min_size=1, max_size=40))
def test_human_size_equals_printf(spark, values):
    """The size text has the one decimal C's printf would give."""
    def wanted(v):
        power = next(p for p in range(6) if v < 1000.0 ** (p + 1))
        return f"{v / 1000.0 ** power:3.1f}{scalar.SIZE_UNITS[10][power]}"

    values = [v + 0.0 for v in values]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(scalar.human_size(F.col("v")).alias("s")).collect()
    assert [r.s for r in rows] == [wanted(v) for v in values]


def _reports(make, n, offset=0):
    return make(*[report(
        str(i), step("cmsRun1", f"S{i % 3}" if i % 4 else None, errors=["8001"] if i % 5 == 0 else [],
                     output=[{"events": i % 7, "acquisitionEra": f"E{i % 2}"}], cpu={"TotalJobTime": float(i)} if i % 6 else {}),
        ts=str(dt.datetime(2016, 12, 20) + dt.timedelta(hours=9 * i)), task=f"/w{i % 2}/T", state="success")
        for i in range(offset, offset + n)])


def _rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("source, target", [("hour", "day"), ("hour", "week"), ("day", "week"), ("day", "month"), ("hour", "month")])
def test_coarsen_is_exact(make, source, target):
    df = _reports(make, 60)
    metrics = ["cpu.TotalJobTime"]
    assert _rows(coarsen(rollup(df, source, metrics=metrics), source, target)) == _rows(rollup(df, target, metrics=metrics))


def test_week_to_month_is_refused(make):
    with pytest.raises(ValueError):
        coarsen(rollup(_reports(make, 3), "week", metrics=[]), "week", "month")


def test_merge_of_parts_equals_whole(make):
    a, b = _reports(make, 30), _reports(make, 30, 15)
    metrics = ["cpu.TotalJobTime"]
    merged = merge_rollups(rollup(a, "week", metrics=metrics), rollup(b, "week", metrics=metrics))
    assert _rows(merged) == _rows(rollup(a.unionByName(b), "week", metrics=metrics))


def test_state_totals_add_up(make):
    rows = rollup(_reports(make, 40), metrics=[])
    found = {r.jobstate: r["count"] for r in stats.state_totals(rows).collect()}
    assert found["total"] == 40 == sum(n for s, n in found.items() if s != "total")

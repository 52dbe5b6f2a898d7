"""Nulls, codes that are no numbers, repeated ids and odd documents."""

import json

import pytest
from pyspark.sql import functions as F

from reports import report, step
from jobledger.operators import extract, jobs, search
from jobledger.sources import sinks
from jobledger.sources.reports import by_ids, read_documents


@pytest.fixture
def coded(make):
    return make(report("a", step("cmsRun1", errors=["8001", "8002"])), report("b", step("cmsRun1", errors=["None"])),
                report("c", step("cmsRun1")), report("d", step("cmsRun1", errors=[None, "8001"])), report("e"))


def ids(df):
    return sorted(r.report_id for r in df.select("report_id").collect())


@pytest.mark.parametrize("wanted,found", [
    (8001, ["a", "d"]), ("8001", ["a", "d"]), ([8001, 8002], ["a", "d"]), ({"$gt": 8001}, ["a"]),
    ({"$ne": "8001"}, ["b", "c", "e"]), ({"$ne": 8001}, ["b", "c", "e"]), ({"$eq": None}, ["d"]), ({"$all": ["8001", "8002"]}, ["a"]),
])
def test_codes_as_numbers_texts_and_missing(coded, wanted, found):
    assert ids(search.find(coded, {"steps.errors.exitCode": wanted})) == found


def test_missing_scalars(make):
    df = make(report("a"), report("b"))
    df = df.withColumn("campaign", F.when(F.col("report_id") == "a", "x"))
    assert ids(search.find(df, {"campaign": {"$ne": "x"}})) == ["b"]
    assert ids(search.find(df, {"campaign": None})) == ["b"]
    assert ids(search.find(df, {"campaign": {"$ne": None}})) == ["a"]


def test_or_takes_specs_without_time_ranges(coded):
    for wrong in ([], [{"timerange": [20170101, 20170102]}]):
        with pytest.raises(ValueError):
            search.find(coded, {"$or": wrong})


def test_failures_keep_to_the_time_range(make):
    df = make(report("a", state="jobfailed", ts="2017-01-05 00:00:00"), report("b", state="jobfailed", ts="2018-01-05 00:00:00"))
    assert ids(extract.failures(df, {"timerange": [20170101, 20170131]})) == ["a"]


def test_null_keys_are_reduced_too(spark):
    df = spark.createDataFrame([("x", 1), (None, 2), ("x", 3), (None, 4)], "key string, n long").repartition(3)
    total = jobs.emit_reduce(df, lambda f: f, lambda f: f.groupby("key", as_index=False, dropna=False).sum(), "key string, n long")
    assert {r.key: r.n for r in total.collect()} == {"x": 4, None: 6}


def test_rows_without_an_id_are_all_new(make, spark, tmp_path):
    df = make(report("a"), report(None), report(None), report("a"))
    for _ in range(2):
        sinks.append_new(df, str(tmp_path / "t"))
    assert sorted(str(r.report_id) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == ["None"] * 4 + ["a"]


def test_a_second_rollup_replaces_the_first(spark, tmp_path):
    rows = lambda n: spark.createDataFrame([("h1", n), ("h2", 1)], "hash string, count long").withColumn(
        "start_date", F.lit("2017-01-01 00:00:00").cast("timestamp_ntz"))
    sinks.upsert_rollup(rows(1), str(tmp_path / "r"))
    sinks.upsert_rollup(rows(5).where("hash = 'h1'"), str(tmp_path / "r"))
    assert {r.hash: r["count"] for r in spark.read.parquet(str(tmp_path / "r")).collect()} == {"h1": 5, "h2": 1}


def test_id_lists_keep_the_columns(make, spark):
    df = make(report("a"), report("b"))
    for wanted in (["a"], [str(i) for i in range(1500)] + ["a"], spark.createDataFrame([("a",)], "i string")):
        out = by_ids(df, wanted)
        assert out.columns == df.columns and ids(out) == ["a"]


def test_archived_documents(spark, tmp_path):
    steps = [{"name": "cmsRun1", "site": {}, "errors": [{"exitCode": 8001, "type": "t", "details": "d"}],
              "performance": {"cpu": {"TotalJobTime": "1.5", "x": "nan?"}, "storage": {}, "memory": {}}}, {"name": "logArch1", "site": "T2_X"}]
    doc = {"wmaid": "w", "task": "/a/b", "LFNArray": ["f"], "Campaign": "c", "PrepID": "p", "steps": steps,
           "meta_data": {"fwjr_id": "7-0", "jobtype": "Merge", "jobstate": "success", "host": "h", "ts": 86400 * 366},
           "WMTiming": {"WMTotalWallClockTime": 5}}
    legacy = {**doc, "wmaid": "l", "steps": {s["name"]: {k: v for k, v in s.items() if k != "name"} for s in steps[::-1]}}
    odd = {"something": "else"}
    (tmp_path / "d.json").write_text("\n".join(map(json.dumps, (doc, legacy, odd))) + "\nno json\n")
    rows = read_documents(spark, str(tmp_path / "d.json")).collect()
    good = {r.report_id: r for r in rows if r._corrupt is None}
    assert sorted(good) == ["l", "w"] and sum(r._corrupt is not None for r in rows) == 2
    for r in good.values():
        assert (r.campaign, r.prep_id, r.meta.job_id, r.lfns, r.wall_s, r.year, r.month, r.day) == ("c", "p", "7-0", ["f"], 5, 1971, 1, 2)
        assert [(s.name, s.site) for s in r.steps] == [("cmsRun1", None), ("logArch1", "T2_X")]
        assert r.steps[0].errors[0].exitCode == "8001" and r.steps[0].performance.cpu == {"TotalJobTime": 1.5, "x": None}

"""What the plans must look like at scale."""

import re
from pathlib import Path

import pytest

from reports import SF
from jobledger.functions import nested
from jobledger.operators import cube, extract, search
from jobledger.operators.rollup import rollup
from jobledger.sources.archive import archive, daily_rollup
from jobledger.sources.reports import by_ids, prune


@pytest.fixture(scope="module")
def reports(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    return archive(spark, SF)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def read_schema(df):
    return " ".join(re.findall(r"ReadSchema: (.*)", plan(df)))


def test_dates_become_partition_filters(reports):
    text = plan(prune(reports, [20000101, 20000131]))
    assert re.search(r"PartitionFilters: \[.*year.*month", text)


def test_ids_are_pushed_to_the_scan(reports):
    assert "In(report_id" in plan(by_ids(reports, ["a", "b"])).replace(" ", "")


def test_only_needed_step_fields_are_read(reports):
    sites = read_schema(reports.select(nested.first_site()))
    assert "site" in sites and "performance" not in sites and "output" not in sites
    gate = read_schema(search.at_site(reports, ["x"]).select("report_id"))
    assert "performance" not in gate and "errors" not in gate
    metric = read_schema(reports.select(nested.job_metric("cpu.TotalJobTime")))
    assert "cpu" in metric and "memory" not in metric and "output" not in metric
    flat = read_schema(extract.flatten_errors(reports))
    assert "performance" not in flat and "output" not in flat


def test_a_search_reads_only_its_fields(reports):
    schema = read_schema(search.find(reports, {"task": "/x"}, ["report_id"]))
    assert "steps" not in schema and "lfns" not in schema


@pytest.mark.parametrize("build", [
    lambda r: rollup(r), lambda r: cube.metric_by(rollup(r), "cpu.TotalJobTime", "site"),
    lambda r: cube.performance(rollup(r), ["cpu.TotalJobTime", "jobstate"], ["site", "time"]),
    lambda r: cube.suggestions(rollup(r), filters={"site": "T1"})])
def test_roll_up_plans_stay_in_the_jvm(reports, build):
    text = plan(build(reports))
    assert "Python" not in text and "Pandas" not in text and "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_a_roll_up_shuffles_once(reports):
    assert plan(rollup(reports)).count("Exchange hashpartitioning") == 1


def test_the_bundle_adds_one_shuffle(reports):
    df = cube.performance(rollup(reports), ["cpu.TotalJobTime", "data.events", "jobstate"], ["site", "time", "_summary"])
    assert plan(df).count("Exchange hashpartitioning") == 2


def test_nothing_is_broadcast_by_hint():
    """The training-data operators say at each hint what bounds it; the engine itself has none."""
    root = Path(__file__).resolve().parents[1] / "jobledger"
    for path in root.rglob("*.py"):
        assert path.parent.name == "llm" or "broadcast(" not in path.read_text()


def test_time_frames_prune_the_stored_rollup(spark, reports):
    import datetime as dt

    text = plan(cube.timeframe(daily_rollup(spark, SF), dt.date(1997, 2, 1), dt.date(1997, 3, 31)))
    assert re.search(r"PartitionFilters: \[[^\]]*year[^\]]*month", text)
    assert "PushedFilters" in text and "Exchange" not in text


def test_suggestions_evaluate_each_filter_once(spark, reports):
    rows = cube.suggestions(daily_rollup(spark, SF), filters={"site": "T1", "workflow": "[0-9]7"})
    text = rows._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("RLIKE") == 2


def test_traces_explode_their_edges_once():
    text = (Path(__file__).resolve().parents[1] / "jobledger/operators/lineage.py").read_text()
    assert text.split("def hop")[1].count("explode") == 0


def test_the_stored_roll_up_shuffles_no_constants(spark, reports, monkeypatch):
    """End and precision of the buckets went through the shuffle by month with each row."""
    from jobledger.sources import archive as stored

    seen = []
    real = stored.closed
    monkeypatch.setattr(stored, "closed", lambda df, *more: seen.append(df) or real(df, *more))
    monkeypatch.setattr(stored, "_WRITTEN", {p for p in stored._WRITTEN if not p.endswith("-rollup")})
    rows = daily_rollup(spark, SF)
    assert not {"end_date", "precision"} & set(seen[0].columns)
    assert rows.columns == [*rollup(reports).columns, "year", "month"]
    assert rows.where("end_date = start_date + interval 1 day and precision = 'day'").count() == rollup(reports).count()


def test_documents_are_verified_once(spark):
    """The wrong ones were found anew for each of their two uses."""
    from jobledger.plans.catalog import QUERIES

    assert "sha2" not in plan(QUERIES["s09_verify_reports"](spark, SF))

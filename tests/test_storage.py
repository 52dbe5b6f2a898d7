"""Round trips, idempotence, retention, validation and streams."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from reports import SF, report, step
from jobledger.operators import jobs, lifecycle, quality, stats
from jobledger.operators.rollup import rollup
from jobledger.plans.q_quality import DOCUMENT_SCHEMA
from jobledger.session import shared_dir
from jobledger.sources import sinks
from jobledger.sources.archive import archive, stream_archive
from jobledger.sources.reports import read_documents, read_reports, steps_from_map
from jobledger.sources.tables import raw_documents, table
from jobledger.streaming.ingest import enrich, ingest_stream, migrate
from jobledger.streaming.live import live_rollup, read_live, write_live


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json"])
def test_round_trip(make, spark, tmp_path, fmt):
    """Maps, nulls, empty and nested arrays come back as they were."""
    df = make(report("a", step("cmsRun1", "T1_X", [None, "8001"], [{"outputLFNs": [0, 1], "runs": [{"runNumber": 1, "lumis": [1, 2]}]}],
                                cpu={"TotalJobTime": 1.5, "x": -1.0}), step("logArch1"), lfns=["f", "g"]), report("b", lfns=[]))
    sinks.write(df, str(tmp_path / fmt), fmt=fmt)
    back = read_reports(spark, str(tmp_path / fmt), fmt=fmt).drop("_corrupt")
    rows = lambda x: [r.asDict(True) for r in x.orderBy("report_id").collect()]
    assert rows(back) == rows(df)
    assert back.where("report_id = 'a'").select("meta.host").first().host == "h"


def test_broken_json_is_kept_aside(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"task": "a"}\n{"task": \n')
    rows = read_reports(spark, str(tmp_path / "x.json"), schema="task string", fmt="json").cache()
    assert sorted(r._corrupt is None for r in rows.collect()) == [False, True]


def test_append_is_idempotent(make, tmp_path, spark):
    df = make(report("a"), report("b"), report("a"))
    for _ in range(3):
        sinks.append_new(df, str(tmp_path / "t"))
    assert sorted(r.report_id for r in spark.read.parquet(str(tmp_path / "t")).collect()) == ["a", "b"]


def test_append_to_partitions_looks_up_their_ids(make, tmp_path, spark):
    path, by = str(tmp_path / "p"), ["year", "month", "day"]
    old, new = report("a", ts="2017-01-01 00:00:00"), report("b", ts="2017-05-01 00:00:00")
    moved = report("a", ts="2018-03-01 00:00:00")
    for batch in ([old], [old, new], [new], [moved], []):
        sinks.append_new(make(*batch) if batch else make(new).limit(0), path, partition_by=by)
    assert sorted(r.report_id for r in spark.read.parquet(path).collect()) == ["a", "b"]


def test_compare_counts_copies(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    b = spark.createDataFrame([(1,), (3,)], "x int")
    assert sorted((r.x, r.side, r.n) for r in stats.compare(a, b).collect()) == [(1, "source", 1), (2, "source", 1), (3, "copy", 1)]
    assert stats.same_rows(a, a.repartition(2)).first().same and not stats.same_rows(a, b).first().same


def test_missing_target_only(spark, tmp_path):
    assert sinks.read_or_none(spark, str(tmp_path / "nothing")) is None


def test_daily_layout_skips_existing_days(make, tmp_path, spark):
    root = str(tmp_path / "d")
    sinks.write_daily(make(report("a", ts="2017-01-01 00:00:00")), root)
    sinks.write_daily(make(report("b", ts="2017-01-01 00:00:00"), report("c", ts="2017-01-02 00:00:00")), root, skip_existing=True)
    assert sorted(r.report_id for r in spark.read.parquet(root).collect()) == ["a", "c"]
    assert (tmp_path / "d" / "year=2017" / "month=1" / "day=2").is_dir()


def test_expire_whole_and_part_of_days(make, tmp_path, spark):
    root = str(tmp_path / "e")
    old, new = "2017-01-01 00:00:00", "2017-03-01 00:00:00"
    rows = make(report("a", ts=old), report("b", ts=old), report("c", ts="2017-01-02 00:00:00"), report("d", ts=new))
    sinks.write_daily(rows.withColumn("stage", F.when(F.col("report_id") == "b", "hot").otherwise("cold")), root)
    for _ in range(2):
        lifecycle.expire_reports(spark, root, dt.date(2017, 2, 1), stage="cold")
        assert sorted(r.report_id for r in spark.read.parquet(root).collect()) == ["b", "d"]
    lifecycle.set_stage(spark, root, spark.createDataFrame([("d",)], "report_id string"), "moved")
    assert {r.report_id: r.stage for r in spark.read.parquet(root).collect()} == {"b": "hot", "d": "moved"}


def test_results_are_replaced(spark, tmp_path):
    path = str(tmp_path / "r")
    qid = sinks.query_id({"b": 1, "a": 2})
    assert qid == sinks.query_id({"a": 2, "b": 1}) and len(qid) == 32
    for n in (1, 2):
        sinks.save_result(spark.range(n), path, qid, etime=0.5, ts=1.0)
    assert sinks.get_result(spark, path, qid).count() == 2
    assert [r.query_id for r in sinks.list_results(spark, path).collect()] == [qid]


def test_size_limit(make):
    df = make(report("small"), report("large", lfns=["x" * 5000]))
    assert [r.report_id for r in sinks.publishable(df, 4000).collect()] == ["small"]
    assert [(r.report_id, r.n_bytes > 4000) for r in sinks.oversized(df, 4000).collect()] == [("large", True)]


def test_routing_sends_each_record_once_per_topic(spark):
    df = spark.createDataFrame([("T1_X", 5), ("T2_Y", 0)], "site string, exitCode int")
    rows = sorted((r.site, r.topic) for r in sinks.route(df, ["a.T1_", "a.exitCode", "all"], "all").collect())
    assert rows == [("T1_X", "a.T1_"), ("T1_X", "a.exitCode"), ("T1_X", "all"), ("T2_Y", "all")]


GOOD = {"task": "t", "wall": 1, "ok": True, "meta": {"ts": 1, "jobtype": "x", "note": ""}, "files": [],
        "steps": [{"name": "n", "site": "s", "events": None}]}


@pytest.mark.parametrize("change, paths", [
    ({}, []), ({"wall": 1.5}, []), ({"wall": "1"}, ["/wall"]), ({"ok": 1}, ["/ok"]), ({"files": ["a", 1]}, ["/files"]),
    ({"files": "a"}, ["/files"]), ({"steps": []}, []), ({"meta": None}, ["/meta/jobtype", "/meta/ts"]),
    ({"steps": [{"name": 1}, {"name": "n", "site": "s", "events": "x"}]}, ["/steps/events", "/steps/name", "/steps/site"]),
])
def test_validator(spark, change, paths):
    df = spark.createDataFrame([(json.dumps({**GOOD, **change}),)], "doc string")
    found = quality.error_rows(quality.validate(df, DOCUMENT_SCHEMA)).collect()
    assert sorted(r.path for r in found) == paths


def test_text_that_is_no_json(spark):
    checked = quality.validate(spark.createDataFrame([("{",), (None,)], "doc string"), DOCUMENT_SCHEMA)
    assert [r.path for r in quality.error_rows(checked).collect()] == ["/", "/"]


def test_map_shaped_steps(spark):
    df = spark.sql("select map('b', named_struct('name', '', 'site', 'y'), 'a', named_struct('name', '', 'site', 'x')) as steps")
    assert [tuple(s) for s in df.select(steps_from_map(F.col("steps")).alias("s")).first().s] == [("a", "x"), ("b", "y")]


def test_enrich_keeps_what_is_there(spark):
    df = spark.createDataFrame([("x", None), (None, "cold")], "report_id string, stage string")
    rows = enrich(df, now=F.lit(3.0)).collect()
    assert rows[0].report_id == "x" and len(rows[1].report_id) == 32
    assert [r.stage for r in rows] == ["hot", "cold"] and rows[0].ingest_ts == 3.0 and rows[0].kind == "fwjr"


def test_stream_equals_batch(spark, tmp_path):
    metrics = ["cpu.TotalJobTime"]
    write_live(live_rollup(stream_archive(spark, SF), "day", metrics=metrics),
               str(tmp_path / "live"), str(tmp_path / "c")).awaitTermination()
    batch = rollup(archive(spark, SF), "day", metrics=metrics)
    live = read_live(spark, str(tmp_path / "live"))
    assert live.select(*batch.columns).exceptAll(batch).isEmpty() and batch.exceptAll(live.select(*batch.columns)).isEmpty()


def test_ingest_drops_nothing_old(spark, tmp_path):
    """Reports of any age arrive in several batches; each is stored once."""
    source = stream_archive(spark, SF, files_per_batch=20).drop("steps")
    ingest_stream(source, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "t")).count() == archive(spark, SF).count()


def test_migration_accounts_for_all(spark, tmp_path):
    docs = raw_documents(table(spark, SF, "lineitem"))
    docs.write.parquet(str(tmp_path / "hot"))
    for _ in range(2):
        migrate(spark, *[str(tmp_path / n) for n in ("hot", "cold", "bad", "c")], DOCUMENT_SCHEMA).awaitTermination()
    good, bad = (spark.read.parquet(str(tmp_path / n)).count() for n in ("cold", "bad"))
    assert good + bad == docs.count() and bad > 0


def test_emit_reduce_on_one_hot_key(spark):
    """A key with most rows, over several batches and keys cut by batch borders."""
    df = spark.range(50_000).withColumn("key", F.when(F.col("id") % 3 < 2, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 700)))
    out = jobs.emit_reduce(df, lambda f: f.assign(n=1)[["key", "n"]],
                           lambda f: f.groupby("key", as_index=False)["n"].sum(), "key string, n bigint")
    wanted = df.groupBy("key").agg(F.count("*").alias("n"))
    assert out.exceptAll(wanted).isEmpty() and wanted.exceptAll(out).isEmpty()


def test_shared_dir_follows_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_folders_are_written_without_sorting_documents(spark, tmp_path, monkeypatch):
    """The sort by folder in front of a write spilled whole documents."""
    from pyspark.sql.readwriter import DataFrameWriter

    seen, plain = [], DataFrameWriter.parquet

    def held(self, path, **options):
        seen.append(int(self._spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")))
        return plain(self, path, **options)

    monkeypatch.setattr(DataFrameWriter, "parquet", held)
    df = spark.range(900).selectExpr("id", "2000 year", "cast(id % 12 + 1 as int) month", "cast(id % 25 + 1 as int) day")
    sinks.write_daily(df, str(tmp_path / "daily"))
    sinks.replace_partitions(df.where("month < 3"), str(tmp_path / "daily"))
    rows = spark.read.parquet(str(tmp_path / "daily"))
    assert len(seen) == 2 and min(seen) > 0
    assert rows.count() == rows.select("id").distinct().count() == 900


def test_stored_texts_are_compressed(spark, tmp_path):
    rows = spark.range(50).selectExpr("id", "'T1_x' site", "'jobs.all' topic")
    sinks.write_topics(rows, str(tmp_path / "topics"))
    sinks.write(rows, str(tmp_path / "json"), fmt="json")
    for place in ("topics", "json"):
        assert {p.suffix for p in (tmp_path / place).rglob("part-*")} == {".gz"}
        assert spark.read.json(str(tmp_path / place)).count() == 50


def test_documents_that_lie_by_folder_are_not_shuffled(spark, tmp_path):
    """Rows of a table in a like layout are written from where they are; scattered ones are put together first."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    scattered = spark.range(4000).selectExpr("id", "2000 year", "cast(id % 12 + 1 as int) month", "cast(id % 25 + 1 as int) day")
    assert "Rebalance" in plan(sinks.together(scattered, ["year", "month", "day"]))
    sinks.write_daily(scattered, str(tmp_path / "months"), by=["year", "month"])
    lying = spark.read.parquet(str(tmp_path / "months"))
    assert "Rebalance" not in plan(sinks.together(lying, ["year", "month", "day"]))
    sinks.write_daily(lying, str(tmp_path / "days"))
    assert spark.read.parquet(str(tmp_path / "days")).orderBy("id").select("id", "day").collect() == lying.orderBy("id").select("id", "day").collect()


def test_fewer_files_without_a_shuffle(spark, tmp_path):
    spark.range(0, 900, 1, 6).write.parquet(str(tmp_path / "six"))
    six = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "six")).repartition(6)
    for n in (3, 9):
        sinks.write(six, str(tmp_path / f"n{n}"), n=n)
        assert len(list((tmp_path / f"n{n}").glob("part-*"))) == n and spark.read.parquet(str(tmp_path / f"n{n}")).count() == 900


def test_old_steps_are_parsed_once(spark, tmp_path):
    """A map of steps was parsed again for each of its keys."""
    (tmp_path / "old.json").write_text(json.dumps({"meta_data": {"ts": 5}, "steps": {"b": {"site": "T1"}, "a": {"site": "{}"}}}))
    rows = read_documents(spark, str(tmp_path / "old.json"))
    assert [(s.name, s.site) for s in rows.first().steps] == [("a", None), ("b", "T1")]
    plan = rows.select("steps")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(MapType") == 1


def test_reports_of_a_day_and_part_lie_together_in_the_archive(spark):
    """In the order of their line items, files of documents were a tenth larger."""
    rows = archive(spark, SF).select("_metadata.file_path", "meta.ts", F.get("lfns", F.lit(0)).alias("file")).collect()
    files = {}
    for r in rows:
        files.setdefault(r.file_path, []).append((r.ts // 86400, int(r.file.removeprefix("/store/in/").removesuffix(".root"))))
    assert len(files) > 50 and all(places == sorted(places) for places in files.values())


def test_a_folder_read_by_many_tasks_is_written_from_where_it_lies(spark, monkeypatch):
    """Files were counted by folder alone, so that documents of a large table, whose folders many tasks read, were shuffled."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    large = spark.range(0, 600, 1, 6).selectExpr("id", "1 year")
    assert "Rebalance" in plan(sinks.together(large, ["year"]))
    monkeypatch.setattr(sinks, "ROWS_PER_FILE", 100, raising=False)
    assert "Rebalance" not in plan(sinks.together(large, ["year"]))


def test_notifications_are_compressed(spark, tmp_path):
    from jobledger.streaming.notify import notify_stream

    notify_stream(stream_archive(spark, SF), str(tmp_path / "topics"), str(tmp_path / "checkpoint"), ["jobs.exitCode", "jobs.all"], "jobs.all").awaitTermination()
    files = list((tmp_path / "topics").glob("topic=*/part-*"))
    assert files and all(f.name.endswith(".json.gz") for f in files)

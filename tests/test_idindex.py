import pytest

from jobledger.sources import idindex, sinks


def table(spark, ids):
    return spark.createDataFrame([(i, float(n), {"k": n}) for n, i in enumerate(ids)], "report_id string, ingest_ts double, m map<string,int>")


def stored(spark, path):
    return sorted(r.report_id or "" for r in spark.read.parquet(path).select("report_id").collect())


def test_index_follows_the_files(spark, tmp_path):
    path = str(tmp_path / "t")
    assert sinks.append_new(table(spark, ["a", "b", "a", None, None]), path).new == 4
    assert stored(spark, path) == ["", "", "a", "b"]
    plan = sinks.append_new(table(spark, ["b", "c", "c"]), path)
    assert (plan.arrived, plan.new) == (3, 1) and stored(spark, path) == ["", "", "a", "b", "c"]
    assert sinks.append_new(table(spark, ["a", "b", "c"]), path).rows is None
    # What another writer adds is seen, what it removes counts no more.
    table(spark, ["d"]).write.mode("append").parquet(path)
    assert idindex.holds(spark, path, "report_id", ["a", "d", "x"]) == ["a", "d"]
    table(spark, ["e"]).coalesce(1).write.mode("overwrite").parquet(path)
    assert sinks.append_new(table(spark, ["a", "e"]), path).new == 1
    assert stored(spark, path) == ["a", "e"]


def test_the_earliest_of_rows_with_one_id_is_stored(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [("a", 3.0, {"k": 3}), ("a", 1.0, {"k": 1}), ("a", 2.0, {"k": 2})]
    sinks.append_new(spark.createDataFrame(rows, "report_id string, ingest_ts double, m map<string,int>").repartition(3), path)
    assert [r.m for r in spark.read.parquet(path).collect()] == [{"k": 1}]


def test_many_appends_are_put_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(idindex, "MOST_PARTS", 2)
    path = str(tmp_path / "t")
    for n in range(5):
        sinks.append_new(table(spark, [f"i{n}", f"i{n - 1}"]), path)
    assert len(list((tmp_path / "t" / "_covered").glob("part=*"))) <= 3
    assert stored(spark, path) == sorted(f"i{n}" for n in range(-1, 5))


def test_a_part_without_its_list_of_files_does_not_count(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.append_new(table(spark, ["a"]), path)
    sinks.append_new(table(spark, ["b"]), path)
    for part in (tmp_path / "t" / "_covered").glob("part=*"):
        idindex.delete_path(spark, str(part))
    assert sinks.append_new(table(spark, ["a", "b", "c"]), path).new == 1 and stored(spark, path) == ["a", "b", "c"]


@pytest.mark.parametrize("kind", ["stored", "once"])
def test_documents_are_not_shuffled(spark, tmp_path, kind):
    path = str(tmp_path / "t")
    sinks.append_new(table(spark, ["a"]), path)
    table(spark, ["a", "b"] if kind == "stored" else ["b", "b"]).write.parquet(str(tmp_path / "batch"))
    batch = spark.read.parquet(str(tmp_path / "batch"))
    plan = sinks.plan_append(batch, path)
    text = plan.rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_documents_stay_where_they_are_however_many_ids_are_known(spark, tmp_path, monkeypatch):
    """Above the size of an id table that is sent, documents were shuffled to be joined with known ids and with lost copies."""
    from jobledger.session import settings

    plans = []
    real = sinks.write
    monkeypatch.setattr(sinks, "write", lambda df, *a, **b: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, *a, **b))
    monkeypatch.setattr(sinks, "SENT_IDS", "1b")
    path, ids = str(tmp_path / "t"), [f"i{n}" for n in range(40000)]
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        assert sinks.append_new(table(spark, ids[::3]).repartition(2), path).new == 13334
        again = table(spark, ids).repartition(3)
        assert sinks.append_new(again.unionByName(again).unionByName(table(spark, [None, None])), path).new == 26668
        assert sinks.append_new(again, path).rows is None
    assert stored(spark, path) == sorted(["", "", *ids])
    assert len(plans) == 2 and not any("Exchange hashpartitioning" in p for p in plans)

import datetime as dt

from pyspark.sql import functions as F
from reports import report, step

from jobledger.operators import hashtree, lineage, maintain
from jobledger.operators.rollup import rollup
from jobledger.session import delete_path
from jobledger.sources import sinks
from jobledger.sources.reports import canonical_text, verify_documents, with_document_hash
from jobledger.streaming.live import keep_live, live_parts

WHOLE = (dt.date(2016, 1, 1), dt.date(2018, 12, 31))
BY = ["year", "month", "day"]


def at(rid, day, hour=12, **more):
    return report(rid, step("cmsRun1", site="T1_A", cpu={"TotalJobTime": 5.0}), ts=f"2017-01-{day:02} {hour:02}:00:00", **more)


def stored(spark, target):
    return sorted((r.day, r["count"]) for r in spark.read.parquet(f"{target}/rows").collect())


def test_only_changed_days_are_read(spark, make, tmp_path):
    source, target = str(tmp_path / "s"), str(tmp_path / "t")
    sinks.write_daily(make(at("a", 1), at("b", 2), at("c", 3)), source)
    run = lambda first=WHOLE[0], last=WHOLE[1]: maintain.aggregate_range(spark, source, target, first, last, metrics=[])
    assert run() == [(2017, 1, 1), (2017, 1, 2), (2017, 1, 3)] and stored(spark, target) == [(1, 1), (2, 1), (3, 1)]
    assert run() == []
    sinks.write_daily(make(at("d", 2), at("e", 4)), source)
    assert run(last=dt.date(2017, 1, 3)) == [(2017, 1, 2)]
    assert stored(spark, target) == [(1, 1), (2, 2), (3, 1)]
    assert run() == [(2017, 1, 4)]
    # A day that loses its files goes from the roll-up, too.
    delete_path(spark, f"{source}/year=2017/month=1/day=3")
    assert run() == [(2017, 1, 3)] and stored(spark, target) == [(1, 1), (2, 2), (4, 1)]
    about = maintain.range_stats(spark.read.parquet(f"{target}/sketches"), dt.date(2017, 1, 2), dt.date(2017, 1, 4)).first()
    assert (about.records, about.jobs, about.workflows) == (3, 3, 1)
    assert maintain.range_stats(spark.read.parquet(f"{target}/sketches"), dt.date(2018, 1, 1), dt.date(2018, 1, 2)).first().jobs == 0


def test_live_windows_close_once(spark, make, tmp_path):
    hot, root = str(tmp_path / "hot"), str(tmp_path / "live")
    arrivals = [[at("a", 1), at("b", 2)], [at("c", 2), at("d", 5)], [at("e", 1), at("f", 5), at("g", 4, 23)], [at("h", 9)]]
    for rows in arrivals:
        df = make(*rows)
        df.write.mode("append").parquet(hot)
        keep_live(spark.readStream.schema(df.schema).parquet(hot), root, str(tmp_path / "c"), metrics=[]).awaitTermination()
    parts = {k: sorted((r.start_date.day, r["count"]) for r in v.collect()) for k, v in live_parts(spark, root).items()}
    # c and g come before their days have closed, e after.
    assert parts == {"open": [(9, 1)], "stored": [(1, 1), (2, 2), (4, 1), (5, 2)], "late": [(1, 1)]}
    assert sum(n for rows in parts.values() for _, n in rows) == 8
    assert len(list((tmp_path / "live" / "open").glob("batch=*"))) < 4


def test_a_batch_that_runs_again_changes_nothing(spark, make, tmp_path):
    hot, root = str(tmp_path / "hot"), str(tmp_path / "live")
    df = make(at("a", 1), at("b", 4))
    df.write.parquet(hot)
    for n in range(2):  # a second checkpoint numbers its batches from 0 again
        keep_live(spark.readStream.schema(df.schema).parquet(hot), root, str(tmp_path / f"c{n}"), metrics=[]).awaitTermination()
    parts = {k: sorted((r.start_date.day, r["count"]) for r in v.collect()) for k, v in live_parts(spark, root).items()}
    assert parts == {"open": [(4, 1)], "stored": [(1, 1)], "late": []}


def test_hash_tree_finds_rows_and_fields(spark, make, tmp_path):
    a = make(at("a", 1), at("b", 1), at("c", 2), at("d", 3))
    b = make(at("a", 1), at("b", 1, task="/other/x/T"), at("d", 3), at("e", 4))
    for name, df in (("a", a), ("b", b)):
        sinks.write_daily(df, str(tmp_path / name))
    left, right = (spark.read.parquet(str(tmp_path / n)) for n in "ab")
    rows = hashtree.build_and_compare(spark, left, right, str(tmp_path / "trees"))
    assert sorted((r.report_id, r.side, tuple(r.fields)) for r in rows.collect()) == [
        ("b", "both", ("task",)), ("c", "source", ()), ("e", "copy", ())]
    leaves = hashtree.differing_leaves(*[spark.read.parquet(str(tmp_path / "trees" / n)) for n in ("source", "copy")])
    assert sorted(r.day for r in leaves.collect()) == [1, 2, 4]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "(day#" in plan
    assert hashtree.build_and_compare(spark, left, left, str(tmp_path / "same")).isEmpty()


def test_document_hash_does_not_depend_on_the_schema(spark, make):
    df = with_document_hash(make(at("a", 1), at("b", 2)))
    turned = df.select(*sorted(df.columns, reverse=True)).selectExpr("* except (wall_s)", "cast(wall_s as double) wall_s")
    assert verify_documents(turned).isEmpty() and df.select("report_id").distinct().count() == 2
    assert verify_documents(df.withColumn("task", F.concat("task", F.lit("x")))).count() == 2
    one = spark.sql("select 1 a, map('y', 2D, 'x', 1.5D) m, named_struct('q', null, 'p', 3) s").withColumnRenamed("a", "b")
    two = spark.sql("select named_struct('p', 3D) s, map('x', 1.5F, 'y', 2) m, 1D b")
    assert one.select(canonical_text(one)).first()[0] == two.select(canonical_text(two)).first()[0]


def test_files_of_a_target_size(spark, tmp_path):
    df = spark.range(40_000).selectExpr("id", "sha2(string(id), 256) text", "cast(if(id % 10 < 7, 1, id % 10) as int) day")
    per_file = sinks.write_sized(df, str(tmp_path / "t"), 200_000, by=["day"])
    sizes = {}
    for f in (tmp_path / "t").glob("day=*/*.parquet"):
        sizes.setdefault(f.parent.name, []).append(f.stat().st_size)
    assert per_file > 100 and spark.read.parquet(str(tmp_path / "t")).count() == 40_000
    assert all(abs(n - 200_000) <= 40_000 for held in sizes.values() for n in sorted(held)[1:]) and len(sizes["day=1"]) > 5


def test_a_chain_of_merges_is_doubled(spark):
    edges = spark.createDataFrame([(f"r{i}", f"r{i + 1}", 1) for i in range(64)], "report_id string, reached string, hops int")
    rounds = []
    reach = lineage.doubled(edges, rounds)
    assert reach.count() == 64 * 65 // 2 and len(rounds) <= 9
    assert reach.where("report_id = 'r0' and reached = 'r64'").first().hops == 64


def test_rollup_of_one_range_equals_the_whole(spark, make, tmp_path):
    source, target = str(tmp_path / "s"), str(tmp_path / "t")
    df = make(at("a", 1), at("b", 1, 23), at("c", 2))
    sinks.write_daily(df, source)
    maintain.aggregate_range(spark, source, target, *WHOLE)
    got = spark.read.parquet(f"{target}/rows").drop(*BY)
    want = rollup(df, "day").select(*got.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_a_comparison_shuffles_ids_and_hashes_only(spark, make, tmp_path):
    """The documents of differing partitions were shuffled to find those of differing buckets."""
    left = make(*[report(f"r{i}", lfns=[f"file{i}"]) for i in range(40)])
    right = left.withColumn("wall_s", F.lit(7))
    compared = hashtree.build_and_compare(spark, left, right, str(tmp_path / "trees"))
    assert compared.count() == 40
    plan = compared._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "bucket" not in "".join(x for x in plan.splitlines() if "Exchange" in x)


def test_roll_up_rows_are_not_staged(spark, make, tmp_path, monkeypatch):
    """They were written, read again and only then stored; what is staged now are listings of files."""
    staged = []
    real = maintain.materialise
    monkeypatch.setattr(maintain, "materialise", lambda df, label: staged.append((label, set(df.columns))) or real(df, label))
    source, target = str(tmp_path / "s"), str(tmp_path / "t")
    run = lambda: maintain.aggregate_range(spark, source, target, *WHOLE, metrics=[])
    for day in (1, 2):
        sinks.write_daily(make(at(f"a{day}", day), at(f"b{day}", day)), source)
        run()
    assert stored(spark, target) == [(1, 2), (2, 2)]
    for day in (1, 2):
        delete_path(spark, f"{source}/year=2017/month=1/day={day}")
    assert run() == [(2017, 1, 1), (2017, 1, 2)] and not list((tmp_path / "t" / "rows").rglob("*.parquet"))
    sinks.write_daily(make(at("c", 3)), source)
    assert run() == [(2017, 1, 3)] and stored(spark, target) == [(3, 1)]
    assert staged and all("count" not in columns and "records" not in columns for _, columns in staged)


def test_files_of_a_target_size_are_written_from_staged_files(spark, tmp_path, monkeypatch):
    """All documents were shuffled and sorted twice for it."""
    plans = []
    real = sinks._stretch
    monkeypatch.setattr(sinks, "_stretch", lambda *a: plans.append(real(*a)) or plans[-1])
    df = spark.range(20_000).selectExpr("id", "sha2(string(id), 256) text", "if(id % 10 < 7, 'a b:c', null) day").repartition(5)
    path = str(tmp_path / "t")
    per_file = sinks.write_sized(df, path, 150_000, by=["day"])
    texts = [p._jdf.queryExecution().executedPlan().toString() for p in plans]
    assert len(texts) > 5 and not any("Exchange" in t or "Sort" in t for t in texts)
    back = spark.read.parquet(path)
    assert back.exceptAll(df.select(*back.columns)).isEmpty() and back.count() == 20_000
    counts = back.groupBy("day", F.col("_metadata.file_path").alias("f")).agg(F.count("*").alias("n")).collect()
    for day in ("a b:c", None):
        assert sorted(r.n for r in counts if r.day == day)[1:] == [per_file] * (sum(r.day == day for r in counts) - 1)

"""Scalar functions over table columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from jobledger.functions import scalar
from jobledger.plans.registry import query
from jobledger.sources.archive import archive
from jobledger.sources.tables import table

NOW = 1_000_000_000


@query("f01_document_id", """
  SELECT count(*) AS docs, count(DISTINCT (o_orderkey, o_custkey, o_orderstatus)) AS ids, true AS order_free, 32 AS id_length FROM orders""",
       plain=True)
def document_id(spark, sf):
    rows = table(spark, sf, "orders").select(
        scalar.document_id("o_orderkey", "o_custkey", "o_orderstatus").alias("a"),
        scalar.document_id("o_orderstatus", "o_orderkey", "o_custkey").alias("b"))
    return rows.agg(F.count("*").alias("docs"), F.count_distinct("a").alias("ids"),
                    F.bool_and(F.col("a") == F.col("b")).alias("order_free"), F.max(F.length("a")).alias("id_length"))


@query("f02_date_path", "SELECT strftime(o_orderdate, '%Y/%m/%d') AS path, count(*) AS n FROM orders GROUP BY ALL", plain=True)
def date_path(spark, sf):
    return table(spark, sf, "orders").groupBy(scalar.date_path(F.col("o_orderdate")).alias("path")).agg(F.count("*").alias("n"))


@query("f03_date_range", """
  SELECT o_orderkey, strftime(d, '%Y/%m/%d') AS path FROM (
    SELECT o_orderkey, unnest(generate_series(o_orderdate, o_orderdate + to_days(CAST(o_orderkey % 5 AS INTEGER)), INTERVAL 1 DAY)) AS d FROM orders)""",
       plain=True)
def date_range(spark, sf):
    day = F.to_date("o_orderdate")
    last = F.date_add(day, (F.col("o_orderkey") % 5).cast("int"))
    rows = table(spark, sf, "orders").select("o_orderkey", F.explode(scalar.date_range(day, last)).alias("d"))
    return rows.select("o_orderkey", scalar.date_path(F.col("d")).alias("path"))


@query("f04_epoch_of", f"""
  SELECT text, CASE WHEN text LIKE '%d' THEN {NOW} - CAST(replace(text, 'd', '') AS BIGINT) * 86400
    WHEN length(text) = 8 THEN CAST(epoch(strptime(text, '%Y%m%d')) AS BIGINT) END AS seconds, count(*) AS n
  FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN concat(o_orderkey % 90, 'd')
     WHEN o_orderkey % 3 = 1 AND year(o_orderdate) >= 2000 THEN strftime(o_orderdate, '%Y%m%d') ELSE concat('x', o_orderkey % 7) END AS text FROM orders)
  GROUP BY ALL""", plain=True)
def epoch_of(spark, sf):
    key = F.col("o_orderkey")
    text = (F.when(key % 3 == 0, F.concat(key % 90, F.lit("d")))
            .when((key % 3 == 1) & (F.year("o_orderdate") >= 2000), F.date_format("o_orderdate", "yyyyMMdd"))
            .otherwise(F.concat(F.lit("x"), key % 7)))
    rows = table(spark, sf, "orders").select(text.alias("text"))
    return rows.groupBy("text", scalar.epoch_of(F.col("text"), F.lit(NOW)).alias("seconds")).agg(F.count("*").alias("n"))


@query("f05_pattern_checks", """
  SELECT count(*) FILTER (WHERE year(o_orderdate) >= 2000) AS yyyymmdd, count(*) FILTER (WHERE year(o_orderdate) >= 2000) AS yyyy,
    count(*) AS mm, count(*) AS dd, count(*) AS "float", count(*) AS "int", count(*) AS uid,
    0 AS bad_mm FROM orders""", plain=True)
def patterns(spark, sf):
    day = F.col("o_orderdate")
    good = {
        "yyyymmdd": F.date_format(day, "yyyyMMdd"), "yyyy": F.date_format(day, "yyyy"), "mm": F.date_format(day, "MM"),
        "dd": F.date_format(day, "dd"), "float": F.format_string("%.2f", F.col("o_totalprice")),
        "int": F.col("o_orderkey"), "uid": F.md5(F.col("o_orderkey").cast("string"))}
    counts = [F.count_if(scalar.matches_kind(c, k)).alias(k) for k, c in good.items()]
    bad = F.count_if(scalar.matches_kind(F.date_format(day, "yyyy"), "mm")).cast("int").alias("bad_mm")
    return table(spark, sf, "orders").agg(*counts, bad)


@query("f06_human_size", """
  SELECT o_orderkey, CASE WHEN v < 1000 THEN printf('%3.1f', v) WHEN v < 1e6 THEN printf('%3.1fKB', v / 1e3)
      WHEN v < 1e9 THEN printf('%3.1fMB', v / 1e6) ELSE printf('%3.1fGB', v / 1e9) END AS decimal_size,
    CASE WHEN v < 1024 THEN printf('%3.1f', v) WHEN v < 1048576 THEN printf('%3.1fKiB', v / 1024)
      WHEN v < 1073741824 THEN printf('%3.1fMiB', v / 1048576) ELSE printf('%3.1fGiB', v / 1073741824) END AS binary_size
  FROM (SELECT o_orderkey, CAST(o_orderkey * o_orderkey * 64 AS DOUBLE) AS v FROM orders)""", plain=True)
def human_size(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") * F.col("o_orderkey") * 64).alias("v"))
    return rows.select("o_orderkey", scalar.human_size(F.col("v")).alias("decimal_size"),
                       scalar.human_size(F.col("v"), 2).alias("binary_size"))


@query("f07_human_duration", """
  , p AS (SELECT s, s // 86400 AS d, (s // 3600) % 24 AS h, (s // 60) % 60 AS m, s % 60 AS x FROM (SELECT wall_s * 397 AS s FROM reports)),
  t AS (SELECT s, CASE WHEN d > 1 THEN concat(d, ' days') WHEN d = 1 THEN '1 day' END AS d,
    CASE WHEN h > 1 THEN concat(h, ' hours') WHEN h = 1 THEN '1 hour' END AS h,
    CASE WHEN m > 1 THEN concat(m, ' minutes') WHEN m = 1 THEN '1 minute' END AS m,
    CASE WHEN x > 1 THEN concat(x, ' seconds') WHEN x = 1 THEN '1 second' END AS x FROM p)
  SELECT concat_ws(', ', d, h, m, x) AS duration, count(*) AS n FROM t GROUP BY ALL""")
def human_duration(spark, sf):
    return archive(spark, sf).groupBy(scalar.human_duration(F.col("wall_s") * 397).alias("duration")).agg(F.count("*").alias("n"))


@query("f08_buckets", """
  SELECT p AS precision, strftime(date_trunc(p, ts), '%Y-%m-%d %H:%M:%S') AS "start",
    strftime(date_trunc(p, ts) + CASE p WHEN 'hour' THEN INTERVAL 1 HOUR WHEN 'day' THEN INTERVAL 1 DAY
      WHEN 'week' THEN INTERVAL 7 DAY ELSE INTERVAL 1 MONTH END, '%Y-%m-%d %H:%M:%S') AS "end", count(*) AS n
  FROM events, (VALUES ('hour'), ('day'), ('week'), ('month')) v(p) GROUP BY ALL""", plain=True)
def buckets(spark, sf):
    precisions = ["hour", "day", "week", "month"]
    pairs = [F.struct(F.lit(p).alias("precision"), scalar.bucket_start(F.col("ts"), p).alias("start"),
                      scalar.bucket_end(scalar.bucket_start(F.col("ts"), p), p).alias("end")) for p in precisions]
    rows = table(spark, sf, "events").select(F.explode(F.array(*pairs)).alias("b"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return rows.groupBy("b.precision", text("b.start").alias("start"), text("b.end").alias("end")).agg(F.count("*").alias("n"))


@query("f09_iso_timestamp", "SELECT event_id, concat(strftime(ts, '%Y-%m-%dT%H:%M:%S.'), lpad(CAST(millisecond(ts) % 1000 AS VARCHAR), 3, '0'), 'Z') AS iso FROM events",
       plain=True)
def iso(spark, sf):
    return table(spark, sf, "events").select("event_id", scalar.iso_ts(F.col("ts")).alias("iso"))


@query("f10_cutoff", """
  SELECT interval_text, strftime(TIMESTAMP '2017-01-20 06:00:00' - CASE
      WHEN interval_text LIKE '%h' THEN to_hours(n) WHEN interval_text LIKE '%d' THEN to_days(n) ELSE to_days(n * 35) END,
    '%Y-%m-%d %H:%M:%S') AS cutoff, count(*) AS rows
  FROM (SELECT CAST(o_orderkey % 50 AS INTEGER) AS n, concat(o_orderkey % 50, CASE o_orderkey % 3 WHEN 0 THEN 'h' WHEN 1 THEN 'd' ELSE 'm' END) AS interval_text FROM orders)
  GROUP BY ALL""", plain=True)
def cutoffs(spark, sf):
    key = F.col("o_orderkey")
    text = F.concat(key % 50, F.element_at(F.array(F.lit("h"), F.lit("d"), F.lit("m")), (key % 3 + 1).cast("int")))
    now = F.lit("2017-01-20 06:00:00").cast("timestamp_ntz")
    rows = table(spark, sf, "orders").select(text.alias("interval_text"))
    cut = F.date_format(scalar.cutoff_column(F.col("interval_text"), now), "yyyy-MM-dd HH:mm:ss")
    return rows.groupBy("interval_text", cut.alias("cutoff")).agg(F.count("*").alias("rows"))


@query("f12_extension_class", """
  SELECT CASE WHEN bool_and(file LIKE '%root') THEN 'root' WHEN bool_and(file LIKE '%tar.gz') THEN 'log' END AS class, count(*) AS n
  FROM (SELECT report_id, string_agg(file, '|') AS f, bool_and(file LIKE '%.root') AS r, bool_and(file LIKE '%.tar.gz') AS t,
          any_value(file) AS file FROM lfns WHERE i = 2 GROUP BY report_id) GROUP BY file LIKE '%x'""")
def extension(spark, sf):
    logs = F.slice("lfns", 3, 1)
    return archive(spark, sf).groupBy(scalar.file_class(logs).alias("class")).agg(F.count("*").alias("n"))


@query("f12_extension_class_mixed", """
  SELECT CASE k WHEN 0 THEN 'root' WHEN 1 THEN 'log' END AS class, count(*) AS n
  FROM reports, (VALUES (0), (1), (2)) v(k) GROUP BY k""")
def extension_mixed(spark, sf):
    lists = F.array(F.array(F.get("lfns", F.lit(0)), F.get("lfns", F.lit(3))), F.slice("lfns", 3, 1), F.col("lfns"))
    rows = archive(spark, sf).select(F.explode(lists).alias("files"))
    return rows.groupBy(scalar.file_class(F.col("files")).alias("class")).agg(F.count("*").alias("n"))


@query("f14_format_metric", """
  SELECT o_orderkey, concat(v // 3600, ':', lpad(CAST((v // 60) % 60 AS VARCHAR), 2, '0'), ':', lpad(CAST(v % 60 AS VARCHAR), 2, '0'),
      ' (', v, '.0s)') AS seconds, concat(v % 100, '%') AS share,
    CASE WHEN v < 1000 THEN concat(v, ' MB') ELSE concat(rtrim(rtrim(printf('%.2f', ((v + 5) // 10) / 100.0), '0'), '.'), ' GB') END AS size,
    CASE WHEN v < 1000 THEN concat(v, '') ELSE concat(rtrim(rtrim(printf('%.2f', ((v + 5) // 10) / 100.0), '0'), '.'), 'k') END AS plain
  FROM (SELECT o_orderkey, o_orderkey % 2000 * 5 + 10 AS v FROM orders WHERE (o_orderkey % 2000 * 5 + 10) > 0)""", plain=True)
def formats(spark, sf):
    v = F.col("v")
    rows = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 2000 * 5 + 10).alias("v"))
    return rows.select(
        "o_orderkey", scalar.format_metric(v, F.lit("s")).alias("seconds"), scalar.format_metric(v % 100, F.lit("%")).alias("share"),
        scalar.format_metric(v, F.lit("MB")).alias("size"), scalar.format_metric(v, F.lit("")).alias("plain"))


@query("f15_scope_json", """
  SELECT json_extract_string(j, '$.start_date') AS start_date, json_extract_string(j, '$.status') AS status, count(*) AS n
  FROM (SELECT to_json(struct_pack(start_date := strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S'), status := nullif(o_orderstatus, 'P'))) AS j FROM orders)
  GROUP BY ALL""", plain=True)
def scope_json(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderdate").alias("start_date"), F.nullif("o_orderstatus", F.lit("P")).alias("status"))
    text = rows.select(scalar.scope_json("status", "start_date").alias("j"))
    return text.groupBy(F.get_json_object("j", "$.start_date").alias("start_date"),
                        F.get_json_object("j", "$.status").alias("status")).agg(F.count("*").alias("n"))

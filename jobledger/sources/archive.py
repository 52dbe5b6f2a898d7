"""The report archive that the registered queries read.

Reports are derived from the tables once per session and written to the shared
folder, month-partitioned.  Narrow source rows are rebalanced by month *before*
the documents are built, so the shuffle moves eleven short columns rather than
nested documents, and a month that holds most rows is split over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from jobledger.operators.lineage import Lineage, read_lineage, store_lineage
from jobledger.operators.rollup import closed, rollup
from jobledger.schema import REPORT_DDL
from jobledger.session import CODEC, DOCUMENTS, new_dir, settings, unsorted_folders
from jobledger.sources.reports import read_reports
from jobledger.sources.tables import (
    log_collect_reports, merge_reports, processing_reports, table,
)

_ROOTS: dict[tuple[str, str], str] = {}
_WRITTEN: set[str] = set()
LAYOUT = ["year", "month"]


def _rebalanced(df: DataFrame, date: str) -> DataFrame:
    return (df.withColumn("_month", F.date_trunc("month", F.col(date)))
              .hint("rebalance", F.col("_month")).drop("_month"))


def _write(spark: SparkSession, sf_dir: str, part: str) -> str:
    root = _ROOTS.setdefault((spark.sparkContext.applicationId, sf_dir), new_dir(spark, "archive"))
    path = f"{root}/part={part}"
    if path not in _WRITTEN:
        if part == "processing":
            lines = _rebalanced(table(spark, sf_dir, "lineitem"), "l_shipdate")
            # Reports of a day and of a part lie together: their files compress better.
            df = processing_reports(lines, table(spark, sf_dir, "nation"), ["day_no", "pk"])
        else:
            orders = _rebalanced(table(spark, sf_dir, "orders"), "o_orderdate")
            df = merge_reports(orders).unionByName(log_collect_reports(orders))
        # A document is about eight times the size of its source row, so a task
        # gets an eighth of the usual bytes.
        with unsorted_folders(spark), settings(spark, spark__sql__codegen__hugeMethodLimit="8000",
                      spark__sql__adaptive__advisoryPartitionSizeInBytes="16m",
                      spark__sql__adaptive__coalescePartitions__minPartitionSize="128k"):
            df.write.mode("overwrite").options(**DOCUMENTS).partitionBy(*LAYOUT).parquet(path)
        _WRITTEN.add(path)
    return path


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processing reports."""
    return read_reports(spark, _write(spark, sf_dir, "processing"))


def daily_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored day roll-up of the processing reports, with all metrics; written once per session.

    Partitioned by month and sorted by day within, so a time frame prunes
    folders and then row groups.
    """
    reports = archive(spark, sf_dir)
    path = f"{_ROOTS[(spark.sparkContext.applicationId, sf_dir)]}-rollup"
    if path not in _WRITTEN:
        rows = rollup(reports, "day")
        # What follows from the start of a bucket is added behind the shuffle.
        narrow = rows.drop("end_date", "precision").withColumns({"year": F.year("start_date"), "month": F.month("start_date")})
        spread = narrow.hint("rebalance", "year", "month").sortWithinPartitions("year", "month", "start_date")
        (closed(spread, "day", [*rows.columns, *LAYOUT])
             .write.mode("overwrite").option("compression", CODEC).partitionBy(*LAYOUT).parquet(path))
        _WRITTEN.add(path)
    return spark.read.parquet(path)


def stored_lineage(spark: SparkSession, sf_dir: str) -> Lineage:
    """The edges of all reports, written once per session."""
    reports = full_archive(spark, sf_dir)
    path = f"{_ROOTS[(spark.sparkContext.applicationId, sf_dir)]}-lineage"
    if path not in _WRITTEN:
        store_lineage(reports, path)
        _WRITTEN.add(path)
    return read_lineage(spark, path)


def stream_archive(spark: SparkSession, sf_dir: str, files_per_batch: int | None = None) -> DataFrame:
    """Processing reports as a stream of arriving files."""
    reader = spark.readStream.schema(REPORT_DDL)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(_write(spark, sf_dir, "processing"))


def full_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processing, merge and log-collect reports, as one scan of two folders."""
    paths = [_write(spark, sf_dir, "processing"), _write(spark, sf_dir, "service")]
    root = _ROOTS[(spark.sparkContext.applicationId, sf_dir)]
    return read_reports(spark, paths, basePath=root).drop("part")

"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "jobledger", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine is designed for.

    Adaptive execution does the runtime work: it coalesces small shuffle
    partitions, splits skewed ones and turns a join into a broadcast join once
    the measured size allows it.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Methods above 8000 bytes are never compiled by the JVM; wide nested
        # projections are faster as several smaller generated methods.
        "spark.sql.codegen.hugeMethodLimit": "8000",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder; a cluster session
    without the setting is an error, because executors would not see the files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    named = tempfile.mkdtemp(prefix="jobledger-")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def new_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; nothing is created yet."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


@contextmanager
def settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Run actions under other SQL settings (``__`` stands for a dot), then put them back."""
    names = {key.replace("__", "."): value for key, value in conf.items()}
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


# Folders a task writes to at once before its rows are sorted by folder.
OPEN_FOLDERS = "100"


@contextmanager
def unsorted_folders(spark: SparkSession) -> Iterator[None]:
    """Write partition folders without sorting whole documents in each task.

    A task keeps a file open per folder instead, so nothing spills however many documents it
    writes; only a task that meets more than ``OPEN_FOLDERS`` sorts the rest.
    """
    with settings(spark, spark__sql__maxConcurrentOutputFileWriters=OPEN_FOLDERS):
        yield


# Of Parquet files; documents take about two thirds of what Spark's default leaves.
CODEC = "zstd"
# Options of Parquet files of whole documents.  Looking each of their many small values up in a dictionary takes a third of
# the time of writing them, and zstandard finds what repeats by itself.
DOCUMENTS = {"compression": CODEC, "parquet.compression.codec.zstd.level": "9", "parquet.enable.dictionary": "false"}
_STAGED: list[list[str]] = []


def staged_dir(spark: SparkSession, label: str) -> str:
    """A fresh path that goes with the staged tables, where there are any."""
    path = new_dir(spark, label)
    if _STAGED:
        _STAGED[-1].append(path)
    return path


def materialise(df: DataFrame, label: str = "table", options: dict[str, str] | None = None) -> DataFrame:
    """Write a result to the shared folder and read it back: short lineage that outlives executors; ``options`` are those of its files."""
    path = staged_dir(df.sparkSession, label)
    df.write.options(**(options or {"compression": CODEC})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on whatever file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def read_or_none(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame | None:
    """The table at a path, or None before its first write."""
    if not exists(spark, path):
        return None
    try:
        return spark.read.format(fmt).load(path)
    except AnalysisException as problem:
        if problem.getCondition() == "UNABLE_TO_INFER_SCHEMA":  # a folder without files
            return None
        raise


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a file or folder of whatever file system holds it; one that is not there is no error."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Tables materialised inside are deleted at the end: for work whose result is written elsewhere."""
    _STAGED.append([])
    try:
        yield
    finally:
        for path in _STAGED.pop():
            delete_path(spark, path)

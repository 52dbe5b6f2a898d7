"""Which ids a stored table holds: an index beside the table, so that an append never reads the table itself.

``<table>/_ids`` has a row per id and file, in folders by part and hash bucket;
``<table>/_covered`` names the files each part has read and is written after
it, so a part counts once it is whole.  Both names are hidden from readers of the table.
The index follows the files: what any writer adds is read once, by its id column, and
ids of files that are gone count no more.
"""

from __future__ import annotations

import uuid
from collections.abc import Collection

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from jobledger.session import delete_path, read_or_none

BUCKETS = 8
# Parts beyond this number are put together.
MOST_PARTS = 16


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _mark(path: str) -> str:
    """What stands before a file's place in the table, its partition folders and name."""
    return f"/{path.rstrip('/').rsplit('/', 1)[-1]}/"


def _parts(spark: SparkSession, path: str) -> dict[str, set[str]]:
    """Files by part, of whole parts; the driver lists a table's files anyway when it reads it."""
    covered = read_or_none(spark, f"{path}/_covered")
    parts: dict[str, set[str]] = {}
    for r in covered.select("part", "file").collect() if covered is not None else ():
        parts.setdefault(r.part, set()).add(r.file)
    return parts


def refresh(spark: SparkSession, path: str, key: str, buckets: int = BUCKETS) -> DataFrame | None:
    """Add the ids of files the index has not seen, of which only the id column is read; gives the live index."""
    table = read_or_none(spark, path)
    if table is None:
        return None
    parts = _parts(spark, path)
    mark = _mark(path)
    files = {f.rsplit(mark, 1)[-1]: f for f in table.inputFiles()}
    known = set().union(*parts.values())
    fresh = {name: uri for name, uri in files.items() if name not in known}
    if fresh:
        rows = spark.read.schema(table.schema).parquet(*fresh.values()).select(
            F.col(key).cast("string").alias("id"), F.substring_index("_metadata.file_path", mark, -1).alias("file"))
        part = _write_part(rows.where("id is not null"), list(fresh), path, buckets)
        parts[part] = set(fresh)
    live = _live(spark, path, parts, files.keys())
    if len(parts) > MOST_PARTS:
        return compact(spark, path, live, parts, files.keys(), buckets)
    return live


def _write_part(rows: DataFrame, files: list[str], path: str, buckets: int) -> str:
    part = uuid.uuid4().hex
    rows = rows.withColumn("bucket", _bucket(F.col("id"), buckets)).repartition("bucket")
    rows.write.option("parquet.bloom.filter.enabled#id", "true").partitionBy("bucket").parquet(f"{path}/_ids/part={part}")
    covered = rows.sparkSession.createDataFrame([(f,) for f in files], "file string")
    covered.coalesce(1).write.parquet(f"{path}/_covered/part={part}")
    return part


def _live(spark: SparkSession, path: str, parts: dict[str, set[str]], files: Collection[str]) -> DataFrame:
    """Rows of whole parts whose file is still there."""
    index = spark.read.option("basePath", f"{path}/_ids").schema("id string, file string, bucket int, part string").parquet(
        *[f"{path}/_ids/part={p}" for p in parts])
    gone = set().union(*parts.values()).difference(files)
    return index if not gone else index.join(spark.createDataFrame([(f,) for f in gone], "file string"), "file", "left_anti")


def stored(index: DataFrame, ids: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The ids of a one-column table that the index has.

    Both sides carry the bucket.  The ids are the small side: Spark sends them to
    the index where their measured size allows it, and then skips the buckets that hold none.
    """
    wanted = ids.toDF("id").withColumn("id", F.col("id").cast("string"))
    wanted = wanted.withColumn("bucket", _bucket(F.col("id"), buckets))
    return index.join(wanted, ["bucket", "id"], "left_semi").select("id").distinct()


def holds(spark: SparkSession, path: str, key: str, ids: list[str], buckets: int = BUCKETS) -> list[str]:
    """Which of a few ids are stored; the list reaches the scan, whose buckets and Bloom filters skip files."""
    index = refresh(spark, path, key, buckets)
    if index is None or not ids:
        return []
    touched = {r.b for r in spark.createDataFrame([(i,) for i in ids], "id string").select(_bucket(F.col("id"), buckets).alias("b")).collect()}
    return sorted(r.id for r in index.where(F.col("bucket").isin(*touched) & F.col("id").isin(*ids)).select("id").distinct().collect())


def compact(spark: SparkSession, path: str, live: DataFrame, parts: dict[str, set[str]], files: Collection[str], buckets: int = BUCKETS) -> DataFrame:
    """All live rows as one part; the parts it replaces go once it is whole."""
    held = sorted(set().union(*parts.values()).intersection(files))
    part = _write_part(live.select("id", "file"), held, path, buckets)
    for old in parts:
        delete_path(spark, f"{path}/_covered/part={old}")
        delete_path(spark, f"{path}/_ids/part={old}")
    return _live(spark, path, {part: set(held)}, files)

"""Writing reports, roll-ups and results."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from collections import Counter
from dataclasses import dataclass
from functools import reduce
from itertools import groupby
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from jobledger.schema import PARTITION_COLUMNS
from jobledger.session import DOCUMENTS, materialise, read_or_none, settings, staged_dir, staging, unsorted_folders
from jobledger.sources import idindex

# Fixed value: documents above 10 MB are not published.
MAX_DOCUMENT_BYTES = 10 * 1024 * 1024
# Site tiers a topic can stand for.
SITE_TIERS = ["T1_", "T2_", "T3_"]


def write(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "append", n: int | None = None,
          max_records: int | None = None, compression: str | None = None,
          partition_by: list[str] | None = None) -> None:
    """Write a DataFrame, optionally in n partitions or with a row limit per file; compressed unless told otherwise, folders without a sort."""
    known = DOCUMENTS if fmt == "parquet" and compression is None else {}
    compression = compression or {"json": "gzip"}.get(fmt)
    if n:
        # Whole documents stay where they are if there are tasks enough to put together.
        df = df.coalesce(n) if df.rdd.getNumPartitions() >= n else df.repartition(n)
    writer = df.write.format(fmt).mode(mode).options(**known)
    if compression:
        writer = writer.option("compression", compression)
    if max_records:
        writer = writer.option("maxRecordsPerFile", max_records)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with unsorted_folders(df.sparkSession):
        writer.save(path)


def new_rows(df: DataFrame, target: DataFrame | None, key: str) -> DataFrame:
    """First row per key, without the keys the target already has.

    Rows without a key are no copies of each other: all of them are new.
    """
    keyed = df.where(F.col(key).isNotNull()).dropDuplicates([key])
    if target is not None:
        keyed = keyed.join(target.select(key), key, "left_anti").select(*df.columns)
    return keyed.unionByName(df.where(F.col(key).isNull()))


@dataclass(frozen=True)
class Append:
    """What an append will do: rows that arrived, ids among them that are new, and the rows to write."""

    arrived: int
    new: int
    rows: DataFrame | None


# An id table of up to this measured size is sent to the documents, so that these stay where they are.
SENT_IDS = "64m"
# So are the bits of rows to leave out, one per row of a batch: these are a thousand million rows.
SENT_BITS = "128m"


def plan_append(df: DataFrame, path: str, key: str = "report_id", order: tuple[str, ...] = ("ingest_ts",)) -> Append:
    """The rows of a batch whose id the table at ``path`` does not have, one per id.

    Ids are compared with the index beside the table (``idindex``), and only ids,
    hashes and row numbers are shuffled for it.  What is left out are bits by row number, which ``store``
    sends to the documents, so that these stay where they are however many ids are known.  Of rows with one id the earliest by
    ``order`` (the columns the batch has) counts, then the one with the smallest hash, then the first.  Rows
    without an id are no copies of each other: all are new.  The batch must come out in the same
    order each time it is read, as written tables do.
    """
    spark = df.sparkSession
    index = idindex.refresh(spark, path, key)
    ids = df.groupBy(key).agg(F.count("*").alias("n"))
    if index is None:
        ids = ids.withColumn("known", F.lit(False))
    else:
        ids = materialise(ids, "ids")
        there = idindex.stored(index, ids.where(F.col(key).isNotNull()).select(key))
        there = there.select(F.col("id").cast(ids.schema[key].dataType).alias(key), F.lit(True).alias("known"))
        ids = ids.join(there, key, "left").withColumn("known", F.coalesce("known", F.lit(False)))
    ids = materialise(ids, "ids")
    several = F.col(key).isNotNull() & (F.col("n") > 1) & ~F.col("known")
    new = F.when(F.col("known"), 0).when(several, 1).otherwise(F.col("n"))
    told = ids.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("arrived"), F.coalesce(F.sum(new), F.lit(0)).alias("new"),
                   F.count_if("known").alias("known"), F.count_if(several).alias("several")).first()
    if not told.new:
        return Append(told.arrived, 0, None)
    row = "_row_in_batch"
    rows = df.withColumn(row, F.monotonically_increasing_id())
    gone = []
    if told.several:
        place = F.struct(*[F.col(c) for c in order if c in df.columns], F.xxhash64(*df.columns), F.col(row).alias("at"))
        with settings(spark, spark__sql__legacy__allowHashOnMapType="true"):
            contested = rows.select(key, place.alias("place")).join(ids.where(several).select(key), key, "left_semi")
            contested = materialise(contested, "contested")
        first = contested.groupBy(key).agg(F.min("place").alias("first")).select(F.col("first.at").alias(row))
        gone.append(contested.select(F.col("place.at").alias(row)).join(first, row, "left_anti"))
    if told.known:
        gone.append(rows.select(key, row).join(ids.where("known").select(key), key, "left_semi").select(row))
    if gone:
        rows = without_rows(rows, row, reduce(DataFrame.unionByName, gone))
    return Append(told.arrived, told.new, rows.select(*df.columns))


def without_rows(df: DataFrame, row: str, gone: DataFrame) -> DataFrame:
    """The rows whose number in ``row`` the one column of ``gone`` does not have, which is staged as one bit per row."""
    number = F.col(row) + 1
    bits = gone.groupBy(F.bitmap_bucket_number(number).alias("_block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("_bits"))
    bits = materialise(bits, "gone")
    at = f"bitmap_bit_position(`{row}` + 1)"
    marked = f"shiftright(cast(conv(hex(substring(_bits, cast({at} div 8 as int) + 1, 1)), 16, 10) as int), cast({at} % 8 as int)) & 1 = 1"
    return df.join(bits, F.expr(f"bitmap_bucket_number(`{row}` + 1) = _block and {marked}"), "left_anti")


def store(plan: Append, path: str, partition_by: list[str] | None = None) -> None:
    """Write the rows of an append, with the bits of those to leave out sent to the documents."""
    if plan.rows is not None:
        with settings(plan.rows.sparkSession, spark__sql__autoBroadcastJoinThreshold=SENT_BITS,
                      spark__sql__adaptive__autoBroadcastJoinThreshold=SENT_BITS):
            write(plan.rows, path, partition_by=partition_by)


def append_new(df: DataFrame, path: str, key: str = "report_id", partition_by: list[str] | None = None,
               replayable: bool = False) -> Append:
    """Append documents whose id is not stored yet, wherever it is stored.

    The batch is staged first, so that it is computed once although it is read
    several times; ``replayable`` says that it comes out the same each time, in the same order, as files do, and
    saves that copy.  Staged tables are deleted at the end.
    """
    spark = df.sparkSession
    with staging(spark), settings(spark, spark__sql__adaptive__autoBroadcastJoinThreshold=SENT_IDS):
        batch = df if replayable else materialise(df, "batch")
        plan = plan_append(batch, path, key)
        store(plan, path, partition_by)
    return plan


def upsert_rollup(df: DataFrame, path: str) -> None:
    """Store roll-up rows by day; a stored row of the same scope hash is replaced.

    Only the days that occur in ``df`` are read and rewritten: a scope hash
    holds its bucket's start, so a row can have no other day.
    """
    day = F.to_date("start_date")
    rows = materialise(df.withColumn("day", day), "rollup")
    target = read_or_none(df.sparkSession, path)
    if target is not None:
        touched = target.join(rows.select("day").distinct(), "day", "left_semi")
        kept = touched.join(rows.select("hash"), "hash", "left_anti")
        rows = materialise(rows.unionByName(kept, allowMissingColumns=True), "rollup")
    replace_partitions(rows, path, ["day"])


# Rows are written from where they lie if a folder gets this many files on average at most, or a file this many rows on average.
FILES_PER_FOLDER = 4
ROWS_PER_FILE = 2_500


def together(df: DataFrame, by: list[str]) -> DataFrame:
    """The rows as they are if each task has few folders of its own, as those of a table in a like layout, or many rows of each; else rebalanced by folder.

    Only the folder columns are read for that.  Many tasks read a folder of a large table, so its files are not
    too many as long as they are large.  The rebalance hint lets adaptive execution split a folder that is far larger
    than the others over several tasks and put small ones together, but it shuffles whole documents.
    """
    if not df.isStreaming:
        pairs = df.groupBy(*by, F.spark_partition_id().alias("_task")).agg(F.count("*").alias("_n"))
        told = pairs.agg(F.count("*").alias("pairs"), F.count_distinct(F.struct(*by)).alias("folders"), F.sum("_n").alias("rows")).first()
        if told.pairs <= FILES_PER_FOLDER * told.folders or told.rows >= ROWS_PER_FILE * told.pairs:
            return df
    return df.hint("rebalance", *[F.col(c) for c in by])


def replace_partitions(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Replace exactly the partitions (days by default) that occur in ``df``; others stay."""
    by = by or PARTITION_COLUMNS
    with unsorted_folders(df.sparkSession):
        (together(df, by).write.mode("overwrite").options(**DOCUMENTS)
           .option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path))


def write_validated(df: DataFrame, root: str) -> None:
    """Rows without errors to ``outcome=good``, the rest with their errors to ``outcome=bad``, in one pass."""
    outcome = F.when(F.size("errors") == 0, "good").otherwise("bad")
    df.withColumn("outcome", outcome).write.mode("append").partitionBy("outcome").parquet(root)


def write_daily(df: DataFrame, root: str, skip_existing: bool = False,
                by: list[str] | None = None, mode: str = "append") -> None:
    """Date-partitioned layout, one or few files per day."""
    by = by or PARTITION_COLUMNS
    if skip_existing:
        stored = read_or_none(df.sparkSession, root)
        if stored is not None:
            df = df.join(stored.select(*by).distinct(), by, "left_anti")
    with unsorted_folders(df.sparkSession):
        together(df, by).write.mode(mode).options(**DOCUMENTS).partitionBy(*by).parquet(root)


# Files written by one job of ``write_sized``, each by a task of its own.
FILES_PER_JOB = 64


def write_sized(df: DataFrame, path: str, target_bytes: int, by: list[str] | None = None, mode: str = "append") -> int:
    """Partitioned layout whose files have about ``target_bytes``, all but the last one of each partition; gives the rows of a file.

    The rows are staged in the same layout, in smaller files; a line through the sizes and row counts of these, and of one file
    that is written of them on trial, gives the bytes of a row and of an empty file.  A row's place in its partition is its place in
    its staged file behind the rows of the files before.  A file is a stretch of places, written by a task that reads the
    staged files of its stretch one after the other, so no document is shuffled or sorted.  Only the names and counts of staged files reach the driver.
    """
    by = by or PARTITION_COLUMNS
    spark = df.sparkSession
    with staging(spark):
        staged = staged_dir(spark, "sized")
        write_daily(df, staged, by=by)
        fields = [f.name for f in df.schema.fields if f.name not in by]
        table = spark.read.schema(df.schema).parquet(staged)
        name, size = F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_size").alias("_size")
        files = table.groupBy(*by, name, size).agg(F.count("*").alias("_n")).orderBy(*by, "_f").collect()
        if not files:
            return 1
        points = [(f["_n"], f["_size"]) for f in files]
        per_file = _rows_for(points, target_bytes)
        trial = staged_dir(spark, "trial")
        most = Counter()
        for f in files:
            most[tuple(f[c] for c in by)] += f["_n"]
        largest = [f for f in files if tuple(f[c] for c in by) == most.most_common(1)[0][0]]
        _stretch(spark, df.schema, largest, 0, per_file, fields).write.options(**DOCUMENTS).parquet(trial)
        tried = spark.read.parquet(trial).groupBy(size).agg(F.count("*").alias("_n")).first()
        if tried["_n"] >= per_file / 2:
            # Of the trial's rows nearly as many are a file; what an empty file takes is as told by the line.
            base = min(_line(points)[1], tried["_size"] / 2)
            per_file = max(1, round((target_bytes - base) * tried["_n"] / (tried["_size"] - base)))
        stretches = []
        for _, group in groupby(files, key=lambda f: tuple(f[c] for c in by)):
            group = list(group)
            for first in range(0, sum(f["_n"] for f in group), per_file):
                stretches.append(_stretch(spark, df.schema, group, first, per_file, [*fields, *by]))
        # What is overwritten has to be known to one job.
        several = FILES_PER_JOB if mode == "append" else len(stretches)
        for k in range(0, len(stretches), several):
            # A union of single tasks would be one task otherwise.
            with unsorted_folders(spark), settings(spark, spark__sql__unionOutputPartitioning="false"):
                (reduce(DataFrame.unionByName, stretches[k:k + several]).write.mode(mode)
                    .options(**DOCUMENTS).option("maxRecordsPerFile", per_file).partitionBy(*by).parquet(path))
    return per_file


def _line(points: list[tuple[int, int]]) -> tuple[float, float]:
    """Bytes of a row and of an empty file: the line through row counts and sizes of files, or their mean where there is none."""
    rows, sizes = sum(n for n, _ in points), sum(s for _, s in points)
    mean_n, mean_s = rows / len(points), sizes / len(points)
    spread = sum((n - mean_n) ** 2 for n, _ in points)
    slope = sum((n - mean_n) * (s - mean_s) for n, s in points) / spread if spread else 0.0
    base = mean_s - slope * mean_n
    return (slope, base) if slope > 0 and base >= 0 else (sizes / rows, 0.0)


def _rows_for(points: list[tuple[int, int]], target_bytes: int) -> int:
    slope, base = _line(points)
    return max(1, round((target_bytes - base) / slope if base < target_bytes / 2 else target_bytes * sum(n for n, _ in points) / sum(s for _, s in points)))


def _stretch(spark: SparkSession, schema: StructType, files: list, first: int, n: int, columns: list[str]) -> DataFrame:
    """The ``n`` rows of a partition from place ``first`` on, read by one task; ``files`` are its staged files in order, with their row counts."""
    parts, before = [], 0
    for f in files:
        low, high = max(first - before, 0), min(first + n - before, f["_n"])
        if low < high:
            parts.append((unquote(f["_f"]), low, high, f["_n"]))
        before += f["_n"]
    whole = [f for f, low, high, rows in parts if (low, high) == (0, rows)]
    plain = StructType([f for f in schema.fields if f.name in columns and f.name not in files[0].__fields__[:-3]])
    read = spark.read.schema(plain)
    row = F.col("_metadata.row_index")
    cut = [read.parquet(f).where((row >= low) & (row < high)) for f, low, high, rows in parts if (low, high) != (0, rows)]
    rows = reduce(DataFrame.unionByName, [*([read.parquet(*whole)] if whole else []), *cut])
    folders = {c: F.lit(files[0][c]).cast(schema[c].dataType) for c in files[0].__fields__[:-3] if c in columns}
    return rows.coalesce(1).withColumns(folders) if folders else rows.coalesce(1)


def check_copy(source: DataFrame, copy: DataFrame, key: str = "report_id") -> DataFrame:
    """Per day: rows in source and copy, and whether the ids agree."""
    def per_day(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*PARTITION_COLUMNS).agg(
            F.count("*").alias(f"{name}_rows"),
            F.sum(F.xxhash64(key).cast("decimal(38,0)")).alias(f"{name}_sum"))

    joined = per_day(source, "source").join(per_day(copy, "copy"), PARTITION_COLUMNS, "full_outer")
    return joined.select(
        *PARTITION_COLUMNS,
        F.coalesce("source_rows", F.lit(0)).alias("source_rows"),
        F.coalesce("copy_rows", F.lit(0)).alias("copy_rows"),
        (F.col("source_rows").eqNullSafe(F.col("copy_rows"))
         & F.col("source_sum").eqNullSafe(F.col("copy_sum"))).alias("same"))


def dump(df: DataFrame, n: int, path: str) -> None:
    """The first n rows as JSON lines."""
    df.limit(n).write.mode("overwrite").json(path)


def convert(spark: SparkSession, source: str, target: str, schema: str | None,
            source_fmt: str = "json", target_fmt: str = "parquet") -> None:
    """Copy a table from one file format to another."""
    reader = spark.read.format(source_fmt)
    if schema:
        reader = reader.schema(schema)
    reader.load(source).write.format(target_fmt).mode("overwrite").save(target)


def query_id(spec: dict, fields: list[str] | None = None) -> str:
    """Id of a query: md5 of its canonical JSON."""
    return hashlib.md5(json.dumps({"spec": spec, "fields": fields or []}, sort_keys=True).encode()).hexdigest()


def save_result(df: DataFrame, path: str, qid: str, etime: float = 0.0, ts: float | None = None) -> None:
    """Store a result under its query id; saving again replaces it."""
    ts = dt.datetime.now(dt.timezone.utc).timestamp() if ts is None else ts
    rows = df.select(F.lit(qid).alias("query_id"), F.lit(float(ts)).alias("ts"), F.lit(float(etime)).alias("etime"),
                     F.lit("job").alias("kind"), F.to_json(F.struct("*")).alias("payload"))
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("query_id").parquet(path))


def get_result(spark: SparkSession, path: str, qid: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("query_id") == qid)


def list_results(spark: SparkSession, path: str) -> DataFrame:
    """Ids of the stored results; they are folder names, so no column of a result is read."""
    return spark.read.parquet(path).select("query_id").distinct()


def topics_of(site: Column, exit_code: Column, topics: list[str], default: str | None) -> Column:
    """The topics a flat record belongs to.

    A topic named after a site tier takes records of that tier, a topic with
    ``exitCode`` in its name takes failures, those without a number too; the default topic takes all.
    """
    chosen = []
    for topic in topics:
        if topic == default:
            continue
        tests = [site.contains(tier) for tier in SITE_TIERS if tier in topic]
        if "exitCode" in topic:
            tests.append((exit_code > 0) | exit_code.isNull())
        for test in tests[:1]:
            for other in tests[1:]:
                test = test | other
            chosen.append(F.when(test, F.lit(topic)))
    if default:
        chosen.append(F.lit(default))
    return F.filter(F.array(*chosen), lambda t: t.isNotNull()) if chosen else F.array().cast("array<string>")


def route(df: DataFrame, topics: list[str], default: str | None = None) -> DataFrame:
    """One row per record and topic."""
    return df.withColumn("topic", F.explode(topics_of(F.col("site"), F.col("exitCode"), topics, default)))


def write_topics(df: DataFrame, path: str) -> None:
    """Routed records as compressed JSON messages, one folder per topic."""
    fields = [c for c in df.columns if c != "topic"]
    df.select("topic", F.to_json(F.struct(*fields)).alias("value")).write.mode("append").option("compression", "gzip").partitionBy("topic").json(path)


def _document_bytes(df: DataFrame) -> Column:
    return F.octet_length(F.to_json(F.struct(*[F.col(c) for c in df.columns])))


def publishable(df: DataFrame, max_bytes: int = MAX_DOCUMENT_BYTES) -> DataFrame:
    """Documents small enough to publish, with a numeric copy of the arrival time."""
    return df.where(_document_bytes(df) <= max_bytes).withColumn("wmats_num", F.col("ingest_ts").cast("bigint"))


def oversized(df: DataFrame, max_bytes: int = MAX_DOCUMENT_BYTES) -> DataFrame:
    """Id and size of the documents that :func:`publishable` leaves out."""
    size = _document_bytes(df)
    return df.where(size > max_bytes).select("report_id", size.cast("bigint").alias("n_bytes"))

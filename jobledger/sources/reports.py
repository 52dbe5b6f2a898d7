"""Reading archived reports."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from jobledger.functions.scalar import document_id, let, parse_day
from jobledger.schema import DOCUMENT_DDL, METRICS, REPORT_DDL, STEPS


def read_reports(spark: SparkSession, paths: str | list[str], schema: str | None = REPORT_DDL,
                 fmt: str = "parquet", **options: str) -> DataFrame:
    """Scan one or several report folders as one source with an explicit schema.

    JSON may be gzip- or bzip2-compressed; lines that do not parse are kept in
    the column ``_corrupt``.
    """
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        if fmt == "json":
            schema += ", _corrupt string"
            reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
        reader = reader.schema(schema)
    return reader.load(paths)


def normalise_sites(site: Column) -> Column:
    """Failed jobs carry an empty object where the site should be."""
    return F.when(F.trim(site).isin("{}", ""), None).otherwise(site)


def normalise_steps(df: DataFrame) -> DataFrame:
    """Make sites written as ``{}`` null, inside the steps array."""
    return df.withColumn("steps", F.transform(
        "steps", lambda s: s.withField("site", normalise_sites(s["site"]))))


def read_documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Archived documents, one JSON object per line (also compressed), as reports of this model.

    Steps may be a list, or a map by name as older documents have it; a site that
    is an empty object is missing; codes may be numbers; metrics that are no
    numbers are missing.  A line of any other shape has its text in ``_corrupt`` and nothing else.
    """
    raw = spark.read.text(paths).select("value", F.from_json("value", DOCUMENT_DDL).alias("d"))
    loose = STEPS.replace(METRICS, "map<string,string>")
    one = loose.removeprefix("array<").removesuffix(">")
    text = F.ltrim(F.col("d.steps"))
    listed = F.when(text.startswith("["), F.from_json(text, loose)).when(
        text.startswith("{"), let(F.from_json(text, f"map<string,{one}>"), steps_from_map))
    rows = raw.withColumn("steps", listed)
    known = F.col("d.meta_data").isNotNull() & F.col("steps").isNotNull()

    def measured(step: Column) -> Column:
        groups = {g: F.transform_values(step["performance"][g], lambda _, v: v.try_cast("double")) for g in ("cpu", "storage", "memory")}
        performance = F.when(step["performance"].isNotNull(), F.struct(*[m.alias(g) for g, m in groups.items()]))
        return step.withField("performance", performance).withField("site", normalise_sites(step["site"]))

    meta = F.col("d.meta_data")
    day = F.date_add(F.lit(dt.date(1970, 1, 1)), F.floor(F.col("d.meta_data.ts") / 86400).cast("int"))
    columns = {
        "report_id": F.col("d.wmaid"), "ingest_ts": F.col("d.wmats"), "stage": F.col("d.stype"), "kind": F.col("d.dtype"),
        "task": F.col("d.task"), "campaign": F.col("d.Campaign"), "prep_id": F.col("d.PrepID"),
        "meta": F.struct(meta["agent_ver"].alias("agent_ver"), meta["fwjr_id"].alias("job_id"),
                         *[meta[n].alias(n) for n in ("crab_id", "host", "wn_name", "jobtype", "jobstate", "ts")]),
        "lfns": F.col("d.LFNArray"), "pfns": F.col("d.PFNArray"), "skipped": F.col("d.skippedFiles"),
        "fallback": F.col("d.fallbackFiles"), "wall_s": F.col("d.WMTiming.WMTotalWallClockTime"),
        "steps": F.transform("steps", measured), "year": F.year(day), "month": F.month(day), "day": F.day(day),
    }
    return rows.select(*[F.when(known, c).alias(n) for n, c in columns.items()], F.when(~known | known.isNull(), F.col("value")).alias("_corrupt"))


def steps_from_map(steps: Column) -> Column:
    """Older reports keep steps as a map by name: as a list ordered by name."""
    return F.transform(F.array_sort(F.map_keys(steps)),
                       lambda name: F.element_at(steps, name).withField("name", name))


def _between(first: dt.date, last: dt.date) -> Column:
    """Date range as conditions on the partition columns alone, so whole folders are skipped."""
    month_no = F.col("year") * 12 + F.col("month")
    low, high = first.year * 12 + first.month, last.year * 12 + last.month
    return (
        F.col("year").between(first.year, last.year)
        & month_no.between(low, high)
        & ((month_no > low) | (F.col("day") >= first.day))
        & ((month_no < high) | (F.col("day") <= last.day))
    )


def check_timerange(timerange: Iterable, today: dt.date | None = None) -> tuple[dt.date, dt.date]:
    """Two date keys, in order, as dates; anything else is a ValueError."""
    keys = list(timerange)
    if len(keys) != 2:
        raise ValueError("a time range is a pair of dates")
    today = today or dt.datetime.now(dt.timezone.utc).date()
    first, last = (parse_day(k, today) for k in keys)
    if first > last:
        raise ValueError(f"time range is reversed: {first} > {last}")
    return first, last


def prune(df: DataFrame, timerange: Iterable | None = None, today: dt.date | None = None) -> DataFrame:
    """Keep the days of a range (default yesterday to today) by partition columns."""
    today = today or dt.datetime.now(dt.timezone.utc).date()
    first, last = check_timerange(timerange or (today - dt.timedelta(days=1), today), today)
    return df.where(_between(first, last))


def resolve_source(spark: SparkSession, root: str, source: str, today: dt.date | None = None) -> DataFrame:
    """Reports of ``all`` days, of a day (``YYYYMMDD`` or ``Nd`` ago), or of another path."""
    if source == "all":
        return read_reports(spark, root)
    if re.fullmatch(r"\d{8}|\d+d", source):
        return prune(read_reports(spark, root), (source, source), today)
    return read_reports(spark, source)


def by_ids(df: DataFrame, ids: list[str] | DataFrame, column: str = "report_id") -> DataFrame:
    """Rows with an id from a list, or from the single column of a DataFrame.

    A list is a literal of the plan and reaches the scan, whatever its length;
    one that is long belongs into a DataFrame, which is a semi join.
    """
    if isinstance(ids, DataFrame):
        return df.join(ids.toDF(column), column, "left_semi").select(*df.columns)
    return df.where(F.col(column).isin(ids))


def choose_tier(timerange: Iterable, threshold_days: int = 30, today: dt.date | None = None) -> str:
    """``cold`` when the range ends before the hot window, else ``hot``."""
    today = today or dt.datetime.now(dt.timezone.utc).date()
    _, last = check_timerange(timerange, today)
    return "cold" if last < today - dt.timedelta(days=threshold_days) else "hot"


def tiered_read(hot: DataFrame, cold: DataFrame, timerange: Iterable, threshold_days: int = 30,
                today: dt.date | None = None) -> DataFrame:
    """Read the range from the tier that holds it.

    A range across the border reads both: a report that was already copied to
    the cold tier is taken from there only, by an anti join on its id.
    """
    today = today or dt.datetime.now(dt.timezone.utc).date()
    first, last = check_timerange(timerange, today)
    border = today - dt.timedelta(days=threshold_days)
    if last < border:
        return cold.where(_between(first, last))
    if first >= border:
        return hot.where(_between(first, last))
    old = cold.where(_between(first, last))
    new = hot.where(_between(first, last)).join(old.select("report_id"), "report_id", "left_anti")
    return old.unionByName(new)


def _canonical(value: Column, kind: T.DataType) -> Column:
    """A value in one form: fields and map keys in order, every number as text, whole ones without a fraction."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(value.isNotNull(), F.struct(*[_canonical(value[f.name], f.dataType).alias(f.name) for f in fields]))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _canonical(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform(F.array_sort(F.map_entries(value)), lambda e: F.struct(
            e["key"].cast("string").alias("k"), _canonical(e["value"], kind.valueType).alias("v")))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        value = value.cast("double")
        whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
        return F.when(whole, value.cast("bigint").cast("string")).otherwise(value.cast("string"))
    return value.cast("string")


def canonical_text(df: DataFrame, ignore: tuple[str, ...] = ()) -> Column:
    """Each row as JSON text that does not depend on the order of columns, fields or map keys, on missing against null
    fields, or on numbers being whole or double in the schema."""
    fields = sorted((f for f in df.schema.fields if f.name not in ignore), key=lambda f: f.name)
    return F.to_json(F.struct(*[_canonical(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in fields]))


# What storage adds to a document, and the id itself.
ENVELOPE = ("report_id", "ingest_ts", "stage", "kind", "year", "month", "day")


def with_document_hash(df: DataFrame, ignore: tuple[str, ...] = ENVELOPE, out: str = "report_id") -> DataFrame:
    """Set the id of each report to the hash of its whole content."""
    return df.withColumn(out, F.sha2(canonical_text(df, ignore), 256))


def verify_documents(df: DataFrame, ignore: tuple[str, ...] = ENVELOPE, key: str = "report_id") -> DataFrame:
    """Reports whose whole content no longer gives their id."""
    return df.where(F.sha2(canonical_text(df, ignore), 256) != F.col(key))


def with_content_hash(df: DataFrame, *names: str) -> DataFrame:
    """Set the id of each document to the hash of its content fields."""
    return df.withColumn("report_id", document_id(*names))


def verify(df: DataFrame, *names: str) -> DataFrame:
    """Documents whose content no longer gives their id."""
    return df.where(document_id(*names) != F.col("report_id"))


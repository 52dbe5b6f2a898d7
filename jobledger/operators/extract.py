"""Row-shaped extraction from the nested parts of reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from jobledger.functions.nested import (
    exit_info, extract_files, first_era, first_site, output_files, split_task, steps_of,
    dereference, flat, outputs,
)
from jobledger.functions.scalar import step_kind
from jobledger.operators.search import failed, find


def deref(df: DataFrame) -> DataFrame:
    """One row per output: its input and output file names instead of indexes."""
    rows = df.select("report_id", "lfns", F.posexplode(outputs()).alias("pos", "o"))
    return rows.select("report_id", "pos", dereference(F.col("o.inputLFNs")).alias("input_files"),
                       dereference(F.col("o.outputLFNs")).alias("output_files"))


def files_of_steps(df: DataFrame, prefix: str) -> DataFrame:
    """One row per file a trace would follow out of each report."""
    return df.select("report_id", F.explode(extract_files(prefix)).alias("file"))


def files_written(df: DataFrame) -> DataFrame:
    return df.select("report_id", F.explode(output_files()).alias("file"))


def scope_of_job(df: DataFrame, exit_policy: str = "first_valid") -> DataFrame:
    """What identifies a job in roll-ups, besides time: nine scope keys."""
    exit_struct = exit_info(exit_policy)
    task = split_task(F.col("task"))
    return df.withColumns({"_exit": exit_struct}).select(
        *[F.col(c) for c in df.columns if c != "task"],
        task["workflow"].alias("workflow"), task["task"].alias("task"),
        F.col("meta.host").alias("host"), first_site().alias("site"),
        F.col("meta.jobtype").alias("jobtype"), F.col("meta.jobstate").alias("jobstate"),
        first_era().alias("acquisitionEra"),
        F.col("_exit.exitCode").alias("exitCode"), F.col("_exit.exitStep").alias("exitStep"))


def failures(df: DataFrame, spec: dict | None = None) -> DataFrame:
    """One summary row per failed job of the spec's time range that fits the spec."""
    rows = failed(find(df, spec or {}))
    task = split_task(F.col("task"))
    return rows.withColumn("_exit", exit_info()).select(
        "report_id", F.col("meta.jobtype").alias("jobtype"), task["workflow"].alias("workflow"),
        F.col("_exit.exitCode").alias("exitCode"), F.col("_exit.exitStep").alias("exitStep"),
        first_site().alias("site"))


def flatten_errors(df: DataFrame) -> DataFrame:
    """One row per step error that has a code, or one per step without; steps need a site.

    The code is 0 where a step has none; a code that is no number is null: a failure, but not known which.
    """
    steps = df.select("task", "campaign", F.explode(steps_of("site", "errors")).alias("s")) \
              .where(F.col("s.site").isNotNull())
    codes = F.filter(F.col("s.errors.exitCode"), lambda c: c.isNotNull())
    return steps.select(
        F.coalesce("task", F.lit("")).alias("task"), F.coalesce("campaign", F.lit("")).alias("campaign"),
        F.col("s.site").alias("site"), F.lit("").alias("dataset"),
        F.explode_outer(codes).alias("code"),
    ).select("task", "campaign", "site", "dataset",
             F.when(F.col("code").isNull(), 0).otherwise(F.col("code").try_cast("int")).alias("exitCode"))


def flatten_outputs(df: DataFrame, attrs: list[str] | None = None) -> DataFrame:
    """One row per output of steps that have a site; or just the named report fields."""
    if attrs:
        return df.select(*[F.col(a) for a in attrs if a in df.columns])
    steps = df.select("task", "campaign", F.explode(steps_of("site", "errors", "output")).alias("s")) \
              .where(F.col("s.site") != "")
    last_code = F.coalesce(F.element_at(F.col("s.errors.exitCode"), -1), F.lit("-1"))
    return steps.select(
        F.coalesce("task", F.lit("NA")).alias("task"), F.coalesce("campaign", F.lit("NA")).alias("campaign"),
        F.col("s.site").alias("site"), F.when(F.size("s.errors") > 0, last_code).alias("exitCode"),
        F.explode(F.col("s.output.outputDataset")).alias("dataset"),
    ).withColumn("dataset", F.coalesce("dataset", F.lit("NA")))


def unpack(df: DataFrame, column: str) -> DataFrame:
    """The fields of a struct column, each as a column."""
    return df.select(f"{column}.*")


def step_histogram(df: DataFrame) -> DataFrame:
    """How many steps of each kind there are, and their share of all steps."""
    kinds = df.select(F.explode("steps.name").alias("name")) \
              .groupBy(step_kind(F.col("name")).alias("kind")).agg(F.count("*").alias("n"))
    total = kinds.agg(F.sum("n")).scalar()
    return kinds.withColumn("share", F.col("n") / total)

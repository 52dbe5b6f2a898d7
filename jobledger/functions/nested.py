"""Column builders over the nested parts of a report.

The parts are always taken as field paths first (``steps.site``) and zipped
where several are needed together: a lambda or explode over the bare ``steps``
array would read every step field, the performance tree included.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from jobledger.functions.scalar import is_cmsrun, valid_exit_code


def steps_of(*fields: str) -> Column:
    """The steps as an array of structs that hold only the named fields."""
    return F.arrays_zip(*[F.col(f"steps.{f}") for f in fields])


def flat(arrays: Column) -> Column:
    """Flatten, ignoring null inner arrays (plain flatten would return null)."""
    return F.flatten(F.filter(arrays, lambda a: a.isNotNull()))


def first_of(array: Column) -> Column:
    return F.get(F.filter(array, lambda x: x.isNotNull()), F.lit(0))


def first_site() -> Column:
    return first_of(F.col("steps.site"))


def outputs() -> Column:
    return flat(F.col("steps.output"))


def output_values(field: str) -> Column:
    """One attribute of all outputs; only that attribute is copied, not the output records."""
    return flat(F.transform(F.col("steps.output"), lambda o: o[field]))


def cmsrun_output_values(field: str) -> Column:
    """One attribute of the outputs of steps whose name begins with cmsRun, in any case."""
    zipped = steps_of("name", "output")
    return flat(F.transform(zipped, lambda s: F.when(is_cmsrun(s["name"]), s["output"][field])))


def first_era() -> Column:
    return first_of(output_values("acquisitionEra"))


def total_events() -> Column:
    """Events over all outputs, null when there are none."""
    total = F.aggregate(output_values("events"), F.lit(0).cast("bigint"),
                        lambda acc, x: acc + F.coalesce(x, F.lit(0).cast("bigint")))
    return F.nullif(total, F.lit(0).cast("bigint"))


def exit_info(policy: str = "first_valid") -> Column:
    """Struct (exitCode, exitStep) of the error that ended the job.

    ``first_valid``: the first error with a valid code, else the last error.
    ``first``: the first error of the first step that has any.
    """
    per_step = F.transform(
        steps_of("name", "errors"),
        lambda s: F.transform(
            s["errors"], lambda e: F.struct(e["exitCode"].alias("exitCode"), s["name"].alias("exitStep"))),
    )
    errors = flat(per_step)
    if policy == "first":
        return F.get(errors, F.lit(0))
    if policy != "first_valid":
        raise ValueError(f"no such exit policy: {policy}")
    valid = F.get(F.filter(errors, lambda e: valid_exit_code(e["exitCode"])), F.lit(0))
    last = F.get(errors, F.size(errors) - 1)
    # Most jobs have no errors: look at the array sizes before building anything.
    some = F.exists(F.col("steps.errors"), lambda e: F.size(e) > 0)
    return F.when(some, F.coalesce(valid, last))


def split_task(task: Column) -> dict[str, Column]:
    """Workflow and task name of ``/workflow/.../task`` or ``id:...:name``."""
    parts = F.when(task.contains("/"), F.split(task, "/")).when(task.contains(":"), F.split(task, ":"))
    return {
        "workflow": F.coalesce(F.get(parts, F.lit(1)), F.lit("workflow-NA")),
        "task": F.coalesce(F.element_at(parts, -1), F.lit("task-NA")),
    }


def dereference(indexes: Column, names: Column | None = None) -> Column:
    """File names for dictionary indexes; an index outside the dictionary gives null."""
    files = F.col("lfns") if names is None else names
    return F.transform(indexes, lambda i: F.get(files, i))


def _files(index_arrays: Column) -> Column:
    return F.array_distinct(F.filter(dereference(flat(index_arrays)), lambda f: f.isNotNull()))


def output_files() -> Column:
    """All distinct files a report says it wrote."""
    return _files(output_values("outputLFNs"))


def step_output_files(prefix: str) -> Column:
    """Distinct files written by steps with a name prefix, in any case."""
    wanted = F.transform(steps_of("name", "output"), lambda s: F.when(
        F.lower(s["name"]).startswith(prefix.lower()), s["output"]["outputLFNs"]))
    return _files(flat(wanted))


def merged_input_files() -> Column:
    """Distinct files that cmsRun steps merged into their outputs."""
    return _files(cmsrun_output_values("inputLFNs"))


def is_merge() -> Column:
    return F.lower(F.col("meta.jobtype")).startswith("merge")


def extract_files(prefix: str) -> Column:
    """What a trace follows: a merge job's inputs, else the outputs of matching steps."""
    return F.when(is_merge(), merged_input_files()).otherwise(step_output_files(prefix))


def run_numbers() -> Column:
    return flat(output_values("runs")).getField("runNumber")


def job_metric_group(group: str) -> Column:
    """Metrics of one group (cpu, storage, memory) of the first step named cmsRun... (case-sensitive)."""
    zipped = F.arrays_zip(F.col("steps.name"), F.col(f"steps.performance.{group}"))
    return F.get(F.filter(zipped, lambda s: s["name"].startswith("cmsRun")), F.lit(0))[group]


def job_metric(path: str, policy: str = "first") -> Column:
    """One metric of the job, e.g. ``cpu.TotalJobTime``, null when not reported.

    ``first``: from the first step named cmsRun...
    ``sum``: summed over all steps that report it.
    """
    group, name = path.split(".")
    if policy == "first":
        return F.try_element_at(job_metric_group(group), F.lit(name))
    if policy != "sum":
        raise ValueError(f"no such performance policy: {policy}")
    values = F.filter(
        F.transform(F.col(f"steps.performance.{group}"), lambda m: F.try_element_at(m, F.lit(name))),
        lambda v: v.isNotNull())
    return F.when(F.size(values) > 0,
                  F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v))

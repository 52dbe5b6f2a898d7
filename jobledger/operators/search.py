"""Search: a JSON query spec becomes one Catalyst predicate and a projection."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F, types as T

from jobledger.functions.nested import cmsrun_output_values, flat, run_numbers, steps_of
from jobledger.functions.scalar import is_cmsrun
from jobledger.schema import ALIASES, DOCUMENT_NAMES
from jobledger.sources.reports import prune

Test = Callable[[Column], Column]
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def starts_with_pattern(value: Column, pattern: str) -> Column:
    """A regular expression that must match from the start (Java dialect)."""
    return value.cast("string").rlike(f"^(?:{pattern})")


def _fit(value: Column, kind: T.DataType, wanted: object) -> tuple[Column, Column]:
    """A field and a wanted value as columns of one type.

    A number for a text field reads the text as a number, where it is one; a
    text for a numeric field reads the number as text.
    """
    if isinstance(wanted, (int, float)) and not isinstance(wanted, bool) and isinstance(kind, T.StringType):
        return value.try_cast("double"), F.lit(float(wanted))
    if isinstance(wanted, str) and isinstance(kind, NUMERIC):
        return value.cast("string"), F.lit(wanted)
    return value, F.lit(wanted)


def _equal(value: Column, kind: T.DataType, wanted: object) -> Column:
    """Equality that never is null; ``None`` wants a missing value."""
    if wanted is None:
        return value.isNull()
    a, b = _fit(value, kind, wanted)
    return F.coalesce(a == b, F.lit(False))


def _same(value: Column, kind: T.DataType, wanted: object) -> Column:
    return starts_with_pattern(value, wanted) if isinstance(wanted, str) else _equal(value, kind, wanted)


def _member(value: Column, kind: T.DataType, wanted: list) -> Column:
    if all(isinstance(w, str) for w in wanted) and isinstance(kind, T.StringType):
        return value.isin(wanted)
    return reduce(or_, [_equal(value, kind, w) for w in wanted], F.lit(False))


def _ordered(compare: Callable[[Column, Column], Column]) -> Callable[[Column, T.DataType, object], Column]:
    return lambda v, kind, w: compare(*_fit(v, kind, w))


# Comparison operators of a spec, as tests of one scalar value of a type.
OPERATORS: dict[str, Callable[[Column, T.DataType, object], Column]] = {
    "$eq": _equal,
    "$gt": _ordered(lambda v, w: v > w),
    "$gte": _ordered(lambda v, w: v >= w),
    "$lt": _ordered(lambda v, w: v < w),
    "$lte": _ordered(lambda v, w: v <= w),
    "$in": _member,
    "$regex": lambda v, kind, w: v.cast("string").rlike(w),
}


def _element(kind: T.DataType) -> T.DataType:
    return kind.elementType if isinstance(kind, T.ArrayType) else kind


def _comparison(op: str, kind: T.DataType, wanted: object) -> Test:
    return lambda value: OPERATORS[op](value, kind, wanted)


def _resolve(path: str) -> str:
    """Aliases and archive names of a dotted path as names of this model."""
    path = ALIASES.get(path, path)
    if path in DOCUMENT_NAMES:
        return DOCUMENT_NAMES[path]
    head, _, rest = path.partition(".")
    head = DOCUMENT_NAMES.get(head, head)
    return f"{head}.{rest}" if rest else head


def _attribute(name: str) -> Test:
    return lambda records: records[name]


def values_at(schema: T.StructType, path: str) -> tuple[Column, T.DataType] | None:
    """Column and type at a dotted path; every array crossed leaves an array.

    Arrays of arrays are flattened, so a path through any number of arrays of
    structs ends as one array of its leaf values.  None when the path is unknown.
    """
    parts = path.split(".")
    if parts[0] not in schema.fieldNames():
        return None
    here: T.DataType = schema[parts[0]].dataType
    column = F.col(parts[0])
    for part in parts[1:]:
        depth = 0
        while isinstance(here, T.ArrayType):
            here, depth = here.elementType, depth + 1
        if depth == 2 and isinstance(here, T.StructType) and part in here.fieldNames():
            # Take the attribute inside each inner array, so whole records are never copied.
            column, here = flat(F.transform(column, _attribute(part))), T.ArrayType(here[part].dataType)
            continue
        for _ in range(depth - 1):
            column = flat(column)
        if isinstance(here, T.MapType):
            key = part
            column = (F.transform(column, lambda m: F.try_element_at(m, F.lit(key))) if depth
                      else F.try_element_at(column, F.lit(key)))
            here = here.valueType
        elif isinstance(here, T.StructType) and part in here.fieldNames():
            column = column.getField(part)
            here = here[part].dataType
        else:
            return None
        if depth:
            here = T.ArrayType(here)
    while isinstance(here, T.ArrayType) and isinstance(here.elementType, T.ArrayType):
        column, here = flat(column), here.elementType
    return column, here


def _apply(column: Column, kind: T.DataType, test: Test) -> Column:
    return F.exists(column, test) if isinstance(kind, T.ArrayType) else test(column)


def _contains_all(column: Column, kind: T.DataType, wanted: list) -> Column:
    return reduce(and_, [_holds(column, kind, w) for w in wanted], F.lit(True))


def _holds(column: Column, kind: T.DataType, wanted: object) -> Column:
    """Whether a field, or some element of it, equals a value; a missing list has a missing value."""
    found = F.coalesce(_apply(column, kind, lambda v: _equal(v, _element(kind), wanted)), F.lit(False))
    return found | column.isNull() if wanted is None else found


def _condition(column: Column, kind: T.DataType, wanted: object, all_of_list: bool) -> Column:
    """One key of a spec as a predicate on the values at its path."""
    if isinstance(wanted, dict):
        tests = []
        for op, value in wanted.items():
            if op == "$all":
                tests.append(_contains_all(column, kind, value))
            elif op == "$eq":
                tests.append(_holds(column, kind, value))
            elif op == "$ne":  # no element is equal; a missing value is not, either
                tests.append(~_holds(column, kind, value))
            elif op in OPERATORS:
                tests.append(_apply(column, kind, _comparison(op, _element(kind), value)))
            else:
                raise ValueError(f"unknown operator in spec: {op}")
        return reduce(and_, tests)
    if isinstance(wanted, list):
        if all_of_list:
            return _contains_all(column, kind, wanted)
        return _apply(column, kind, lambda v: _member(v, _element(kind), wanted))
    if wanted is None:
        return _holds(column, kind, wanted)
    return _apply(column, kind, lambda v: _same(v, _element(kind), wanted))


def _output_attribute(schema: T.StructType, key: str) -> tuple[Column, T.DataType] | None:
    """Values of an output attribute, by case-insensitive name, over all cmsRun steps."""
    output = schema["steps"].dataType.elementType["output"].dataType.elementType
    for field in output.fields:
        if field.name.lower() == key.lower():
            column, kind = cmsrun_output_values(field.name), T.ArrayType(field.dataType)
            while isinstance(kind.elementType, T.ArrayType):
                column, kind = flat(column), kind.elementType
            return column, kind
    return None


def _key_condition(schema: T.StructType, key: str, wanted: object) -> Column:
    if key == "run":
        return _condition(run_numbers(), T.ArrayType(T.LongType()), wanted, all_of_list=True)
    if key == "site":
        sites = wanted if isinstance(wanted, list) else [wanted]
        if all(isinstance(s, str) for s in sites):
            return at_site_condition(sites)
    found = values_at(schema, _resolve(key))
    if found is None or key.lower() == "prep_id":
        nested = _output_attribute(schema, key)
        if nested is not None:
            in_outputs = _condition(*nested, wanted, all_of_list=False)
            return in_outputs if found is None else in_outputs | _condition(*found, wanted, all_of_list=False)
    if found is None:
        raise ValueError(f"no field for spec key {key!r}")
    return _condition(*found, wanted, all_of_list=False)


def compile_spec(schema: T.StructType, spec: dict, match: str = "all") -> Column:
    """Predicate for a spec: all keys must hold, or any with ``match='any'``.

    An empty spec holds for every row.  A key is an alias, a path of the report,
    or the name of an output attribute.  A text is a regular expression anchored
    at the start, a list is membership (for ``run``: all must occur), a dict
    holds comparison operators, ``$or`` takes a list of specs.  ``$ne`` wants that
    no element is equal, which a missing value fulfils; ``None`` is a missing value.
    A time range is no condition on a row: :func:`find` prunes by it, and within
    ``$or`` it is an error.
    """
    tests = []
    for key, wanted in spec.items():
        if key == "timerange":
            continue
        if key == "$or":
            if not wanted or any("timerange" in s for s in wanted):
                raise ValueError("$or takes one spec or more, none with a time range")
            tests.append(reduce(or_, [compile_spec(schema, s) for s in wanted]))
        else:
            tests.append(F.coalesce(_key_condition(schema, key, wanted), F.lit(False)))
    if not tests:
        return F.lit(True)
    return reduce(and_ if match == "all" else or_, tests)


def project(df: DataFrame, fields: list[str]) -> DataFrame:
    """Named fields by dotted path or alias; the column keeps the name asked for."""
    columns = []
    for field in fields:
        found = values_at(df.schema, _resolve(field))
        if found is None:
            raise ValueError(f"no field named {field!r}")
        columns.append(found[0].alias(field))
    return df.select(*columns)


def alias_view(df: DataFrame) -> DataFrame:
    """The report id with every search alias as a column of its own."""
    return df.select("report_id", *[
        values_at(df.schema, _resolve(alias))[0].alias(alias) for alias in ALIASES])


def find(df: DataFrame, spec: dict, fields: list[str] | None = None, match: str = "all",
         today: dt.date | None = None) -> DataFrame:
    """Reports of a spec's time range that fit the spec, whole or by fields."""
    if spec.get("timerange"):
        df = prune(df, spec["timerange"], today)
    found = df.where(compile_spec(df.schema, spec, match))
    return project(found, fields) if fields else found


def count(df: DataFrame, spec: dict, match: str = "all") -> DataFrame:
    """One row with the number of reports that fit a spec."""
    return find(df, spec, match=match).agg(F.count("*").alias("n"))


def failed(df: DataFrame) -> DataFrame:
    return df.where(F.col("meta.jobstate") == "jobfailed")


def succeeded(df: DataFrame) -> DataFrame:
    return df.where(F.col("meta.jobstate") == "success")


def at_site_condition(sites: list[str]) -> Column:
    return F.exists(steps_of("name", "site"), lambda s: s["site"].isin(sites) & is_cmsrun(s["name"]))


def at_site(df: DataFrame, sites: list[str]) -> DataFrame:
    """Reports with a cmsRun step at one of the sites."""
    return df.where(at_site_condition(sites))


def where_eq(df: DataFrame, conditions: dict) -> DataFrame:
    """Rows equal to every given value, by dotted path."""
    return df.where(reduce(and_, [F.col(k) == F.lit(v) for k, v in conditions.items()], F.lit(True)))


def classify(df: DataFrame) -> DataFrame:
    """Add the document class: crab, fwjr or Unknown."""
    return df.withColumn("document_class", F.when(F.col("meta.crab_id").isNotNull(), "crab")
                         .when(F.col("meta.job_id").isNotNull(), "fwjr").otherwise("Unknown"))

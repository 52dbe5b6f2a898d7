"""Helpers that several training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

WHITE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def collapsed(text: Column) -> Column:
    """Each run of white space as one space."""
    return F.regexp_replace(text, WHITE, " ")


def words(text: Column) -> Column:
    """Words without empty ones; an empty array where there is none."""
    flat = F.trim(collapsed(text))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def let(value: Column, body) -> Column:
    """``body(x)`` with ``value`` evaluated once as ``x``."""
    return F.transform(F.array(value), body)[0]


def free(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def id_key(column: str) -> Column:
    """An id as text that is never null, so that null ids join like any other."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit("null"))


def without(df: DataFrame, lost: DataFrame, keys: list[str]) -> DataFrame:
    """One row of ``df`` per key that ``lost`` does not list, without the key columns.

    Both steps share one shuffle by ``keys``; rows that repeat a key are
    combined before it.
    """
    return df.dropDuplicates(keys).join(lost.select(*keys), keys, "left_anti").drop(*keys)


def join_hot(left: DataFrame, right: DataFrame, key: str, n: str, share: int = 1_000) -> DataFrame:
    """Inner join where ``right`` has one row per key and ``n`` is the number of rows ``left`` has for it.

    Keys with more than a thousandth of all counted rows are fewer than a thousand:
    they are broadcast, so none of them fills a task.  All others meet in a shuffle.
    """
    total = right.agg(F.coalesce(F.sum(n), F.lit(0)).alias("total")).first().total
    hot = F.broadcast(right.where(F.col(n) * share > total))
    rest = left.join(hot.select(key), key, "left_anti").join(right.where(F.col(n) * share <= total), key)
    return left.join(hot, key).unionByName(rest)

"""Exact de-duplication by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from jobledger.llm.common import collapsed, free, id_key, text_of, without
from jobledger.session import materialise

PREFIX_CHARS = 256


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _levels(df: DataFrame, id_col: str, text_col: str, prefix_chars: int) -> tuple[DataFrame, DataFrame]:
    """The narrow rows, and for each text that occurs twice its digest, first row and number."""
    rows = df.select(F.col(id_col).alias("id"), collapsed(text_of(text_col)).alias("text"))
    staged = materialise(rows.select(
        "id", F.length("text").alias("len"), F.xxhash64(F.substring("text", 1, prefix_chars)).alias("prefix"),
        _digest(F.col("text")).alias("digest"), F.monotonically_increasing_id().alias("row")), "exact")
    again = F.col("n") > 1
    lengths = staged.groupBy("len").agg(F.count("*").alias("n")).where(again).select("len")
    by_length = staged.join(lengths, "len", "left_semi")
    prefixes = by_length.groupBy("len", "prefix").agg(F.count("*").alias("n")).where(again).select("len", "prefix")
    by_prefix = by_length.join(prefixes, ["len", "prefix"], "left_semi")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row")))
    groups = by_prefix.groupBy("digest").agg(first.alias("first"), F.count("*").alias("n")).where(again)
    return staged, groups


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """For every row its id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal when they agree after each white-space run is replaced by
    one space; null is the empty text.

    The text never leaves the scan that reads it: length, prefix hash and
    digest are taken there (the length of a normalised text needs all of it, so
    a second reading for the survivors would save nothing).  The levels then
    work on rows of some 60 bytes.  Only rows whose length occurs twice reach
    the grouping by prefix, and only those whose prefix occurs twice the one by
    digest.  All groupings combine before the shuffle, so a group that holds a
    third of all rows leaves each task as one row.

    Exactly one row of each group stays: the smallest id (null ids last), and
    of rows that share it any one.  An empty table gives an empty result; other
    columns, whatever their names, are not looked at.
    """
    staged, groups = _levels(df, id_col, text_col, prefix_chars)
    alone = F.col("n").isNull()
    return staged.join(groups, "digest", "left").select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("first.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("first.row") == F.col("row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """The rows that stay, with all their columns; the text is shuffled once."""
    staged, groups = _levels(df, id_col, text_col, prefix_chars)
    own, mark = free(df, "own_id"), free(df, "own_digest")
    lost = (staged.join(groups, "digest")
                  .where(~F.col("id").eqNullSafe(F.col("first.id")))
                  .select(id_key("id").alias(own), F.col("digest").alias(mark)).distinct())
    keyed = df.withColumns({own: id_key(id_col), mark: _digest(collapsed(text_of(text_col)))})
    return without(keyed, lost, [own, mark])

"""Continuous ingest and hot-to-cold migration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from jobledger.functions.scalar import random_id
from jobledger.operators.quality import validate
from jobledger.session import materialise, read_or_none, staging
from jobledger.sources.sinks import append_new, plan_append, store


def enrich(df: DataFrame, now: Column | None = None, kind: str = "fwjr", stage: str = "hot") -> DataFrame:
    """Stamp id, arrival time, kind and stage where a document lacks them; batch or stream."""
    stamps = {
        "report_id": random_id(),
        "ingest_ts": F.unix_micros(F.current_timestamp()) / 1e6 if now is None else now,
        "kind": F.lit(kind),
        "stage": F.lit(stage),
    }
    present = set(df.columns)
    return df.withColumns({
        name: F.coalesce(F.col(name), value) if name in present else value for name, value in stamps.items()})


def ingest_stream(source: DataFrame, target: str, checkpoint: str, partition_by: list[str] | None = None,
                  trigger: dict | None = None, replayable: bool = False) -> StreamingQuery:
    """Stamp arriving reports and append them once per id.

    Repeats, however late they come, and batches replayed after a failure are
    found by the id index beside the target, so the stream keeps no state and no report is ever too
    late.  ``trigger`` is what ``writeStream.trigger`` takes, such as
    ``{"processingTime": "600 seconds"}`` to go on for ever; by default what has arrived is drained.
    A batch is staged before it is compared; a stream of files whose documents have their ids may say ``replayable``.
    """
    def store(batch: DataFrame, _: int) -> None:
        append_new(batch, target, partition_by=partition_by, replayable=replayable)

    return (enrich(source).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
                .trigger(**(trigger or {"availableNow": True})).start())


def migrate(spark: SparkSession, hot: str, cold: str, bad: str, checkpoint: str, schema: dict,
            files_per_batch: int = 1000, trigger: dict | None = None, ledger: str | None = None) -> StreamingQuery:
    """Move documents that arrived in the hot folder since the last run to the cold tables.

    The checkpoint remembers what was moved, so no mark is written back to the
    hot documents.  Each batch is validated; documents already in the cold or
    bad table are skipped, which makes a replayed batch harmless.  With a ``ledger`` folder every
    batch accounts for its documents before it stores them (see ``reconcile``).
    """
    arrived = (spark.readStream.schema("doc_key string, doc string")
               .option("maxFilesPerTrigger", files_per_batch).parquet(hot))

    def move(batch: DataFrame, number: int) -> None:
        with staging(spark):
            seen = Observation(f"batch {number}")
            ok = F.size("errors") == 0
            checked = materialise(validate(batch, schema).observe(
                seen, F.count("*").alias("arrived"), F.count_if(ok).alias("good"), F.count_if(~ok).alias("bad")), "migrate")
            plans = {cold: plan_append(checked.where(ok).drop("errors"), cold, "doc_key"),
                     bad: plan_append(checked.where(~ok), bad, "doc_key")}
            if ledger:
                _account(spark, ledger, number, seen.get, plans[cold].new, plans[bad].new)
            for path, plan in plans.items():
                store(plan, path)

    return (arrived.writeStream.foreachBatch(move).option("checkpointLocation", checkpoint)
                   .trigger(**(trigger or {"availableNow": True})).start())


LEDGER = "batch long, arrived long, good long, bad long, new_good long, new_bad long"


def _account(spark: SparkSession, ledger: str, number: int, seen: dict, new_good: int, new_bad: int) -> None:
    """One row for a batch, before its documents are stored.

    A batch that runs again after a failure finds some or all of its documents stored; what it
    counted as new the first time stays.
    """
    path = f"{ledger}/batch={number}"
    before = read_or_none(spark, path)
    if before is not None and (row := before.first()):
        new_good, new_bad = max(new_good, row.new_good), max(new_bad, row.new_bad)
    rows = spark.createDataFrame([(number, seen["arrived"], seen["good"], seen["bad"], new_good, new_bad)], LEDGER)
    rows.drop("batch").coalesce(1).write.mode("overwrite").parquet(path)


def reconcile(spark: SparkSession, ledger: str, cold: str, bad: str) -> DataFrame:
    """One row: documents that arrived, were good, bad, repeated and new by the ledger, and stored in each table; whether all is accounted for."""
    told = spark.read.schema(LEDGER).parquet(ledger).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("arrived", "good", "bad", "new_good", "new_bad")])
    stored = {name: 0 if (t := read_or_none(spark, path)) is None else t.count() for name, path in (("cold_rows", cold), ("bad_rows", bad))}
    rows = told.withColumn("repeated", F.col("good") + F.col("bad") - F.col("new_good") - F.col("new_bad"))
    rows = rows.withColumns({name: F.lit(n).cast("long") for name, n in stored.items()})
    return rows.withColumn("whole", (F.col("arrived") == F.col("good") + F.col("bad")) & (F.col("new_good") == F.col("cold_rows"))
                           & (F.col("new_bad") == F.col("bad_rows")))

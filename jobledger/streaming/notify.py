"""Live notifications: flat records routed to topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from jobledger.operators.extract import flatten_errors
from jobledger.sources.sinks import route


def notify_stream(source: DataFrame, path: str, checkpoint: str, topics: list[str],
                  default: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Flatten arriving reports and write each record to its topics, compressed; no state is kept.

    ``trigger`` is what ``writeStream.trigger`` takes, such as ``{"processingTime": "10 seconds"}``
    to go on for ever; by default what has arrived is drained.
    """
    routed = route(flatten_errors(source), topics, default)
    fields = [c for c in routed.columns if c != "topic"]
    messages = routed.select("topic", F.to_json(F.struct(*fields)).alias("value"))
    return (messages.writeStream.format("json").partitionBy("topic").outputMode("append")
            .option("compression", "gzip").option("path", path).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())

"""Starting and draining streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from cityflux.streaming.sinks import Sink

# Tasks a micro-batch is shuffled to. A batch is of bounded size, so this does not follow the size of whole tables: every
# task reports to the driver, in every batch. A stream with state keeps the number it first started with.
BATCH_TASKS = 16
_TASKS = "spark.sql.shuffle.partitions"


def start(stream: DataFrame, sink: Sink, checkpoint: str, every: str | None = None, mode: str = "append", tasks: int = BATCH_TASKS) -> StreamingQuery:
    """Run a sink over a stream: every interval, or over what is there now when no interval is given."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    conf = stream.sparkSession.conf
    held = conf.get(_TASKS)
    # A query takes the settings of its session when it starts.
    conf.set(_TASKS, str(min(int(held), tasks)))
    try:
        return writer.start()
    finally:
        conf.set(_TASKS, held)


def drain(stream: DataFrame, sink: Sink, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run over what is there now and wait for the end."""
    query = start(stream, sink, checkpoint, mode=mode)
    query.awaitTermination()
    return query


def dropped_late(query: StreamingQuery) -> int:
    """Rows the watermark turned away, over the recent progress reports."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])

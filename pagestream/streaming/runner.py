"""Starting streaming queries."""

from contextlib import contextmanager


@contextmanager
def state_partitions(spark, count):
    """Set the number of state partitions while a query starts.

    It is bound to the checkpoint from the first start on, so choose it for the
    size the state will have. `None` leaves the session's setting.
    """
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    if count:
        spark.conf.set(key, str(count))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def start(rows, sink, checkpoint, mode="append", every=None, drain=False, name=None):
    """Start a query into `sink`, a function that completes a stream writer.

    `every` is the trigger interval, by default the next batch follows at once.
    `drain` takes what is there in batches and ends.
    """
    writer = rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    if drain:
        writer = writer.trigger(availableNow=True)
    elif every:
        writer = writer.trigger(processingTime=every)
    return sink(writer).start()


def drain(rows, sink, checkpoint, mode="append", partitions=None):
    """Process what is there now and wait for the end."""
    with state_partitions(rows.sparkSession, partitions):
        query = start(rows, sink, checkpoint, mode, drain=True)
        query.awaitTermination()
    return query


def await_any(spark):
    """All queries are started before this waits; it returns when one of them ends."""
    spark.streams.awaitAnyTermination()


def last_batch(query):
    """Number of the last batch a query ran."""
    return query.lastProgress["batchId"]


def late_rows(query):
    """Rows dropped as later than the watermark, over the batches whose progress is kept.

    Counted behind the map-side combine: rows of one key and window in one task are one.
    """
    return sum(
        state["numRowsDroppedByWatermark"]
        for progress in query.recentProgress for state in progress["stateOperators"]
    )

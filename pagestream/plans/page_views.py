"""Most viewed pages, cumulative and by sliding window."""

from pyspark.sql import functions as F

from pagestream.operators import aggregates, messages, ranking
from pagestream.sources import topics
from pagestream.streaming import runner, sinks, tables

WIDTH, SLIDE, DELAY = "4 minutes", "2 minutes", "4 minutes"


def top_pages(views, n=10):
    """The `n` most viewed pages. Over a stream this needs complete mode."""
    totals = aggregates.total_by(views, "curr", "n")
    return messages.to_message(ranking.top_rows(totals, n, "curr"), "curr")


def page_windows(views, time=None, width=WIDTH, slide=SLIDE, delay=DELAY, closed_only=False):
    """`curr, window, value`: views per page and window.

    Without a `time` column a row counts when it is processed, as in a live feed.
    `closed_only` is for append mode, see `aggregates`.
    """
    if time is None:
        time, views = "processed_at", views.withColumn("processed_at", F.current_timestamp())
    watched = views.withWatermark(time, delay)
    return aggregates.windowed_sum(watched, "curr", "n", time, width, slide, closed_only)


def top_pages_sliding(views, time=None, n=20, **window):
    """The `n` largest (page, window) pairs; every window competes, not only the newest."""
    totals = page_windows(views, time, **window)
    ranked = ranking.top_rows(totals, n, "curr", "window.start")
    return messages.to_message(ranked, "curr", keep=["window"])


def running_page_windows(views, time=None, **window):
    """All (page, window) sums as messages, for update mode."""
    return messages.to_message(page_windows(views, time, **window), "curr", keep=["window"])


def top_of_latest_windows(kept, n=20):
    """The `n` largest pairs of a `latest_windows` or `top_windows` table."""
    return ranking.top_rows(kept, n, "key", "window_start").select("key", "value", "window_start")


def start_top_pages(views, sink, checkpoint, n=10):
    return runner.start(
        top_pages(views, n), sink, checkpoint, mode="complete", name=topics.TOP_PAGES_TOPIC
    )


def running_page_totals(views):
    """All page sums as messages, for update mode."""
    return messages.to_message(aggregates.total_by(views, "curr", "n"), "curr")


def start_top_pages_bounded(views, folder, publish, checkpoint, every=None, n=10, drain=False):
    """The ranking of `start_top_pages` without giving out every page at each trigger.

    A batch gives the pages it changed, and the kept table holds the `n` largest. Exact
    while no count is negative, see `tables.top_keys`. `publish(rows, batch_id)` gets the
    ranking of each batch.
    """
    table = tables.top_keys(folder, n)

    def handle(batch, batch_id):
        table.update(batch, batch_id)
        publish(messages.to_message(table.after(batch.sparkSession, batch_id), "key"), batch_id)

    return runner.start(
        running_page_totals(views), sinks.batch_sink(handle), checkpoint, mode="update", every=every, drain=drain,
    )


def start_top_pages_sliding(views, sink, checkpoint, time=None, every="60 seconds", n=20, **window):
    return runner.start(
        top_pages_sliding(views, time, n, **window), sink, checkpoint, mode="complete",
        every=every, name=topics.TOP_PAGES_SLIDING_TOPIC,
    )


def window_messages(top, width_seconds=240):
    """Ranked pairs of a kept table as messages."""
    start = F.col("window_start")
    window = F.struct(
        F.timestamp_seconds(start).alias("start"), F.timestamp_seconds(start + width_seconds).alias("end")
    )
    return messages.to_message(top.withColumn("window", window), "key", keep=["window"])


def start_top_windows(views, folder, publish, checkpoint, time=None, every="60 seconds", n=20,
                      width_seconds=240, slide_seconds=120, delay_seconds=240, drain=False):
    """The ranking of `start_top_pages_sliding` with state that does not grow over time.

    Complete mode emits every page and window since the start. Here the watermark lets go of
    closed windows, and the kept table holds open ones and the `n` largest closed ones. Rows
    later than the delay are dropped; by the clock none is. `publish(rows, batch_id)` gets
    the ranking of each batch.
    """
    table = tables.top_windows(folder, n, width_seconds, delay_seconds)
    width, slide, delay = (f"{s} seconds" for s in (width_seconds, slide_seconds, delay_seconds))

    def handle(batch, batch_id):
        table.update(batch, batch_id)
        top = top_of_latest_windows(table.after(batch.sparkSession, batch_id), n)
        publish(window_messages(top, width_seconds), batch_id)

    return runner.start(
        running_page_windows(views, time, width=width, slide=slide, delay=delay),
        sinks.batch_sink(handle), checkpoint, mode="update", every=every, drain=drain,
    )


def start_latest_windows(views, folder, publish, checkpoint, k, slide_seconds=120, time=None,
                         every="60 seconds", n=20, drain=False, **window):
    """Sliding top pages with bounded state: only the newest `k` windows compete.

    `publish(rows, batch_id)` gets the ranking of each batch.
    """
    table = tables.latest_windows(folder, k, slide_seconds)

    def handle(batch, batch_id):
        table.update(batch, batch_id)
        publish(top_of_latest_windows(table.after(batch.sparkSession, batch_id), n), batch_id)

    return runner.start(
        running_page_windows(views, time, **window), sinks.batch_sink(handle), checkpoint,
        mode="update", every=every, drain=drain,
    )

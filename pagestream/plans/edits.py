"""Edit events: ingest, most edited categories, edits per wiki."""

import math

from pyspark.sql import functions as F

from pagestream.functions import dates, text
from pagestream.operators import aggregates, categories as cats, filters, joins, messages, parse
from pagestream.schemas import EDIT
from pagestream.sources import topics
from pagestream.streaming import runner, sinks, tables


def _edits(event_messages):
    events = parse.parse_change_events(event_messages, fields=["id", "timestamp", "wiki", "title"])
    return filters.edits_only(events)


def enriched_edits(event_messages, categories, **join):
    """Edit x category rows from change-event messages. Same for batch and stream."""
    return cats.with_categories(_edits(event_messages), categories, edit_id="event_id", **join)


def edit_lines(event_messages, categories, **join):
    """The same as tab-separated lines."""
    return messages.to_lines(enriched_edits(event_messages, categories, **join), *EDIT.names)


def edit_messages(event_messages, categories, **join):
    """The lines as `value`, and as `key` the event's id, by which its lines are one edit."""
    rows = enriched_edits(event_messages, categories, keep=["event_id"], **join)
    key = F.col("event_id").cast("string").alias("key")
    return rows.select(key, text.tab_joined(*[F.col(c) for c in EDIT.names]).alias("value"))


def _watched(edits, delay):
    timed = edits.withColumn("event_time", dates.event_time(F.col("timestamp")))
    return timed.withWatermark("event_time", delay)


def top_categories(edits, wiki="enwiki", noise=filters.NOISE, threshold=5,
                   width="30 minutes", slide="2 minutes", delay="30 minutes", closed_only=False):
    """Categories of one wiki with at least `threshold` edits in a window.

    A stream in update mode gives a count each time it changes; with `closed_only`
    and append mode it gives the final count of each window.
    """
    wanted = filters.without_noise(filters.of_wiki(edits, wiki), noise)
    counts = aggregates.windowed_count(
        _watched(wanted, delay), "categoryText", "event_time", width, slide, closed_only
    )
    return messages.to_message(filters.at_least(counts, threshold), "categoryText", keep=["window"])


def category_panes(edits, wiki="enwiki", noise=filters.NOISE, width_seconds=1800, slide_seconds=120, delay_seconds=1800):
    """Counts of the same categories per pane of one slide, for update mode and `OpenPanes`.

    The watermark waits until the last window that has a pane is closed.
    """
    wanted = filters.without_noise(filters.of_wiki(edits, wiki), noise)
    watched = _watched(wanted, f"{delay_seconds + width_seconds - slide_seconds} seconds")
    slide = f"{slide_seconds} seconds"
    counts = aggregates.windowed_count(watched, "categoryText", "event_time", slide, slide)
    return messages.to_message(counts, "categoryText", keep=["window"])


def pane_handler(panes, publish, threshold=5):
    """For `batch_sink`: keeps the panes and publishes the windows that a batch changed.

    `publish(rows, batch_id)` gets `key, value, window`, as update mode gives them. A row
    late for some windows of its pane counts for those that are not closed.
    """

    def handle(batch, batch_id):
        panes.update(batch, batch_id)
        changed = filters.at_least(panes.changed_windows(batch.sparkSession, batch_id), threshold)
        start = F.col("window_start")
        window = F.struct(
            F.timestamp_seconds(start).alias("start"), F.timestamp_seconds(start + panes.width).alias("end")
        )
        publish(messages.to_message(changed.withColumn("window", window), "key", keep=["window"]), batch_id)

    return handle


def start_category_panes(edits, folder, publish, checkpoint, every="1 minute", threshold=5, drain=False,
                         width_seconds=1800, slide_seconds=120, delay_seconds=1800, **which):
    """`start_top_categories` with state per pane; the folder keeps the open panes."""
    spans = {"width_seconds": width_seconds, "slide_seconds": slide_seconds, "delay_seconds": delay_seconds}
    panes = tables.OpenPanes(folder, **spans)
    return runner.start(
        category_panes(edits, **spans, **which), sinks.batch_sink(pane_handler(panes, publish, threshold)),
        checkpoint, "update", every, drain,
    )


CATEGORY_SPANS = {"width_seconds": 1800, "slide_seconds": 120, "delay_seconds": 1800}
WIKI_SPANS = {"width_seconds": 300, "slide_seconds": 60, "delay_seconds": 600}


def shared_panes(edits, wiki="enwiki", noise=filters.NOISE, category_spans=CATEGORY_SPANS, wiki_spans=WIKI_SPANS):
    """Counts for `top_categories` and `wiki_counts` from one read and one aggregation of the edits.

    Gives `topic, key, value, window` per pane, for update mode and an `OpenPanes` per topic.
    A pane is the longest that divides both slides. The watermark waits until the last
    window of either query that has a pane is closed, and is that of all edits, also for the one wiki.
    """
    spans = (category_spans, wiki_spans)
    pane = math.gcd(*(span["slide_seconds"] for span in spans))
    delay = max(span["width_seconds"] + span["delay_seconds"] for span in spans) - pane

    def counted_as(topic, column):
        return F.struct(F.lit(topic).alias("topic"), F.col(column).alias("key"))

    wanted = (F.col("wiki") == wiki) & ~F.col("categoryText").rlike(noise)
    of_queries = F.array_compact(F.array(
        counted_as(topics.WIKI_TOPIC, "wiki"), F.when(wanted, counted_as(topics.TOP_CATEGORIES_TOPIC, "categoryText")),
    ))
    rows = _watched(edits, f"{delay} seconds").select("event_time", F.explode(of_queries).alias("of"))
    counts = aggregates.windowed_count(rows, "of", "event_time", f"{pane} seconds", f"{pane} seconds")
    return messages.to_message(counts.select("of.*", "value", "window"), "key", keep=["window", "topic"])


def start_shared_counts(edits, folder, publish, checkpoint, every="1 minute", drain=False, category_threshold=5,
                        wiki_threshold=20, category_spans=CATEGORY_SPANS, wiki_spans=WIKI_SPANS, **which):
    """`start_top_categories` and `start_wiki_counts` as one query; the folder keeps the open panes of each.

    `publish(rows, topic, batch_id)` gets the windows of a topic that a batch changed.
    """
    handlers = {
        topic: pane_handler(
            tables.OpenPanes(f"{folder}/{topic}", **spans),
            lambda rows, batch_id, topic=topic: publish(rows, topic, batch_id), threshold,
        )
        for topic, spans, threshold in (
            (topics.TOP_CATEGORIES_TOPIC, category_spans, category_threshold),
            (topics.WIKI_TOPIC, wiki_spans, wiki_threshold),
        )
    }

    def handle(batch, batch_id):
        batch.persist()  # the changed panes of the batch, which the aggregation gives once
        try:
            for topic, handler in handlers.items():
                handler(batch.where(F.col("topic") == topic), batch_id)
        finally:
            batch.unpersist()

    rows = shared_panes(edits, category_spans=category_spans, wiki_spans=wiki_spans, **which)
    return runner.start(rows, sinks.batch_sink(handle), checkpoint, "update", every, drain, name="edit_counts")


def wiki_counts(edits, threshold=20, distinct_edits=False, edit_id=None,
                width="5 minutes", slide="1 minute", delay="10 minutes", closed_only=False):
    """Wikis with at least `threshold` rows in a window.

    A row is an edit and one of its categories. With `distinct_edits` an edit counts
    once, whatever its number of categories. `edit_id` names the column that tells edits
    apart, as the key of `edit_messages` does; a stream then remembers an id as long as the
    watermark waits. Lines alone hold no id: two edits of one page in one second are one.
    """
    watched = _watched(edits, delay)
    if distinct_edits and edit_id:
        once = watched.dropDuplicatesWithinWatermark if watched.isStreaming else watched.dropDuplicates
        watched = once([edit_id])
    elif distinct_edits:
        watched = watched.dropDuplicates(["event_time", "wiki", "title"])
    counts = aggregates.windowed_count(watched, "wiki", "event_time", width, slide, closed_only)
    return messages.to_message(filters.at_least(counts, threshold), "wiki", keep=["window"])


def start_edit_lines(event_messages, categories, sink, checkpoint, **join):
    return runner.start(edit_lines(event_messages, categories, **join), sink, checkpoint)


def of_titles(categories, rows, parts):
    """The part of a table laid out by `sinks.write_by_hash` that the rows' titles lie in.

    The list of parts has at most `parts` numbers. Other parts are not opened.
    """
    wanted = rows.select(sinks.hash_part("title", parts).alias("part")).distinct().collect()
    return categories.where(F.col("part").isin([r["part"] for r in wanted])).drop("part")


def start_edit_lines_by_batch(event_messages, categories, write, checkpoint, every=None, drain=False, parts=None):
    """For streams where one page may hold much of a micro-batch and is not known before.

    `write(lines, batch_id)` gets the lines of each batch, at least once. Hot titles
    are looked for in each batch, those of the category table once. A table with a column
    `part`, laid out by `sinks.write_by_hash` in `parts` parts, is read for each batch only
    where the batch's titles lie.
    """
    hot_categories = joins.hot_values(filters.visible(categories), "title")
    whole = categories

    def handle(batch, batch_id):
        rows = _edits(batch).persist()
        try:
            hot_edits = joins.hot_values(rows, "title")
            hot = F.col("title").isin(*hot_edits, *hot_categories)
            categories = of_titles(whole, rows, parts) if parts else whole
            # What is not hot is joined with the table where it lies; mostly that is all.
            any_hot = bool(hot_edits or hot_categories)
            joined = cats.with_categories(
                rows.where(~hot) if any_hot else rows, categories, hot_edits={}, hot_categories={}
            )
            if any_hot:
                joined = joined.unionByName(cats.with_categories(
                    rows.where(hot), categories.where(hot), hot_edits=hot_edits,
                    hot_categories=hot_categories, edit_id="event_id",
                ))
            write(messages.to_lines(joined, *EDIT.names), batch_id)
        finally:
            rows.unpersist()

    return runner.start(
        event_messages, sinks.batch_sink(handle), checkpoint, every=every, drain=drain
    )


def _mode(query):
    return "append" if query.get("closed_only") else "update"


def start_top_categories(edits, sink, checkpoint, every="1 minute", **query):
    return runner.start(
        top_categories(edits, **query), sink, checkpoint, _mode(query), every,
        name=topics.TOP_CATEGORIES_TOPIC,
    )


def start_wiki_counts(edits, sink, checkpoint, every="1 minute", **query):
    return runner.start(
        wiki_counts(edits, **query), sink, checkpoint, _mode(query), every,
        name=topics.WIKI_TOPIC,
    )

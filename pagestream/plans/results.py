"""What the charts show: keyed results per topic, and the latest events."""

from pagestream.operators import filters, ranking
from pagestream.streaming import runner, sinks, tables

SERVED, CHARTED = 100, 10


def result_view(messages, n=SERVED, latest=False):
    """`n` largest values per known topic, smallest first within a topic."""
    known = filters.known_topics(messages)
    keyed = ranking.latest_per_key(known) if latest else ranking.max_per_key(known)
    return ranking.shown_order(ranking.top_per_topic(keyed, n))


def shares(messages, n=CHARTED):
    """The shown keys of each topic with their percentage of what is shown."""
    return kept_shares(ranking.max_per_key(filters.known_topics(messages)), n)


def kept_shares(keyed, n=CHARTED):
    """The same from one value per topic and key, as a kept view has them."""
    return ranking.share_of_topic(ranking.top_per_topic(keyed.select("topic", "key", "value"), n))


def latest_events(events, n=20):
    rows = events.select("e.id", "e.timestamp", "e.wiki", "e.title", "e.type")
    return ranking.latest_rows(rows.withColumnRenamed("id", "event_id"), n)


def start_result_view(message_stream, folder, checkpoint, n=SERVED, latest=False, every=None,
                      drain=False, order=("offset", "sent_at"), shares_folder=None):
    """Keep the view over the stream; returns the table and the running query.

    `shares_folder` gets the shares of what the view holds after each batch, in slots as
    the table has them.
    """
    table = tables.latest_results(folder, order) if latest else tables.largest_results(folder, n)

    def handle(batch, batch_id):
        table.update(batch, batch_id)
        if shares_folder:
            shown = kept_shares(table.after(batch.sparkSession, batch_id))
            shown.write.mode("overwrite").parquet(table.slot(shares_folder, batch_id))

    query = runner.start(
        filters.known_topics(message_stream), sinks.batch_sink(handle), checkpoint,
        every=every, drain=drain,
    )
    return table, query


def start_latest_events(event_stream, folder, checkpoint, n=20, every=None, drain=False):
    table = tables.latest_events(folder, n)
    query = runner.start(
        event_stream, sinks.batch_sink(table.update), checkpoint, every=every, drain=drain
    )
    return table, query

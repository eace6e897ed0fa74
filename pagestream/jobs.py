"""The jobs of the application, for spark-submit:

    PYTHONPATH=. spark-submit --packages <Kafka connector> pagestream/jobs.py \\
        --servers host:9092 --checkpoints hdfs:///jobs count

    count    the four counting queries side by side
    ingest   change events, looked up in a category table, to the edit topic
    replay   files of a dump, by name, to the page-view topic, one per interval
    tail     the last lines of a dump to the page-view topic
    split    a dump into files of a number of lines, in line order
    view     the largest or last result per key, kept over the result topics
    events   the newest change events, kept over their topic
    expand   a dump to single dated views, as CSV

With `--topics-folder` in place of `--servers` topics are folders of files.
"""

import argparse
import time

from pyspark.sql import types as T

from pagestream.operators import parse
from pagestream.operators.expand import partitions_for
from pagestream.plans import dumps, edits, expansion, page_views, results
from pagestream.schemas import CATEGORY
from pagestream.session import build_session
from pagestream.sources import files, topics
from pagestream.streaming import runner, sinks
from pagestream.streaming.brokers import FileTopics, KafkaTopics


def start_counts(spark, broker, checkpoints, wanted=topics.RESULT_TOPICS,
                 sliding_every="60 seconds", partitions=None, bounded=None, shared=False):
    """Start the wanted queries, each with its own checkpoint, without waiting.

    With `bounded`, a folder, the rankings of pages and of categories keep their tables
    there: bounded state for sliding windows, panes for categories, and the changed pages
    only for the cumulative ranking, which then needs counts that are not negative.
    With `shared` too, both queries over edits, if wanted, are one that reads the topic once.
    """
    if shared and not bounded:
        raise ValueError("shared needs the folder of bounded")
    views = parse.parse_views(broker.lines(spark, topics.PAGE_VIEW_TOPIC))
    edit_rows = parse.parse_edits(broker.lines(spark, topics.EDIT_TOPIC))
    starts = {
        topics.TOP_PAGES_TOPIC: lambda *to: page_views.start_top_pages(views, *to),
        topics.TOP_PAGES_SLIDING_TOPIC: lambda *to: page_views.start_top_pages_sliding(
            views, *to, every=sliding_every
        ),
        topics.TOP_CATEGORIES_TOPIC: lambda *to: edits.start_top_categories(edit_rows, *to),
        topics.WIKI_TOPIC: lambda *to: edits.start_wiki_counts(edit_rows, *to),
    }
    def kept(start, rows, topic, **more):
        return lambda _, checkpoint: start(
            rows, f"{bounded}/{topic}", lambda out, batch_id: broker.write_results(out, topic, batch_id),
            f"{checkpoint}-bounded", **more,
        )

    if bounded:
        for topic, start, rows, more in (
            (topics.TOP_PAGES_TOPIC, page_views.start_top_pages_bounded, views, {}),
            (topics.TOP_PAGES_SLIDING_TOPIC, page_views.start_top_windows, views, {"every": sliding_every}),
            (topics.TOP_CATEGORIES_TOPIC, edits.start_category_panes, edit_rows, {}),
        ):
            starts[topic] = kept(start, rows, topic, **more)
    if shared and {topics.TOP_CATEGORIES_TOPIC, topics.WIKI_TOPIC} <= set(wanted):
        wanted = [name for name in wanted if name != topics.WIKI_TOPIC]
        starts[topics.TOP_CATEGORIES_TOPIC] = lambda *_: edits.start_shared_counts(
            edit_rows, f"{bounded}/edits", broker.write_results, f"{checkpoints}/edits-shared"
        )
    with runner.state_partitions(spark, partitions):
        return [
            starts[name](broker.result_sink(name), f"{checkpoints}/{name}") for name in wanted
        ]


def start_ingest(spark, broker, checkpoints, categories, events_topic, by_batch=False, parts=None):
    """`categories` is a table with the columns of `schemas.CATEGORY`.

    `by_batch` looks for hot titles in each micro-batch and cuts them. With `parts` the table
    is laid out by `sinks.write_by_hash` in that many parts, and a batch reads its own only.
    """
    events = broker.lines(spark, events_topic)
    if by_batch or parts:
        return edits.start_edit_lines_by_batch(
            events, categories,
            lambda rows, batch_id: broker.write_lines(rows, topics.EDIT_TOPIC, "ingest-by-batch", batch_id),
            f"{checkpoints}/ingest-by-batch", parts=parts,
        )
    sink = broker.line_sink(topics.EDIT_TOPIC, "ingest")
    return edits.start_edit_lines(events, categories, sink, f"{checkpoints}/ingest")


def start_replay(spark, broker, checkpoints, folder, every="60 seconds"):
    return dumps.replay_dump(
        spark, folder, lambda rows, batch_id: broker.write_lines(rows, topics.PAGE_VIEW_TOPIC, "replay", batch_id),
        f"{checkpoints}/replay", every=every,
    )


def tail(spark, broker, dump, n=200):
    """Each call adds its lines, also to a file topic."""
    lines = dumps.last_lines(spark, dump, n)
    broker.write_lines(lines, topics.PAGE_VIEW_TOPIC, "tail", time.time_ns())


def start_view(spark, broker, checkpoints, folder, n=results.SERVED, latest=False, shares=None, drain=False):
    _, query = results.start_result_view(
        broker.results(spark), folder, f"{checkpoints}/view", n, latest, drain=drain,
        order=broker.result_order, shares_folder=shares,
    )
    return query


def start_events(spark, broker, checkpoints, folder, events_topic, n=20, drain=False):
    events = parse.parse_change_events(broker.lines(spark, events_topic))
    _, query = results.start_latest_events(events, folder, f"{checkpoints}/events", n, drain=drain)
    return query


def expand(spark, dump, categories, out, **span):
    views = expansion.with_row_id(files.scan_views(spark, dump))
    partitions = partitions_for(views)
    rows = expansion.single_views(views, expansion.labels_of(categories), partitions=partitions, **span)
    counted = expansion.view_dates(views, partitions=partitions, **span)
    within = {name: at for name, at in span.items() if name in ("start", "end")}
    sinks.write_indexed_csv(expansion.sorted_views(rows, partitions=partitions, counted=counted, **within), out)


def _options():
    options = argparse.ArgumentParser(
        description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter
    )
    where = options.add_mutually_exclusive_group()
    where.add_argument("--servers", default="localhost:9092")
    where.add_argument("--topics-folder")
    options.add_argument("--checkpoints", required=True, help="a folder that all machines share")
    jobs = options.add_subparsers(dest="job", required=True)
    count = jobs.add_parser("count")
    count.add_argument("--queries", nargs="+", default=topics.RESULT_TOPICS, choices=topics.RESULT_TOPICS)
    count.add_argument("--sliding-every", default="60 seconds")
    count.add_argument("--state-partitions", type=int)
    count.add_argument("--bounded", metavar="FOLDER", help="rankings from tables kept here, with less state")
    count.add_argument("--shared", action="store_true", help="with --bounded: both queries over edits from one read")
    ingest = jobs.add_parser("ingest")
    ingest.add_argument("--categories", required=True)
    ingest.add_argument("--events-topic", required=True)
    ingest.add_argument("--by-batch", action="store_true", help="cut titles that are hot in a batch")
    ingest.add_argument("--parts", type=int, help="the table lies in this many parts by hash; a batch reads its own")
    replay = jobs.add_parser("replay")
    replay.add_argument("folder")
    replay.add_argument("--every", default="60 seconds")
    view = jobs.add_parser("view")
    view.add_argument("folder")
    view.add_argument("-n", type=int, default=results.SERVED)
    view.add_argument("--latest", action="store_true", help="last value per key, not the largest")
    view.add_argument("--shares", help="a folder for the shares of the charted keys")
    last = jobs.add_parser("tail")
    last.add_argument("dump")
    last.add_argument("-n", type=int, default=200)
    split = jobs.add_parser("split")
    split.add_argument("dump")
    split.add_argument("out")
    split.add_argument("--rows-per-file", type=int, default=dumps.ROWS_PER_FILE)
    events = jobs.add_parser("events")
    events.add_argument("folder")
    events.add_argument("--events-topic", required=True)
    events.add_argument("-n", type=int, default=20)
    expanding = jobs.add_parser("expand")
    expanding.add_argument("dump")
    expanding.add_argument("out")
    expanding.add_argument("--categories", required=True)
    return options


def main(arguments=None):
    chosen = _options().parse_args(arguments)
    spark = build_session()
    broker = FileTopics(chosen.topics_folder) if chosen.topics_folder else KafkaTopics(chosen.servers)
    known = None
    if getattr(chosen, "categories", None):
        laid_out = getattr(chosen, "parts", None)
        schema = T.StructType([*CATEGORY.fields, T.StructField("part", T.IntegerType())]) if laid_out else CATEGORY
        known = spark.read.schema(schema).parquet(chosen.categories)
    if chosen.job == "expand":
        return expand(spark, chosen.dump, known, chosen.out)
    if chosen.job == "tail":
        return tail(spark, broker, chosen.dump, chosen.n)
    if chosen.job == "split":
        return dumps.split_files(spark, chosen.dump, chosen.out, chosen.rows_per_file)
    to = (spark, broker, chosen.checkpoints)
    if chosen.job == "count":
        start_counts(*to, chosen.queries, chosen.sliding_every, chosen.state_partitions, chosen.bounded, chosen.shared)
    elif chosen.job == "ingest":
        start_ingest(*to, known, chosen.events_topic, chosen.by_batch, chosen.parts)
    elif chosen.job == "replay":
        start_replay(*to, chosen.folder, chosen.every)
    elif chosen.job == "events":
        start_events(*to, chosen.folder, chosen.events_topic, chosen.n)
    else:
        start_view(*to, chosen.folder, chosen.n, chosen.latest, chosen.shares)
    runner.await_any(spark)


if __name__ == "__main__":
    main()

"""Every checked query: name -> function of (spark, sf_dir) giving a DataFrame."""

from pyspark.sql import functions as F

from pagestream.functions import dates, text
from pagestream.operators import aggregates, categories, expand, filters, joins, messages, ordering, parse, ranking
from pagestream.plans import dumps, edits, expansion, page_views, results
from pagestream.schemas import CATEGORY_REPLY, VIEW
from pagestream.session import run_dir
from pagestream.sources import files, json_objects, topics
from pagestream.streaming import runner, sinks, tables
from workload import inputs

QUERIES = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


# Streams over the given tables.


def _in_time_order(rows, time, chunks=3):
    """The rows in a few steps of time, as they would have come in."""
    first, last = rows.agg(F.min(time), F.max(time)).first()
    step = (last - first) // chunks + 1
    for at in range(chunks):
        low = first + at * step
        yield rows.where((F.col(time) >= low) & (F.col(time) < low + step))


def _stream(spark, name, rows, time, build, mode, sink=None, timed=False, keep=()):
    """Feed the `value` lines step by step to a stream that ends and starts again
    on its checkpoint for each step; returns the folder of its output.

    `timed` lines carry their time in a column beside them, as messages of a broker do, and
    what else `keep` names, as text.
    """
    base = run_dir(spark, name)
    for step in _in_time_order(rows, time):
        if timed:
            step.select(time, *keep, "value").write.mode("append").parquet(f"{base}/in")
            schema = ", ".join([f"{time} bigint", *(f"{name} string" for name in keep), "value string"])
            stream = build(spark.readStream.schema(schema).parquet(f"{base}/in"))
        else:
            step.select("value").write.mode("append").text(f"{base}/in")
            stream = build(topics.line_stream(spark, f"{base}/in"))
        runner.drain(
            stream, sink(f"{base}/out") if sink else sinks.batch_folder_sink(f"{base}/out"),
            f"{base}/checkpoint", mode, spark.sparkContext.defaultParallelism,
        )
    return f"{base}/out"


def _last_complete(spark, folder):
    rows = spark.read.parquet(folder)
    last = rows.agg(F.max("batch_id")).first()[0]
    return rows.where(F.col("batch_id") == last).drop("batch_id")


def _last_update(spark, folder):
    rows = aggregates.with_window_seconds(spark.read.parquet(folder))
    return rows.groupBy("key", "window_start").agg(F.max_by("value", "batch_id").alias("value"))


def _parse_timed(lines):
    rows = parse.parse_views(lines, keep=["ts"])
    return rows.withColumn("event_time", F.timestamp_seconds("ts"))


# Parsing.


@query
def parse_views(spark, sf_dir):
    return parse.parse_views(inputs.view_lines(spark, sf_dir))


@query
def parse_views_malformed(spark, sf_dir):
    return parse.parse_views(inputs.mixed_view_lines(spark, sf_dir))


@query
def parse_edits(spark, sf_dir):
    return parse.parse_edits(inputs.edit_lines(spark, sf_dir))


@query
def change_event_parse(spark, sf_dir):
    return parse.parse_change_events(inputs.change_event_json(spark, sf_dir)).select(
        F.col("e.id").alias("event_id"), "e.type", "e.title", "e.timestamp", "e.wiki",
        F.col("e.meta.domain").alias("domain"), F.col("e.length.new").alias("new_length"),
        F.col("e.patrolled").alias("patrolled"), F.col("e.comment").alias("comment"),
    )


@query
def json_concat_scan(spark, sf_dir):
    """Objects side by side, indented, unindented and pretty, in one folder."""
    folder = run_dir(spark, "json-objects")
    inputs.mixed_json_objects(spark, sf_dir).write.option("lineSep", " ").text(folder)
    return json_objects.scan_json_objects(spark, folder).select(
        F.col("e.id").alias("event_id"), "e.type", "e.title", "e.timestamp", "e.wiki",
        F.col("e.meta.domain").alias("domain"), F.col("e.length.new").alias("new_length"),
        F.col("e.comment").alias("comment"),
    )


# Page views.


@query
def top_resource(spark, sf_dir):
    views = parse.parse_views(inputs.view_lines(spark, sf_dir))
    return page_views.top_pages(views)


@query
def page_totals(spark, sf_dir):
    return aggregates.total_by(inputs.views(spark, sf_dir), "curr", "n")


@query
def top_resource_stream(spark, sf_dir):
    lines = inputs.view_lines(spark, sf_dir, keep=["ts"])
    out = _stream(
        spark, "top_resource", lines, "ts",
        lambda rows: page_views.top_pages(parse.parse_views(rows)), "complete",
    )
    return _last_complete(spark, out)


@query
def top_resource_bounded_stream(spark, sf_dir):
    """The same in update mode: a kept table of the largest."""
    table, last = tables.top_keys(run_dir(spark, "top-keys"), 10), {}

    def sink(_out):
        def handle(batch, batch_id):
            table.update(batch, batch_id)
            last["batch"] = batch_id

        return sinks.batch_sink(handle)

    _stream(
        spark, "top_resource_bounded", inputs.view_lines(spark, sf_dir, keep=["ts"]), "ts",
        lambda rows: page_views.running_page_totals(parse.parse_views(rows)), "update", sink,
    )
    return messages.to_message(table.after(spark, last["batch"]), "key")


@query
def view_window_sum(spark, sf_dir):
    sums = page_views.page_windows(inputs.timed_views(spark, sf_dir), "event_time")
    return aggregates.with_window_seconds(sums)


@query
def processing_time_windows(spark, sf_dir):
    """Windows by the clock differ from run to run; what is in them does not."""
    sums = page_views.page_windows(inputs.views(spark, sf_dir))
    return sums.groupBy("curr").agg(
        F.count(F.lit(1)).alias("windows"), F.sum("value").alias("value")
    )


@query
def top_resource_sliding(spark, sf_dir):
    top = page_views.top_pages_sliding(inputs.timed_views(spark, sf_dir), "event_time")
    return aggregates.with_window_seconds(top)


@query
def top_resource_sliding_stream(spark, sf_dir):
    out = _stream(
        spark, "top_resource_sliding", inputs.view_lines(spark, sf_dir, keep=["ts"]), "ts",
        lambda rows: page_views.top_pages_sliding(_parse_timed(rows), "event_time"), "complete",
        timed=True,
    )
    return aggregates.with_window_seconds(_last_complete(spark, out))


@query
def top_resource_sliding_bounded_stream(spark, sf_dir):
    """The same from bounded state: open windows, and the top of the closed ones."""
    table = tables.top_windows(run_dir(spark, "top-windows"), 20, 240, 240)
    kept = _kept_windows(spark, sf_dir, "top-windows-stream", table)
    top = page_views.window_messages(page_views.top_of_latest_windows(kept))
    return aggregates.with_window_seconds(top)


@query
def top_resource_latest_windows(spark, sf_dir):
    """Only the newest five windows compete, with bounded state."""
    table = tables.latest_windows(run_dir(spark, "latest-windows"), k=5, slide_seconds=120)
    return page_views.top_of_latest_windows(_kept_windows(spark, sf_dir, "latest-windows-stream", table))


def _kept_windows(spark, sf_dir, name, table):
    """The table as the stream of all view lines leaves it."""
    last = {}

    def sink(_out):
        def handle(batch, batch_id):
            table.update(batch, batch_id)
            last["batch"] = batch_id

        return sinks.batch_sink(handle)

    _stream(
        spark, name, inputs.view_lines(spark, sf_dir, keep=["ts"]), "ts",
        lambda rows: page_views.running_page_windows(_parse_timed(rows), "event_time"),
        "update", sink, timed=True,
    )
    return table.after(spark, last["batch"])


# Edits.


SHOWN = ("id", "timestamp", "wiki", "title")


def _events(spark, sf_dir):
    return parse.parse_change_events(inputs.change_event_json(spark, sf_dir), fields=SHOWN)


@query
def category_noise_filter(spark, sf_dir):
    return filters.without_noise(filters.of_wiki(inputs.edits(spark, sf_dir)))


@query
def event_top_categories(spark, sf_dir):
    return aggregates.with_window_seconds(edits.top_categories(inputs.edits(spark, sf_dir)))


@query
def event_top_categories_stream(spark, sf_dir):
    """State per pane; the windows that a batch changed are made of the kept panes."""
    lines = inputs.edit_lines(spark, sf_dir, keep=["timestamp"])
    panes = tables.OpenPanes(run_dir(spark, "open-panes"), 1800, 120, 1800)

    def sink(out):
        return sinks.batch_sink(edits.pane_handler(
            panes, lambda rows, batch_id: rows.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        ))

    out = _stream(
        spark, "event_top_categories", lines, "timestamp",
        lambda rows: edits.category_panes(parse.parse_edits(rows)), "update", sink,
    )
    return _last_update(spark, out)


@query
def event_top_categories_copied_stream(spark, sf_dir):
    """The same with each row copied into its windows, in Spark's own state."""
    lines = inputs.edit_lines(spark, sf_dir, keep=["timestamp"])
    out = _stream(
        spark, "event_top_categories", lines, "timestamp",
        lambda rows: edits.top_categories(parse.parse_edits(rows)), "update",
    )
    return _last_update(spark, out)


@query
def event_top_categories_closed_stream(spark, sf_dir):
    """Final counts of the windows the watermark has passed."""
    lines = inputs.edit_lines(spark, sf_dir, keep=["timestamp"])
    out = _stream(
        spark, "event_top_categories_closed", lines, "timestamp",
        lambda rows: edits.top_categories(parse.parse_edits(rows), closed_only=True), "append",
    )
    return aggregates.with_window_seconds(spark.read.parquet(out)).drop("batch_id")


@query
def event_wikitype(spark, sf_dir):
    return aggregates.with_window_seconds(edits.wiki_counts(inputs.edits(spark, sf_dir)))


@query
def event_wikitype_stream(spark, sf_dir):
    lines = inputs.edit_lines(spark, sf_dir, keep=["timestamp"])
    out = _stream(
        spark, "event_wikitype", lines, "timestamp",
        lambda rows: edits.wiki_counts(parse.parse_edits(rows)), "update",
    )
    return _last_update(spark, out)


@query
def edit_counts_shared_stream(spark, sf_dir):
    """Most edited categories and edits per wiki from one read and one aggregation of the edits."""
    lines = inputs.edit_lines(spark, sf_dir, keep=["timestamp"])
    base = run_dir(spark, "edit-counts-shared")
    for step in _in_time_order(lines, "timestamp"):
        step.select("value").write.mode("append").text(f"{base}/in")
        with runner.state_partitions(spark, spark.sparkContext.defaultParallelism):
            edits.start_shared_counts(
                parse.parse_edits(topics.line_stream(spark, f"{base}/in")), f"{base}/kept",
                lambda rows, topic, batch_id: rows.write.mode("overwrite").parquet(
                    f"{base}/out/topic={topic}/batch_id={batch_id}"
                ),
                f"{base}/checkpoint", every=None, drain=True,
            ).awaitTermination()
    rows = aggregates.with_window_seconds(spark.read.parquet(f"{base}/out"))
    return rows.groupBy("topic", "key", "window_start").agg(F.max_by("value", "batch_id").alias("value"))


@query
def event_wikitype_distinct(spark, sf_dir):
    counts = edits.wiki_counts(inputs.edits(spark, sf_dir), threshold=5, distinct_edits=True)
    return aggregates.with_window_seconds(counts)


@query
def event_wikitype_distinct_stream(spark, sf_dir):
    lines = inputs.edit_lines(spark, sf_dir, keep=["timestamp"])
    out = _stream(
        spark, "event_wikitype_distinct", lines, "timestamp",
        lambda rows: edits.wiki_counts(parse.parse_edits(rows), threshold=5, distinct_edits=True),
        "update",
    )
    return _last_update(spark, out)


@query
def event_wikitype_distinct_id_stream(spark, sf_dir):
    """Edits told apart by the id that their messages carry."""
    out = _stream(
        spark, "event_wikitype_distinct_id", inputs.edit_messages(spark, sf_dir, keep=["timestamp"]), "timestamp",
        lambda rows: edits.wiki_counts(
            parse.parse_edits(rows, keep=["key"]), threshold=5, distinct_edits=True, edit_id="key"
        ),
        "update", timed=True, keep=["key"],
    )
    return _last_update(spark, out)


@query
def edit_filter_project(spark, sf_dir):
    return filters.edits_only(_events(spark, sf_dir))


def _edits_only(spark, sf_dir):
    return filters.edits_only(_events(spark, sf_dir))


@query
def category_enrich(spark, sf_dir):
    return edits.enriched_edits(
        inputs.change_event_json(spark, sf_dir), inputs.categories(spark, sf_dir)
    )


@query
def category_enrich_cut(spark, sf_dir):
    """Two fifths of the edits on one page, found and cut."""
    hot = F.when(F.col("wiki").isin("enwiki", "frwiki"), "Page_1").otherwise(F.col("title"))
    rows = _edits_only(spark, sf_dir).withColumn("title", hot)
    return categories.with_categories(
        rows, inputs.categories(spark, sf_dir), hot_edits=joins.hot_values(rows, "title"),
        edit_id="event_id",
    )


@query
def category_first_page(spark, sf_dir):
    replies = inputs.category_replies(spark, sf_dir).select(
        "reply_id", F.from_json("value", CATEGORY_REPLY).alias("reply")
    )
    return categories.first_page_categories(replies, keep=["reply_id"])


@query
def edit_lines(spark, sf_dir):
    return edits.edit_lines(
        inputs.change_event_json(spark, sf_dir), inputs.categories(spark, sf_dir)
    )


@query
def edit_lines_stream(spark, sf_dir):
    known = inputs.categories(spark, sf_dir)
    out = _stream(
        spark, "edit_lines", inputs.change_event_json(spark, sf_dir, keep=["timestamp"]),
        "timestamp", lambda rows: edits.edit_lines(rows, known), "append", sinks.line_folder_sink,
    )
    return spark.read.text(out)


def _by_batch(spark, sf_dir, known, parts=None):
    base = run_dir(spark, "edit-lines-by-batch")
    events = inputs.change_event_json(spark, sf_dir)
    events.write.option("maxRecordsPerFile", 50_000).text(f"{base}/in")
    edits.start_edit_lines_by_batch(
        topics.line_stream(spark, f"{base}/in", 1), known,
        lambda rows, batch_id: rows.write.mode("overwrite").text(f"{base}/out/batch_id={batch_id}"),
        f"{base}/checkpoint", drain=True, parts=parts,
    ).awaitTermination()
    return spark.read.text(f"{base}/out").select("value")


@query
def edit_lines_by_batch_stream(spark, sf_dir):
    """Hot titles found and cut in each micro-batch."""
    return _by_batch(spark, sf_dir, inputs.categories(spark, sf_dir))


@query
def edit_lines_by_part_stream(spark, sf_dir):
    """Each micro-batch reads the parts of the category table that its titles lie in."""
    folder, parts = run_dir(spark, "categories-by-hash"), 64
    sinks.write_by_hash(inputs.categories(spark, sf_dir), folder, "title", parts)
    return _by_batch(spark, sf_dir, spark.read.parquet(folder), parts)


# Results.


@query
def result_view_max_per_key(spark, sf_dir):
    return ranking.max_per_key(filters.known_topics(inputs.results(spark, sf_dir)))


@query
def result_view_latest_per_key(spark, sf_dir):
    return ranking.latest_per_key(filters.known_topics(inputs.results(spark, sf_dir)))


@query
def result_top_n(spark, sf_dir):
    return results.result_view(inputs.results(spark, sf_dir))


@query
def result_share(spark, sf_dir):
    return results.shares(inputs.results(spark, sf_dir))


def _result_topics(spark, sf_dir):
    """The result messages as file topics, one folder per topic and batch."""
    folder = run_dir(spark, "result-topics")
    window = F.struct(F.timestamp_seconds("offset").alias("start"))
    rows = inputs.results(spark, sf_dir).withColumns({"batch_id": F.col("offset") % 4, "window": window})
    rows.drop("offset").write.partitionBy("topic", "batch_id").parquet(folder)
    return folder


@query
def result_topics_scan(spark, sf_dir):
    return topics.file_results(spark, _result_topics(spark, sf_dir)).drop("sent_at")


@query
def result_view_stream(spark, sf_dir):
    base = run_dir(spark, "result-view")
    messages_in = topics.file_result_stream(
        spark, _result_topics(spark, sf_dir), files_per_trigger=5
    )
    table, running = results.start_result_view(
        messages_in, f"{base}/view", f"{base}/checkpoint", drain=True
    )
    running.awaitTermination()
    return ranking.top_per_topic(table.after(spark, runner.last_batch(running)))


@query
def result_view_latest_stream(spark, sf_dir):
    """The last value of each key; a batch holds several windows of a key."""
    base = run_dir(spark, "latest-view")
    messages_in = topics.file_result_stream(spark, _result_topics(spark, sf_dir), files_per_trigger=5)
    table, running = results.start_result_view(
        messages_in, f"{base}/view", f"{base}/checkpoint", latest=True, drain=True
    )
    running.awaitTermination()
    kept = table.after(spark, runner.last_batch(running))
    return ranking.top_per_topic(kept.select("topic", "key", "value"))


@query
def latest_events(spark, sf_dir):
    return results.latest_events(_events(spark, sf_dir))


@query
def latest_events_stream(spark, sf_dir):
    base = run_dir(spark, "latest-events")
    inputs.change_event_json(spark, sf_dir).write.option("maxRecordsPerFile", 50_000).text(f"{base}/in")
    events = parse.parse_change_events(topics.line_stream(spark, f"{base}/in", 1), fields=SHOWN)
    table, running = results.start_latest_events(
        events, f"{base}/view", f"{base}/checkpoint", drain=True
    )
    running.awaitTermination()
    return table.after(spark, runner.last_batch(running))


# Expansion.


@query
def page_terms(spark, sf_dir):
    return categories.page_terms(inputs.categories(spark, sf_dir))


@query
def page_main_category(spark, sf_dir):
    return expansion.labels_of(inputs.categories(spark, sf_dir))


@query
def view_enrich(spark, sf_dir):
    labels = expansion.labels_of(inputs.categories(spark, sf_dir))
    views = inputs.titled_views(spark, sf_dir).select(*VIEW.names, "row_id")
    return categories.with_main_category(views, labels, row_id="row_id")


@query
def view_enrich_cut(spark, sf_dir):
    """The label of the page a view came from; a third came from one, found and cut."""
    labels = expansion.labels_of(inputs.categories(spark, sf_dir))
    origin = F.when(F.col("prev") == "other-search", "Page_1").otherwise(
        F.regexp_replace("prev", "^supp-", "Page_")
    )
    views = inputs.views(spark, sf_dir).select("row_id", "n", origin.alias("curr"))
    found = joins.hot_values(views, "curr")
    return categories.with_main_category(views, labels, found, row_id="row_id")


def _expanded(spark, sf_dir, partitions=None):
    labels = expansion.labels_of(inputs.categories(spark, sf_dir))
    return expansion.single_views(inputs.titled_views(spark, sf_dir), labels, partitions=partitions)


def _sorted(spark, sf_dir):
    views = inputs.titled_views(spark, sf_dir)
    partitions = expand.partitions_for(views)
    counted = expansion.view_dates(views, partitions=partitions)
    return expansion.sorted_views(_expanded(spark, sf_dir, partitions), partitions=partitions, counted=counted)


def _weight(*columns):
    """16 bits of a hash, so that a sum over rows checks every column of each."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *columns)), 1, 4), 16, 10).cast("bigint")


_LOW_HALF = (1 << 32) - 1


def _halves_summed(term):
    """The sums `high` and `low` of the two halves of a bigint, which don't overflow where their whole does."""
    return F.sum(F.shiftright(term, 32)).alias("high"), F.sum(term.bitwiseAND(_LOW_HALF)).alias("low")


def _from_halves(high, low):
    """The sum of the whole terms, modulo 2**64 where it doesn't fit a bigint."""
    carried = F.col(high) + F.shiftright(low, 32)
    return F.shiftleft(carried, 32).bitwiseOR(F.col(low).bitwiseAND(_LOW_HALF))


@query
def expand_views(spark, sf_dir):
    """All single views, summed up per page, link and day to compare them."""
    second = dates.seconds_between(F.lit("2021-05-01 00:00:00").cast("timestamp_ntz"), F.col("date"))

    def per_day(rows):
        return rows.groupBy("curr", "link", "category", F.dayofmonth("date").alias("day")).agg(
            F.count(F.lit(1)).alias("views"),
            F.min("date").alias("first_date"), F.max("date").alias("last_date"),
            F.sum(second).alias("seconds"),
            F.sum(second * _weight("prev", "curr", "link", "category")).alias("checksum"),
        ).withColumns({c: dates.date_text(F.col(c)) for c in ("first_date", "last_date")})

    labels = expansion.labels_of(inputs.categories(spark, sf_dir))
    return expansion.rolled_up(inputs.titled_views(spark, sf_dir), labels, per_day)


@query
def expand_views_sorted(spark, sf_dir):
    """Positions in the order of dates, summed up per hour to compare them."""
    term = F.col("idx") * _weight("prev", "curr", "link", "date", "category")

    def per_hour(rows):
        return rows.groupBy(F.substring("date", 1, 13).alias("hour")).agg(
            F.count(F.lit(1)).alias("views"),
            F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"),
            *_halves_summed(term),
        )

    labels = expansion.labels_of(inputs.categories(spark, sf_dir))
    slices = expansion.rolled_up_in_order(inputs.titled_views(spark, sf_dir), labels, per_hour)
    sums = slices.groupBy("hour").agg(
        F.sum("views").alias("views"), F.min("first_idx").alias("first_idx"), F.max("last_idx").alias("last_idx"),
        F.sum("high").alias("high"), F.sum("low").alias("low"),
    )
    return sums.select("hour", "views", "first_idx", "last_idx", _from_halves("high", "low").alias("checksum"))


@query
def date_functions(spark, sf_dir):
    start = dates.parse_date(F.lit(expand.START))
    written = F.date_format("o_orderdate", "MM/dd/yyyy hh:mm a")
    moment = dates.parse_date(written)
    span = dates.seconds_between(start, moment)
    return inputs.table(spark, sf_dir, "orders").select(
        "o_orderkey", span.alias("span"),
        dates.date_text(dates.plus_seconds(start, span + F.col("o_custkey"))).alias("moved"),
        F.unix_seconds(dates.event_time(F.col("o_custkey"))).alias("epoch"),
    )


@query
def text_functions(spark, sf_dir):
    category = F.concat(F.lit("Category:A Category:"), F.col("o_orderpriority"))
    return inputs.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        text.leading_int(F.col("o_orderpriority")).alias("leading"),
        text.leading_int(F.col("o_orderstatus")).alias("no_leading"),
        text.strip_category_prefix(category).alias("stripped"),
        text.all_digits(F.col("o_orderkey").cast("string")).alias("digits"),
        text.all_digits(F.col("o_orderpriority")).alias("no_digits"),
        text.joined(" ", F.col("o_orderstatus"), F.lit(None), F.col("o_custkey")).alias("spaced"),
    )


# Files.


@query
def csv_roundtrip(spark, sf_dir):
    folder = run_dir(spark, "csv")
    views = inputs.views(spark, sf_dir).select(*VIEW.names, "row_id")
    ordered = ordering.numbered_by(views, "row_id", *VIEW.names)
    sinks.write_indexed_csv(ordered, folder)
    schema = "idx bigint, prev string, curr string, link string, n bigint, row_id string"
    return (
        spark.read.schema(schema).option("header", True).option("escape", '"')
        .option("enforceSchema", True).csv(folder)
    )


def _written_views(spark, sf_dir, compression):
    folder = run_dir(spark, "tsv")
    sinks.write_views(inputs.views(spark, sf_dir).select(*VIEW.names), folder, compression)
    return folder


@query
def tsv_scan(spark, sf_dir):
    return files.scan_views(spark, _written_views(spark, sf_dir, "none"))


@query
def gzip_scan(spark, sf_dir):
    folder = _written_views(spark, sf_dir, "gzip")
    return files.scan_compressed_views(spark, folder, spark.sparkContext.defaultParallelism)


def _split(spark, sf_dir):
    base = run_dir(spark, "split")
    inputs.view_lines(spark, sf_dir).write.text(f"{base}/dump")
    dumps.split_files(spark, f"{base}/dump", f"{base}/files")
    return f"{base}/files"


@query
def split_files(spark, sf_dir):
    return spark.read.text(_split(spark, sf_dir))


@query
def replay_stream(spark, sf_dir):
    """Files by name, one per batch."""
    base = run_dir(spark, "replay")
    dumps.replay_dump(
        spark, _split(spark, sf_dir),
        lambda rows, batch_id: rows.write.mode("overwrite").text(f"{base}/out/batch_id={batch_id}"),
        f"{base}/checkpoint", drain=True,
    )
    return spark.read.text(f"{base}/out").select("value")


@query
def tail_lines(spark, sf_dir):
    folder = run_dir(spark, "tail")
    inputs.view_lines(spark, sf_dir).orderBy("value").write.text(folder)
    return dumps.last_lines(spark, folder)


@query
def message_encode(spark, sf_dir):
    rows = messages.to_json_arrays(inputs.views(spark, sf_dir), "prev", "curr", "link", "n")
    return rows.select(F.col("value").cast("string").alias("value"))


"""Inputs in the shapes of `pagestream.schemas`, derived from the given tables.

The same derivations are written for the oracle in `workload.oracle`.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagestream.plans import edits as edit_plans
from pagestream.plans import page_views
from pagestream.sources import topics


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr(
        "case when l_returnflag = 'A' then 'other-search' else concat('supp-', l_suppkey) end as prev",
        "concat('part-', l_partkey) as curr",
        "case l_returnflag when 'N' then 'link' when 'R' then 'other' else 'external' end as link",
        "cast(l_quantity as bigint) as n",
        "cast(1704067200 + (l_orderkey * 37 + l_linenumber * 11) % 3600 as bigint) as ts",
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as row_id",
        "l_linenumber as line_number",
    )


def timed_views(spark, sf_dir):
    return views(spark, sf_dir).withColumn("event_time", F.timestamp_seconds("ts"))


def view_lines(spark, sf_dir, keep=()):
    rows = views(spark, sf_dir)
    line = F.concat_ws("\t", "prev", "curr", "link", F.col("n").cast("string"))
    return rows.select(*keep, line.alias("value"))


def mixed_view_lines(spark, sf_dir):
    """Lines of which only those made from line numbers 1, 2 and 3 fit."""
    rows = views(spark, sf_dir)
    start = F.concat_ws("\t", "prev", "curr", "link")
    n = F.col("n").cast("string")
    forms = {
        1: n,
        2: F.concat(n, F.lit("\t\t")),
        3: F.concat(F.lit("+"), n),
        4: F.concat(F.lit(" "), n),
        5: F.concat(n, F.lit(".0")),
        6: F.concat(n, F.lit("\r")),
        7: F.concat(n, F.lit("\tmore")),
    }
    last = reduce(
        lambda rest, form: F.when(F.col("line_number") == form[0], form[1]).otherwise(rest),
        forms.items(), F.lit(""),
    )
    return rows.select(F.concat(start, F.lit("\t"), last).cast("binary").alias("value"))


def change_events(spark, sf_dir):
    seconds = "timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"
    return table(spark, sf_dir, "events").selectExpr(
        "event_id",
        f"cast(1704067200 + floor(({seconds} - 1704067200) / 120.0) as bigint) as timestamp",
        "case event_type when 'view' then 'enwiki' when 'click' then 'frwiki'"
        " when 'purchase' then 'dewiki' when 'error' then 'commonswiki' else 'wikidatawiki' end as wiki",
        "concat('Page_', user_id) as title",
        "case when event_id % 10 < 8 then 'edit' else 'new' end as type",
        "value",
    )


def change_event_json(spark, sf_dir, pretty=False, keep=()):
    """One JSON document per event, as `value`."""
    document = F.expr("""
        named_struct(
          '$schema', '/mediawiki/recentchange/1.0.0',
          'meta', named_struct(
             'id', concat('e-', event_id), 'domain', concat(wiki, '.example'),
             'stream', 'recentchange', 'partition', 0, 'offset', event_id),
          'id', event_id, 'type', type, 'namespace', 0, 'title', title,
          'comment', 'said "so" {here}', 'timestamp', timestamp, 'user', concat('u', event_id % 97),
          'bot', event_id % 5 = 0, 'minor', event_id % 3 = 0,
          'patrolled', case when event_id % 2 = 0 then true end,
          'length', named_struct('old', event_id, 'new', event_id + 7),
          'wiki', wiki)
    """)
    text = F.to_json(document, {"pretty": str(pretty).lower()})
    return change_events(spark, sf_dir).select(*keep, text.alias("value"))


def mixed_json_objects(spark, sf_dir):
    """The events as JSON objects of five layouts, by their ids."""
    events = change_event_json(spark, sf_dir, keep=["event_id"])
    pretty = change_event_json(spark, sf_dir, pretty=True, keep=["event_id"])
    both = events.withColumn("kind", F.col("event_id") % 5).where("kind in (0, 1)").unionByName(
        pretty.withColumn("kind", F.col("event_id") % 5).where("kind > 1")
    )
    layouts = {
        1: F.concat(F.lit("  "), "value", F.lit("\n")),
        2: F.concat(F.lit("\n    "), F.replace("value", F.lit("\n"), F.lit("\n    "))),
        3: F.regexp_replace("value", r"\n\s+", "\n"),
    }
    value = F.col("value")
    for kind, layout in layouts.items():
        value = F.when(F.col("kind") == kind, layout).otherwise(value)
    return both.select(value.alias("value"))


def categories(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr(
        "inline(array("
        "  named_struct('title', concat('Page_', p_partkey), 'pos', 0,"
        "    'category', concat('Category:', p_brand), 'hidden', p_size % 7 = 0),"
        "  named_struct('title', concat('Page_', p_partkey), 'pos', 1,"
        "    'category', concat('Category:', p_type, ' stubs'), 'hidden', false),"
        "  named_struct('title', concat('Page_', p_partkey), 'pos', 2,"
        "    'category', concat('Category:', p_type, ' goods'), 'hidden', false)))"
    )


def category_replies(spark, sf_dir):
    """One lookup reply per part, as JSON text: three pages, not in order of their ids,
    of which the first or the first two may have no categories."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey as reply_id",
        """concat('{"query":{"pages":{',
             '"-1":{"title":"Missing","categories":[{"title":"Category:None"}]},',
             '"', 20 + p_partkey, '":{"title":"Second"',
             case when p_size % 2 = 0 then concat(',"categories":[{"title":"Category:', p_type, '"}]') else '' end,
             '},"', 9, '":{"title":"First"',
             case when p_size % 3 = 0 then concat(',"categories":[{"title":"Category:', p_brand,
               '"},{"title":"Category:', p_name, '"}]') else '' end,
             '}}}}') as value""",
    )


def edits(spark, sf_dir):
    """Edit x category rows, as the edit topic holds them."""
    shown = categories(spark, sf_dir).where("not hidden").selectExpr(
        "title", "replace(category, 'Category:', '') as categoryText"
    )
    kept = change_events(spark, sf_dir).where("type = 'edit'").select("timestamp", "wiki", "title")
    return kept.join(shown, "title").select("timestamp", "wiki", "title", "categoryText")


def edit_messages(spark, sf_dir, keep=()):
    """The lines with the id of their event as key."""
    shown = categories(spark, sf_dir).where("not hidden").selectExpr(
        "title", "replace(category, 'Category:', '') as categoryText"
    )
    rows = change_events(spark, sf_dir).where("type = 'edit'").join(shown, "title")
    line = F.concat_ws("\t", F.col("timestamp").cast("string"), "wiki", "title", "categoryText")
    return rows.select(*keep, F.col("event_id").cast("string").alias("key"), line.alias("value"))


def edit_lines(spark, sf_dir, keep=()):
    line = F.concat_ws("\t", F.col("timestamp").cast("string"), "wiki", "title", "categoryText")
    return edits(spark, sf_dir).select(*keep, line.alias("value"))


def results(spark, sf_dir) -> DataFrame:
    """Messages of the four result topics and of one nobody asked for."""
    timed = timed_views(spark, sf_dir)
    edit_rows = edits(spark, sf_dir)
    at = F.unix_seconds("window.start").alias("offset")
    wikis = edit_plans.wiki_counts(edit_rows).select("key", "value", at)
    parts = {
        topics.TOP_PAGES_TOPIC: page_views.top_pages(views(spark, sf_dir))
        .select("key", "value", F.lit(0).cast("bigint").alias("offset")),
        topics.TOP_PAGES_SLIDING_TOPIC: page_views.top_pages_sliding(timed, "event_time")
        .select("key", "value", at),
        topics.TOP_CATEGORIES_TOPIC: edit_plans.top_categories(edit_rows).select("key", "value", at),
        topics.WIKI_TOPIC: wikis,
        "event_unknown": wikis,
    }
    named = [rows.select(F.lit(name).alias("topic"), "*") for name, rows in parts.items()]
    return reduce(DataFrame.unionByName, named)


def titled_views(spark, sf_dir):
    """Views whose page has the title the categories know it by."""
    return views(spark, sf_dir).withColumn("curr", F.regexp_replace("curr", "^part-", "Page_"))


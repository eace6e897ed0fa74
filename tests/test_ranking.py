from pyspark.sql import functions as F

from pagestream.functions import dates
from pagestream.operators import aggregates, categories, messages, ranking
from pagestream.plans import edits, results
from pagestream.schemas import CATEGORY_REPLY


def test_ties_at_the_limit_go_by_key(spark):
    data = spark.createDataFrame([("b", 1), ("a", 1), ("c", 5), ("d", None)], "curr string, value long")
    assert [r[0] for r in ranking.top_rows(data, 2, "curr").collect()] == ["c", "a"]


def test_top_rows_keeps_n_rows_per_task(spark):
    plan = ranking.top_rows(spark.range(100).withColumnRenamed("id", "value"), 5)
    assert "TakeOrderedAndProject" in plan._jdf.queryExecution().executedPlan().toString()


def test_ranking_stays_numeric_when_values_become_text(spark):
    data = spark.createDataFrame([("a", 9), ("b", 10), ("c", 100)], "curr string, value long")
    out = messages.to_message(ranking.top_rows(data, 2, "curr"), "curr").collect()
    assert [tuple(r) for r in out] == [("c", "100"), ("b", "10")]


def test_top_per_topic_is_a_prefix_for_small_and_large_n(spark):
    data = spark.range(6000).selectExpr(
        "if(id % 3 > 0, 'hot', 'cold') as topic", "concat('k', id) as key", "id % 1000 as value"
    )
    everything = ranking.top_per_topic(data, 6000).collect()
    for n in (1, 10, 1000, 1500):
        got = {tuple(r) for r in ranking.top_per_topic(data, n).collect()}
        assert got == {tuple(r) for r in everything if r["rank"] <= n}


def test_a_topic_is_cut_before_the_shuffle(spark):
    data = spark.range(60).selectExpr("string(id % 2) as topic", "string(id) as key", "id as value")
    plan = ranking.top_per_topic(data, 10)._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and "WindowGroupLimit" in plan


def test_result_view_takes_the_largest_number_and_skips_unknown_topics(spark):
    data = spark.createDataFrame(
        [("top_resource", "a", "9", 1), ("top_resource", "a", "10", 2), ("top_resource", "a", "8", 3),
         ("top_resource", "b", "12", 1), ("other", "a", "99", 1), ("event_wikitype", "w", "x", 1)],
        "topic string, key string, value string, offset long",
    )
    def shown(**options):
        return [tuple(r)[:3] for r in results.result_view(data, **options).select("topic", "key", "value").collect()]

    assert shown() == [("event_wikitype", "w", None), ("top_resource", "a", 10), ("top_resource", "b", 12)]
    assert ("top_resource", "a", 8) in shown(latest=True)
    assert shown(n=1)[1:] == [("top_resource", "b", 12)]


def test_shares_round_half_up_to_one_decimal(spark):
    data = spark.createDataFrame(
        [("top_resource", k, v, 0) for k, v in (("a", "1"), ("b", "2"), ("c", "5"))],
        "topic string, key string, value string, offset long",
    )
    got = {r["key"]: r["share"] for r in results.shares(data).collect()}
    assert got == {"a": 12.5, "b": 25.0, "c": 62.5}
    zero = data.withColumn("value", F.lit("0"))
    assert {r["share"] for r in results.shares(zero).collect()} == {None}


def _edits(spark):
    return spark.createDataFrame(
        [(t, "enwiki", f"T{t % 4}", c) for t in range(0, 3600, 7) for c in ("Cats", "Dogs", "x stub")],
        "timestamp long, wiki string, title string, categoryText string",
    )


def test_panes_first_equals_copying_rows(spark, rows):
    timed = _edits(spark).withColumn("t", dates.event_time(F.col("timestamp")))
    for width, slide in (("30 minutes", "2 minutes"), ("5 minutes", "1 minute"), ("1 hour", "1 hour"),
                         ("5 minutes", "2 minutes")):
        panes = aggregates.windowed_count(timed, "categoryText", "t", width, slide)
        copied = timed.groupBy("categoryText", F.window("t", width, slide)).agg(F.count("*").alias("value"))
        assert rows(panes) == rows(copied)


def test_each_row_is_in_width_over_slide_windows(spark):
    counts = edits.top_categories(_edits(spark), threshold=1)
    assert counts.agg(F.sum(F.col("value").cast("long"))).first()[0] == 15 * 2 * len(range(0, 3600, 7))
    assert {r[0] for r in counts.select("key").distinct().collect()} == {"Cats", "Dogs"}


def test_thresholds_and_distinct_edits(spark):
    counts = edits.wiki_counts(_edits(spark))
    assert counts.agg(F.min(F.col("value").cast("long"))).first()[0] >= 20
    per_row = edits.wiki_counts(_edits(spark), threshold=1).agg(F.sum(F.col("value").cast("long"))).first()[0]
    per_edit = edits.wiki_counts(_edits(spark), threshold=1, distinct_edits=True)
    assert per_row == 3 * per_edit.agg(F.sum(F.col("value").cast("long"))).first()[0]


def test_first_page_with_categories(spark, rows):
    replies = spark.createDataFrame(
        [(1, '{"query":{"pages":{"30":{"title":"c","categories":[{"title":"C"}]},'
             '"4":{"title":"b","categories":[{"title":"B1"},{"title":"B2"}]},"-1":{"title":"x"}}}}'),
         (2, '{"query":{"pages":{"-1":{"title":"n","categories":[{"title":"N"}]},"7":{"title":"m"}}}}'),
         (3, '{"query":{"pages":{"7":{"title":"m"}}}}'), (4, '{"query":{}}'), (5, "{}")],
        "id int, value string",
    ).select("id", F.from_json("value", CATEGORY_REPLY).alias("reply"))
    assert rows(categories.first_page_categories(replies, keep=["id"])) == [
        (1, "b", 0, "B1"), (1, "b", 1, "B2"), (2, "n", 0, "N")
    ]
    edit = spark.createDataFrame([(9, "enwiki", "b")], "timestamp long, wiki string, title string")
    table = categories.lookup_table(replies)
    assert rows(categories.with_categories(edit, table)) == [(9, "enwiki", "b", "B1"), (9, "enwiki", "b", "B2")]


def test_main_category_is_the_most_frequent_then_the_first_seen(spark, rows):
    data = spark.createDataFrame(
        [("P", 0, "Category:1990 births", False), ("P", 1, "Category:Wikipedia people", False),
         ("P", 2, "Category:Living people", True), ("Q", 0, "Category:b a", False), ("R", 0, "Category:1990", False)],
        "title string, pos int, category string, hidden boolean",
    )
    terms = categories.page_terms(data)
    assert ("P", "people", 2) in rows(terms.select("title", "term", "count"))
    assert not [r for r in terms.collect() if r["term"] in ("1990", "Wikipedia")]
    assert rows(categories.main_categories(terms)) == [("P", "people"), ("Q", "b")]

"""A third of all rows under one key."""

from pyspark.sql import functions as F

from pagestream.operators import categories, joins


def _left(spark):
    return spark.range(9000).selectExpr(
        "id", "case when id % 3 = 0 then 'hot' when id % 900 = 1 then null"
        " else concat('k', id % 50) end as k", "'same' as payload"
    )


def _right(spark, per_key=1):
    keys = spark.range(40).selectExpr("concat('k', id) as k").union(spark.range(1).selectExpr("'hot'"))
    return keys.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(per_key))))


def test_hot_values_finds_the_key_and_its_share(spark):
    found = joins.hot_values(_left(spark), "k", share=0.05)
    assert list(found) == ["hot"]
    assert abs(found["hot"] - 1 / 3) < 0.01


def test_hot_values_of_nothing(spark):
    assert joins.hot_values(_left(spark).where("id < 0"), "k") == {}


def test_cut_joins_equal_plain_joins(spark, rows):
    left, right = _left(spark), _right(spark, 3)
    for how, hot in (
        ("inner", dict(hot_left={"hot": 0.33})),
        ("inner", dict(hot_right={"hot": 0.5, "k1": 0.2})),
        ("inner", dict(hot_left={"hot": 0.33, "k2": 0.1}, hot_right={"hot": 0.5})),
        ("left", dict(hot_left={"hot": 0.33, "absent": 0.1})),
    ):
        cut = joins.skew_join(left, right, ["k"], how, left_id="id", right_id="r", **hot)
        assert cut.columns == left.join(right, ["k"], how).columns
        assert rows(cut) == rows(left.join(right, ["k"], how)), (how, hot)


def test_a_hot_key_is_spread_over_tasks(spark, setting):
    setting("spark.sql.autoBroadcastJoinThreshold", "-1")
    setting("spark.sql.adaptive.enabled", "false")
    setting("spark.sql.shuffle.partitions", "16")

    def largest_task(frame):
        per_task = frame.groupBy(F.spark_partition_id()).count()
        return per_task.agg(F.max("count")).first()[0]

    plain = joins.skew_join(_left(spark), _right(spark), ["k"])
    cut = joins.skew_join(_left(spark), _right(spark), ["k"], hot_left={"hot": 0.33}, left_id="id")
    assert largest_task(plain) >= 3000
    assert largest_task(cut) < 2000


def test_hot_values_are_looked_for_only_without_adaptive_execution(spark, setting):
    left = _left(spark)
    assert joins.hot_unless_adaptive(left, "k") == {}
    setting("spark.sql.adaptive.skewJoin.enabled", "false")
    assert list(joins.hot_unless_adaptive(left, "k")) == ["hot"]


def test_adaptive_execution_cuts_the_enrichment_join(spark, setting):
    for key, value in {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    }.items():
        setting(key, value)
    views = _left(spark).selectExpr("id as row_id", "k as curr", "md5(cast(id as string)) as prev").repartition(8)
    labels = _right(spark).selectExpr("k as title", "'c' as category")
    joined = categories.with_main_category(views, labels, row_id="row_id")
    assert joined.where("category is null").count() == 9000 - joined.where("category = 'c'").count()
    joined.collect()
    assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()


def test_enrichment_without_adaptive_execution_gives_the_same(spark, rows, setting):
    edits = _left(spark).selectExpr("id as event_id", "id as timestamp", "'w' as wiki", "k as title")
    known = _right(spark, 2).selectExpr(
        "k as title", "r as pos", "concat('Category:', r) as category", "r = 2 and k = 'k3' as hidden"
    )
    plain = rows(categories.with_categories(edits, known))
    setting("spark.sql.adaptive.enabled", "false")
    assert rows(categories.with_categories(edits, known, edit_id="event_id")) == plain


def test_the_key_may_include_the_wiki(spark, rows):
    edits = spark.createDataFrame([(1, "a", "T"), (2, "b", "T")], "timestamp long, wiki string, title string")
    known = spark.createDataFrame(
        [("a", "T", "Category:X", False), ("b", "T", "Category:Y", True)],
        "wiki string, title string, category string, hidden boolean",
    )
    joined = categories.with_categories(edits, known, on=("wiki", "title"), hot_edits={"T": 1.0})
    assert rows(joined) == [(1, "a", "T", "X")]


def test_hot_page_is_cut_with_derived_labels(spark, setting):
    """A third of all views on one page: no task of the join gets more than a part of them."""
    from pagestream.plans import expansion

    setting("spark.sql.autoBroadcastJoinThreshold", "-1")
    setting("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    setting("spark.sql.shuffle.partitions", "16")
    setting("spark.sql.adaptive.coalescePartitions.enabled", "false")
    setting("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16k")
    setting("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "16k")
    setting("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "1.5")
    views = spark.range(12000).repartition(12).selectExpr(
        "'p' as prev", "if(id % 3 = 0, 'hot', concat('c', id)) as curr", "uuid() as link", "1L as n", "id as row_id"
    )
    pages = spark.createDataFrame(
        [("hot", 0, "Category:Stars of stars", False), ("c1", 0, "Category:Moons", False)],
        "title string, pos int, category string, hidden boolean",
    )
    joined = categories.with_main_category(views, expansion.labels_of(pages), row_id="row_id")
    placed = joined.select("curr", "link", "category", F.spark_partition_id().alias("at")).collect()
    sizes = [(at, sum(r["at"] == at for r in placed if r["curr"] == "hot")) for at in {r["at"] for r in placed}]
    assert sum(r[1] for r in sizes) == 4000
    assert max(r[1] for r in sizes) < 4000 / 3

import pytest

from pagestream.functions import text
from pagestream.operators import filters, parse
from pyspark.sql import functions as F

KEPT = {
    "a\tb\tc\t5": ("a", "b", "c", 5),
    "a\tb\tc\t5\t\t": ("a", "b", "c", 5),
    "\tb\tc\t5": ("", "b", "c", 5),
    "a\tb\tc\t+5": ("a", "b", "c", 5),
    "a\tb\tc\t-3": ("a", "b", "c", -3),
    "a\t\t\t9223372036854775807": ("a", "", "", 2**63 - 1),
    "a\\\t\"b\"\tc\t007": ("a\\", "\"b\"", "c", 7),
}
DROPPED = [
    "a\tb\tc\t", "a\tb\tc\t 5", "a\tb\tc\t5 ", "a\tb\tc\t5.0", "a\tb\tc\t5\r",
    "a\tb\tc\t9223372036854775808", "a\tb\tc\t+", "a\tb\tc\t5e1", "a\tb\tc\t--5", "a\tb\tc",
    "a\tb\tc\t5\td", "a\tb\tc\t5\t\n", "", "\t\t\t", None,
]


@pytest.mark.parametrize("kind", ["string", "binary"])
def test_views_keep_only_strict_lines(spark, rows, kind):
    lines = spark.createDataFrame([(v,) for v in [*KEPT, *DROPPED]], "value string")
    lines = lines.withColumn("value", F.col("value").cast(kind))
    assert rows(parse.parse_views(lines)) == sorted(KEPT.values(), key=repr)


def test_edits_need_a_strict_time_first(spark, rows):
    lines = spark.createDataFrame(
        [(v,) for v in ["5\tw\tt\tc", "x\tw\tt\tc", "5\tw\tt\t", "5\tw\tt\tc\t\n", " 5\tw\tt\tc"]],
        "value string",
    )
    assert rows(parse.parse_edits(lines)) == [(5, "w", "t", "c")]


def test_kept_columns_travel_along(spark, rows):
    lines = spark.createDataFrame([(7, "a\tb\tc\t1"), (8, "bad")], "at int, value string")
    assert rows(parse.parse_views(lines, keep=["at"])) == [(7, "a", "b", "c", 1)]


def test_malformed_bytes_become_replacement_characters(spark):
    lines = spark.createDataFrame([(bytearray(b"a\xff\tb\tc\t1"),)], "value binary")
    assert parse.parse_views(lines).first()["prev"] == "a�"


def test_a_line_is_split_once(spark):
    plan = parse.parse_views(spark.createDataFrame([("x",)], "value string"))
    text_of_plan = plan._jdf.queryExecution().executedPlan().toString()
    assert text_of_plan.count("split(") == 1


def test_json_that_is_none_gives_no_row(spark, rows):
    lines = spark.createDataFrame(
        [('{"id": 1, "type": "edit", "title": "T", "timestamp": 3, "wiki": "w", "more": 1}',),
         ('{"id": 2, "type": "log", "title": "T"}',), ("{broken",), ("",), ("null",), (None,)],
        "value string",
    )
    for fields in (None, ["id", "timestamp", "wiki", "title"]):
        events = parse.parse_change_events(lines, fields=fields)
        assert events.count() == 2
        assert rows(filters.edits_only(events)) == [(1, 3, "w", "T")]


def test_noise_filter_is_a_case_sensitive_substring(spark, rows):
    edits = spark.createDataFrame(
        [(c,) for c in ["NACA x", "ab stub x", "1993 births", "Cs1", "ARTICLES", "CS1 errors"]],
        "categoryText string",
    )
    assert rows(filters.without_noise(edits)) == [("1993 births",), ("ARTICLES",), ("Cs1",)]


def test_text_functions(spark):
    def one(column):
        return spark.range(1).select(column).first()[0]

    assert one(text.strip_category_prefix(F.lit("Category:A Category:B"))) == "A Category:B"
    assert one(text.strip_category_prefix(F.lit("x\nCategory:B"))) == "x\nB"
    assert one(text.leading_int(F.lit("  -12ab"))) == -12
    assert one(text.leading_int(F.lit("ab"))) is None
    assert one(text.leading_int(F.lit("99999999999999999999"))) is None
    assert one(text.all_digits(F.lit("12٣½"))) is True
    assert one(text.all_digits(F.lit("12a"))) is False
    assert one(text.tab_joined(F.lit("a"), F.lit(None), F.lit(3))) == "a\t\t3"

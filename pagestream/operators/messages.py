"""Rows to messages."""

from pyspark.sql import functions as F

from pagestream.functions import records, text


def to_message(rows, key, value="value", keep=()):
    """`key` and `value` as text. Call it after ranking, so ranking stays numeric."""
    return rows.select(
        F.col(key).alias("key"), F.col(value).cast("string").alias("value"), *keep
    )


def to_lines(rows, *columns):
    """One tab-separated `value` per row, no key."""
    return rows.select(text.tab_joined(*[F.col(c) for c in columns]).alias("value"))


def to_json_arrays(rows, *columns):
    """One JSON array as UTF-8 bytes per row."""
    return rows.select(
        F.encode(records.json_array(*[F.col(c) for c in columns]), "UTF-8").alias("value")
    )

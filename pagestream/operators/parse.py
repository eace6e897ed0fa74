"""Text to records. A line that does not fit gives no row."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagestream import schemas
from pagestream.functions import records, text


def decode_value(messages, column="value"):
    """Message bytes to text, other columns untouched; text stays as it is."""
    if dict(messages.dtypes)[column] == "binary":
        return messages.withColumn(column, text.decode_utf8(F.col(column)))
    return messages


def _once(column):
    """The column as the output of a generator.

    Filters and projections on a parsed value would each parse the text again once
    Spark has merged them; what a generator gives is computed once per row.
    """
    return F.explode(F.array(column))


def _four_fields(messages, number_at, names, keep):
    """Rows of exactly four fields whose field at `number_at` is a strict integer."""
    fields = [F.get("_fields", at) for at in range(len(names))]
    fields[number_at] = text.strict_bigint(fields[number_at])
    split = decode_value(messages).select(*keep, _once(text.tab_fields(F.col("value"))).alias("_fields"))
    fitting = split.where((F.size("_fields") == len(names)) & fields[number_at].isNotNull())
    return fitting.select(*keep, *[f.alias(name) for f, name in zip(fields, names)])


def parse_views(messages, keep=()):
    """`prev, curr, link, n` of page-view lines; `keep` names columns to carry along."""
    return _four_fields(messages, 3, schemas.VIEW.names, keep)


def parse_edits(messages, keep=()):
    """`timestamp, wiki, title, categoryText` of edit lines."""
    return _four_fields(messages, 0, schemas.EDIT.names, keep)


def parse_change_events(messages, keep=(), fields=None):
    """JSON messages to the nested record `e`, with all fields or the named ones.

    Text that is no JSON, or an event without a type, gives no row.
    """
    schema = schemas.CHANGE_EVENT
    if fields:
        schema = T.StructType([f for f in schema.fields if f.name in {"type", *fields}])
    parsed = records.parse_json(F.col("value"), schema)
    rows = decode_value(messages).select(*keep, _once(parsed).alias("e"))
    return rows.where(F.col("e.type").isNotNull())

"""JSON in and out."""

from pyspark.sql import functions as F


def parse_json(text, schema):
    """A struct of the schema; fields of it are null where the text is no JSON."""
    return F.from_json(text, schema)


def json_array(*columns):
    """The columns as one JSON array of texts."""
    return F.to_json(F.array(*[c.cast("string") for c in columns]))

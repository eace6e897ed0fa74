"""Record shapes. Every reader names its schema; nothing is inferred."""

from pyspark.sql import types as T

VIEW = T.StructType([
    T.StructField("prev", T.StringType()),
    T.StructField("curr", T.StringType()),
    T.StructField("link", T.StringType()),
    T.StructField("n", T.LongType()),
])

EDIT = T.StructType([
    T.StructField("timestamp", T.LongType()),
    T.StructField("wiki", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("categoryText", T.StringType()),
])

CATEGORY = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("pos", T.IntegerType()),
    T.StructField("category", T.StringType()),
    T.StructField("hidden", T.BooleanType()),
])

_OLD_NEW = T.StructType([
    T.StructField("old", T.LongType()),
    T.StructField("new", T.LongType()),
])

CHANGE_EVENT = T.StructType([
    T.StructField("$schema", T.StringType()),
    T.StructField("meta", T.StructType([
        T.StructField("uri", T.StringType()),
        T.StructField("request_id", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("dt", T.StringType()),
        T.StructField("domain", T.StringType()),
        T.StructField("stream", T.StringType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
    ])),
    T.StructField("id", T.LongType()),
    T.StructField("type", T.StringType()),
    T.StructField("namespace", T.IntegerType()),
    T.StructField("title", T.StringType()),
    T.StructField("comment", T.StringType()),
    T.StructField("timestamp", T.LongType()),
    T.StructField("user", T.StringType()),
    T.StructField("bot", T.BooleanType()),
    T.StructField("minor", T.BooleanType()),
    T.StructField("patrolled", T.BooleanType()),
    T.StructField("length", _OLD_NEW),
    T.StructField("revision", _OLD_NEW),
    T.StructField("server_url", T.StringType()),
    T.StructField("server_name", T.StringType()),
    T.StructField("server_script_path", T.StringType()),
    T.StructField("wiki", T.StringType()),
    T.StructField("parsedcomment", T.StringType()),
])

# Answer of a category lookup: pages by page id, each with its categories, if any.
CATEGORY_REPLY = T.StructType([
    T.StructField("query", T.StructType([
        T.StructField("pages", T.MapType(T.StringType(), T.StructType([
            T.StructField("title", T.StringType()),
            T.StructField("categories", T.ArrayType(T.StructType([
                T.StructField("title", T.StringType()),
            ]))),
        ]))),
    ])),
])

# A result topic kept as files has these columns and the folder columns
# `topic` and `batch_id`.
MESSAGE = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
])

RESULT = T.StructType([
    T.StructField("topic", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("offset", T.LongType()),
])

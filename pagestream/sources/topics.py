"""Message topics: Kafka, or the same messages kept as files.

A file topic is a folder of text files (one message per line) for input topics, and
a parquet folder `topic=<name>/batch_id=<n>` for result topics.
"""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagestream import schemas

# Names of the topics.
PAGE_VIEW_TOPIC = "wikistream"
EDIT_TOPIC = "wikievent"
TOP_PAGES_TOPIC = "top_resource"
TOP_PAGES_SLIDING_TOPIC = "top_resource_sliding"
TOP_CATEGORIES_TOPIC = "event_top_categories"
WIKI_TOPIC = "event_wikitype"
RESULT_TOPICS = (TOP_PAGES_TOPIC, TOP_PAGES_SLIDING_TOPIC, TOP_CATEGORIES_TOPIC, WIKI_TOPIC)


def kafka_options(servers, topics, fail_on_data_loss=False, **more):
    """Source options. By default a stream goes on when offsets are gone."""
    if not isinstance(topics, str):
        topics = ",".join(topics)
    return {
        "kafka.bootstrap.servers": servers,
        "subscribe": topics,
        "failOnDataLoss": str(fail_on_data_loss).lower(),
        **more,
    }


def kafka_stream(spark, servers, topics, **more):
    """Rows of (key, value, topic, partition, offset, timestamp, timestampType).

    For a large topic pass `minPartitions` to cut topic partitions into more
    tasks, and `maxOffsetsPerTrigger` to bound a micro-batch.
    """
    return spark.readStream.format("kafka").options(**kafka_options(servers, topics, **more)).load()


def line_stream(spark, folder, files_per_trigger=None):
    """The same as a stream of `value` rows from a growing folder of text files.

    Folders in it are read too, whatever their names: each writer of a topic has its own.
    """
    reader = spark.readStream.format("text").option("recursiveFileLookup", True)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder)


_FILE_RESULTS = T.StructType(
    schemas.MESSAGE.fields
    + [
        T.StructField("window", T.StructType([T.StructField("start", T.TimestampType())])),
        T.StructField("topic", T.StringType()), T.StructField("batch_id", T.LongType()),
    ]
)


def file_results(spark, folder, topics=RESULT_TOPICS):
    """Messages of several file topics with the topic name; the batch is the offset.

    One batch may hold several windows of a key: `sent_at` is the start of the window.
    `topic` is a folder column, so topics not asked for are not read.
    """
    rows = spark.read.schema(_FILE_RESULTS).parquet(folder)
    return _as_results(rows, topics)


def file_result_stream(spark, folder, topics=RESULT_TOPICS, files_per_trigger=None):
    reader = spark.readStream.schema(_FILE_RESULTS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return _as_results(reader.parquet(folder), topics)


def _as_results(rows, topics):
    return rows.where(F.col("topic").isin(*topics)).select(
        "topic", "key", "value", F.col("batch_id").alias("offset"),
        F.col("window.start").alias("sent_at"),
    )


def kafka_results(messages):
    """Text columns of result messages read by `kafka_stream`; `sent_at` is the message's time."""
    return messages.select(
        "topic",
        F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"),
        "offset",
        F.col("timestamp").alias("sent_at"),
    )

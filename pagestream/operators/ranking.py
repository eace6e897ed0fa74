"""Rankings and keyed results. Equal values are ordered by key, so results repeat."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagestream.functions import text

def top_rows(rows, n, *ties, value="value"):
    """The `n` largest values; each task keeps `n` rows, and those are merged."""
    return rows.orderBy(F.desc(value), *ties).limit(n)


def max_per_key(messages):
    """The largest number per topic and key."""
    numbers = messages.select("topic", "key", text.leading_int(F.col("value")).alias("value"))
    return numbers.groupBy("topic", "key").agg(F.max("value").alias("value"))


def latest_per_key(messages):
    """The number of the last message per topic and key."""
    number = text.leading_int(F.col("value")).alias("value")
    sent_at = ["sent_at"] if "sent_at" in messages.columns else []
    return last_of_key(messages.select("topic", "key", "offset", *sent_at, number)).drop("sent_at")


def last_of_key(numbers, order=("offset", "sent_at")):
    """Per topic and key the row that comes last by `order`, the larger value among equals.

    Columns that are not there do not count. Of file topics the offset is the batch, and
    within it the later window counts; of a broker with several partitions take
    `order=("sent_at", "offset")`, as their offsets do not compare.
    """
    place = [name for name in order if name in numbers.columns]
    last = F.max(F.struct(*place, "value")).alias("last")
    rows = numbers.groupBy("topic", "key").agg(last)
    return rows.select("topic", "key", *[F.col(f"last.{name}").alias(name) for name in ("value", *place)])


def top_per_topic(keyed, n=100):
    """The `n` largest values of each topic, with their `rank` from the largest.

    Topics are first ranked in pieces, so no task gets a whole topic, however many keys
    it has and however large `n` is.
    """
    order = [F.desc_nulls_last("value"), F.asc("key")]
    pieces = Window.partitionBy("topic", "_piece").orderBy(*order)
    keyed = (
        keyed.withColumn("_piece", F.pmod(F.xxhash64("key"), F.lit(256)))
        .withColumn("_rank", F.row_number().over(pieces))
        .where(F.col("_rank") <= n)
        .drop("_piece", "_rank")
    )
    by_topic = Window.partitionBy("topic").orderBy(*order)
    return keyed.withColumn("rank", F.row_number().over(by_topic)).where(F.col("rank") <= n)


def shown_order(ranked):
    """Smallest first within a topic, as a chart shows it."""
    return ranked.orderBy("topic", F.desc("rank"))


def share_of_topic(ranked):
    """Percentage of each key among the rows shown for its topic, to one decimal.

    Takes the few rows `top_per_topic` leaves. Rounded half up in whole tenths, so
    no binary fraction decides.
    """
    total = F.sum("value").over(Window.partitionBy("topic"))
    tenths = F.expr("(value * 2000 + _total) div nullif(_total * 2, 0)")
    return ranked.withColumn("_total", total).withColumn("share", tenths / 10).drop("_total")


def latest_rows(events, n=20, time="timestamp", tie="event_id"):
    """The newest `n` rows, newest first."""
    return events.orderBy(F.desc(time), F.desc(tie)).limit(n)

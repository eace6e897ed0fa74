"""Roll-ups. All combine on the map side, so a hot key reaches the shuffle as one
row per task."""

from pyspark.sql import functions as F


def total_by(rows, key="curr", number="n"):
    """Sum of `number` per key, as `value`."""
    return rows.groupBy(key).agg({number: "sum"}).withColumnRenamed(f"sum({number})", "value")


def _seconds(interval):
    count, unit = interval.split()
    return int(count) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]


def _rolled_up(rows, key, time, width, slide, first, again, closed_only):
    """`key, window, value` for sliding windows.

    A row is in width/slide windows. Rows are first combined per pane of one slide,
    and only the panes are copied into their windows. A stream in update or complete
    mode allows one aggregation, so there the rows are copied, and the map-side
    combine absorbs the copies; in append mode, which gives a window once it is
    closed, `closed_only` brings the panes back.
    """
    one_step = rows.isStreaming and not closed_only
    if one_step or width == slide or _seconds(width) % _seconds(slide):
        return rows.groupBy(key, F.window(time, width, slide)).agg(first.alias("value"))
    panes = rows.groupBy(key, F.window(time, slide).alias("_pane")).agg(first.alias("value"))
    return panes.groupBy(key, F.window("_pane", width, slide)).agg(again("value").alias("value"))


def windowed_count(rows, key, time, width, slide, closed_only=False):
    return _rolled_up(rows, key, time, width, slide, F.count(F.lit(1)), F.sum, closed_only)


def windowed_sum(rows, key, number, time, width, slide, closed_only=False):
    return _rolled_up(rows, key, time, width, slide, F.sum(number), F.sum, closed_only)


def with_window_seconds(windowed):
    """The window start as epoch seconds, free of the session time zone."""
    return windowed.withColumn("window_start", F.unix_seconds("window.start")).drop("window")

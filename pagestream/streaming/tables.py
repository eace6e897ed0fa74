"""Tables kept up to date by the micro-batches of a stream."""

from pyspark.sql import functions as F

from pagestream.functions import text
from pagestream.operators import ranking


class KeptTable:
    """A table each micro-batch merges into.

    `shape` turns a batch into rows of the table, `reduce(kept, rows)` brings kept (None at
    first) and new rows to the table. Batch `b` reads what batch `b - 1` wrote and writes to
    another of a few slots, so a batch that runs again finds its input unchanged and replaces
    its output, and the folder does not grow. A table belongs to one checkpoint:
    batch 0 starts it anew. `shown` is what of it a reader gets, by default all.
    """

    def __init__(self, folder, shape, reduce, slots=3, shown=None):
        self.folder, self.shape, self.reduce, self.slots, self.shown = folder, shape, reduce, slots, shown
        self.schema = None  # of the rows, once some were written, so no job looks for it in the files

    def update(self, batch, batch_id):
        """For `batch_sink`; the batch may be empty."""
        kept = self.kept(batch.sparkSession, batch_id - 1) if batch_id > 0 else None
        rows = self.reduce(kept, self.shape(batch, batch_id))
        rows.write.mode("overwrite").parquet(self.slot(self.folder, batch_id))
        self.schema = rows.schema

    def slot(self, folder, batch_id):
        """Where something derived from the table as of this batch is kept, in another folder."""
        return f"{folder}/slot={batch_id % self.slots}"

    def kept(self, spark, batch_id):
        """All rows as the batch with this number left them."""
        reader = spark.read.schema(self.schema) if self.schema else spark.read
        return reader.parquet(self.slot(self.folder, batch_id))

    def after(self, spark, batch_id):
        """The table as the batch with this number left it."""
        rows = self.kept(spark, batch_id)
        return self.shown(rows) if self.shown else rows


class RunTable:
    """A table of which each micro-batch writes only its own rows, as a run.

    Each time `base` runs of a level are there, they become one run of the next level, so a row
    is written again once per level, and a reader merges less than `base` runs of each. Which
    runs make up the table follows from the batch number alone. Runs take turns in a few slots;
    a batch that runs again finds its input unchanged and replaces its output. `shape` turns a
    batch into rows, `reduce` merges rows.
    """

    def __init__(self, folder, shape, reduce, base=8):
        self.folder, self.shape, self.reduce, self.base = folder, shape, reduce, base

    def update(self, batch, batch_id):
        """For `batch_sink`; the batch may be empty."""
        spark, base = batch.sparkSession, self.base
        self.reduce(self.shape(batch, batch_id)).write.mode("overwrite").parquet(self._run(0, batch_id))
        level, done = 0, batch_id + 1
        while done % base == 0:
            runs = [self._run(level, done - base + at) for at in range(base)]
            level, done = level + 1, done // base
            merged = self.reduce(spark.read.parquet(*runs))
            merged.write.mode("overwrite").parquet(self._run(level, done - 1))

    def slot(self, folder, batch_id):
        return f"{folder}/slot={batch_id % 3}"

    def runs(self, batch_id):
        """The folders that hold the table as of this batch."""
        level, done, found = 0, batch_id + 1, []
        while done:
            found += [self._run(level, done - 1 - at) for at in range(done % self.base)]
            level, done = level + 1, done // self.base
        return found

    def after(self, spark, batch_id):
        """The table as the batch with this number left it."""
        return self.reduce(spark.read.parquet(*self.runs(batch_id)))

    def _run(self, level, number):
        return f"{self.folder}/level={level}-run={number % (2 * self.base)}"


def _with(kept, rows):
    return rows if kept is None else kept.unionByName(rows)


def _numbers(messages, *more):
    return messages.select("topic", "key", text.leading_int(F.col("value")).alias("value"), *more)


def largest_results(folder, n=100):
    """`n` rows per topic: each key with the largest value it ever had.

    A key that was cut comes back only with a new message, and its largest value is
    then in that message, so keeping `n` rows per topic loses nothing.
    """

    def reduce(kept, rows):
        largest = _with(kept, rows).groupBy("topic", "key").agg(F.max("value").alias("value"))
        return ranking.top_per_topic(largest, n).drop("rank")

    return KeptTable(folder, lambda batch, _: _numbers(batch), reduce)


def latest_results(folder, order=("offset", "sent_at")):
    """Every key with its last value, see `ranking.last_of_key`.

    Here a value can fall and let another key rise again, so no key is cut before
    the table is read; cut it with `top_per_topic` then. A batch writes its own keys, not all.
    """

    def shape(batch, _):
        return _numbers(batch, *[name for name in order if name in batch.columns])

    return RunTable(folder, shape, lambda rows: ranking.last_of_key(rows, order))


def latest_events(folder, n=20):
    """The newest `n` events."""

    def shape(batch, _):
        return batch.select(
            F.col("e.id").alias("event_id"), "e.timestamp", "e.wiki", "e.title", "e.type"
        )

    return KeptTable(folder, shape, lambda kept, rows: ranking.latest_rows(_with(kept, rows), n))


def _window_sums(batch, batch_id):
    return batch.select(
        "key",
        F.unix_seconds("window.start").alias("window_start"),
        F.col("value").cast("bigint").alias("value"),
        F.lit(batch_id).cast("bigint").alias("version"),
    )


def _last_sums(rows):
    return rows.groupBy("key", "window_start").agg(
        F.max_by("value", "version").alias("value"), F.max("version").alias("version")
    )


def _newest(rows, column="window_start"):
    """Of a table's few rows; 0 without any."""
    return (rows.agg(F.max(column)).first()[0] or 0) if rows is not None else 0


def latest_windows(folder, k, slide_seconds):
    """Running sums of the newest `k` windows, from an update-mode windowed roll-up.

    Complete mode would hold and rewrite every window since the start; with a
    watermark, update mode lets go of old ones, and this table holds `k`, and until the next
    batch those that a batch brought beside them.
    """

    def reduce(kept, rows):
        bar = _newest(kept) - k * slide_seconds
        return _last_sums(_with(kept, rows)).where(F.col("window_start") > bar)

    def shown(rows):
        return rows.where(F.col("window_start") > _newest(rows) - k * slide_seconds)

    return KeptTable(folder, _window_sums, reduce, shown=shown)


def top_windows(folder, n, width_seconds, delay_seconds):
    """What the `n` largest (key, window) sums of all time need, from an update-mode roll-up.

    Windows that can still change stay in full, of the others only the `n` largest sums:
    these are final, so nothing that was cut can come back, whatever signs the counts have.
    Rows of the next batch are judged late by what was seen before this one. So a window is
    final once it and the delay end before the newest window of the batch before starts; of
    this batch's newest window that is not yet true. Final sums are cut one batch later.
    """

    def reduce(kept, rows):
        closed = F.col("window_start") + width_seconds + delay_seconds <= _newest(kept)
        sums = _last_sums(_with(kept.drop("final") if kept is not None else None, rows)).withColumn("final", closed)
        if kept is None:
            return sums
        # The batch is read once: what ranks below the n-th of the sums that were final before is cut.
        best = ranking.top_rows(kept.where("final"), n, "key", "window_start").collect()
        if len(best) < n:
            return sums
        value, key, start = (best[-1][c] for c in ("value", "key", "window_start"))
        place = F.struct(-F.col("value"), F.col("key"), F.col("window_start"))
        last = F.struct(F.lit(-value).cast("bigint"), F.lit(key), F.lit(start).cast("bigint"))
        return sums.where(~F.col("final") | (place <= last))

    return KeptTable(folder, _window_sums, reduce)


def top_keys(folder, n):
    """The `n` largest running sums, from an update-mode roll-up whose sums never fall.

    A key that was cut comes back only with a new, larger sum, and a batch's sums below the
    smallest kept one are dropped where they are read. Where counts may be negative a sum can
    fall, and only complete mode is exact.
    """

    def shape(batch, batch_id):
        return batch.select(
            "key", F.col("value").cast("bigint").alias("value"), F.lit(batch_id).cast("bigint").alias("version")
        )

    def reduce(kept, rows):
        if kept is not None:
            held, bar = kept.agg(F.count(F.lit(1)), F.min("value")).first()
            rows = kept.unionByName(rows.where(F.col("value") >= bar) if held == n else rows)
        sums = rows.groupBy("key").agg(F.max_by("value", "version").alias("value"), F.max("version").alias("version"))
        return ranking.top_rows(sums, n, "key")

    return KeptTable(folder, shape, reduce)


class OpenPanes(KeptTable):
    """Counts per pane of one slide, and the sliding windows made of them.

    A stream then holds and shuffles one row per pane, where copying rows into windows makes
    width / slide of them. A pane stays while a window that has it can change. Panes may be
    shorter than a slide, if they divide it; the width is a number of slides.
    """

    def __init__(self, folder, width_seconds, slide_seconds, delay_seconds):
        self.width, self.slide, self.delay = width_seconds, slide_seconds, delay_seconds

        def reduce(kept, rows):
            return _last_sums(_with(kept, rows)).where(F.col("window_start") > self._bar(kept))

        super().__init__(folder, _window_sums, reduce)

    def _bar(self, kept):
        return _newest(kept) - self.width - self.delay

    def changed_windows(self, spark, batch_id):
        """`key, window_start, value` of the windows that this batch changed and that were not closed before it."""
        last = F.col("window_start") - F.pmod("window_start", F.lit(self.slide))
        starts = F.explode(F.sequence(last - (self.width - self.slide), last, F.lit(self.slide)))
        bar = self._bar(self.kept(spark, batch_id - 1)) if batch_id else self._bar(None)
        kept = self.kept(spark, batch_id)
        changed = kept.where(F.col("version") == batch_id).select("key", starts.alias("window_start")).distinct()
        panes = kept.select("key", "value", starts.alias("window_start"))
        open_panes = panes.where(F.col("window_start") > bar)
        windows = open_panes.join(changed, ["key", "window_start"], "left_semi")
        return windows.groupBy("key", "window_start").agg(F.sum("value").alias("value"))

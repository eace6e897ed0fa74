"""Replaying dump files at a set pace."""

import re
import threading
from urllib.parse import unquote

from pyspark.sql import functions as F

from pagestream.sources.files import scan_lines
from pagestream.sources.topics import line_stream
from pagestream.streaming.runner import start
from pagestream.streaming.sinks import batch_sink


def replay_folder(spark, folder, sink, checkpoint, every="60 seconds", files_per_trigger=1,
                  drain=False):
    """Send the lines of a folder's files to a sink, the oldest first, one file per interval by default.

    With `drain`, files follow each other without a pause.
    """
    lines = line_stream(spark, folder, files_per_trigger)
    return start(lines, sink, checkpoint, every=every, drain=drain)


def literal(name):
    """A listed file as a path to read: without percent codes, nothing in it a pattern."""
    return re.sub(r"([\\*?{}\[\]])", r"\\\1", unquote(name))


class NameOrder:
    """Which files of a folder each batch takes: those not taken yet, by name.

    The folder is listed when all files known of are dealt, and all it has more are then dealt to
    the batches to come. That is written beside the checkpoint, once for all of them and before
    the first of them is sent, so a batch that runs again takes the same files, and after a
    restart those that follow. So the work per batch does not grow with the number of files.
    """

    def __init__(self, spark, folder, log, files_per_trigger=1):
        self.spark, self.folder, self.log, self.each = spark, folder, log, files_per_trigger
        self.taken = None

    def _known(self):
        if self.taken is None:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.log)
            there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
            rows = self.spark.read.text(self.log).select("value", "batch_id").collect() if there else []
            self.taken = {}
            for row in rows:
                # A name alone, as logs once had them, is of the batch that its folder is named by.
                batch, _, name = row["value"].rpartition("\t")
                self.taken.setdefault(int(batch or row["batch_id"]), []).append(name)
        return self.taken

    def names(self, batch_id):
        known = self._known()
        if batch_id not in known:
            gone = {name for names in known.values() for name in names}
            left = sorted(set(scan_lines(self.spark, self.folder).inputFiles()) - gone)
            dealt = {batch_id + at // self.each: left[at:at + self.each] for at in range(0, len(left), self.each)}
            if dealt:
                lines = [(f"{batch}\t{name}",) for batch, names in dealt.items() for name in names]
                rows = self.spark.createDataFrame(lines, "value string")
                rows.coalesce(1).write.mode("overwrite").text(f"{self.log}/batch_id={batch_id}")
                known.update(dealt)
        return sorted(known.get(batch_id, []))


def replay_by_name(spark, folder, write, checkpoint, every="60 seconds", files_per_trigger=1, drain=False):
    """Hand the lines of a folder's files, by name, to `write(lines, batch_id)`, one file per interval by default.

    A source that counts batches paces it, and its checkpoint numbers them. Files that come
    later follow when all listed before are sent. With `drain` files follow each other without a
    pause, and it ends with the last.
    """
    order, done = NameOrder(spark, folder, f"{checkpoint}/names", files_per_trigger), threading.Event()

    def handle(_, batch_id):
        names = order.names(batch_id)
        if names:
            write(spark.read.text([literal(name) for name in names]).select("value"), batch_id)
        else:
            done.set()

    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load().select(F.lit(1))
    query = start(ticks, batch_sink(handle), checkpoint, every=None if drain else every)
    if drain:
        while not done.wait(0.2) and query.isActive:
            pass
        if done.is_set():
            query.stop()
        elif query.exception():
            raise query.exception()
    return query

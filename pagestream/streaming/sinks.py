"""Sinks. Each takes a stream writer and returns it ready to start."""

from pyspark.sql import functions as F


def kafka_sink(servers, topic):
    """Writes `key` (if there is one) and `value`; select these first."""

    def apply(writer):
        return (
            writer.format("kafka")
            .option("kafka.bootstrap.servers", servers)
            .option("topic", topic)
        )

    return apply


def batch_sink(handle):
    """Calls `handle(rows, batch_id)` per micro-batch, at least once each."""
    return lambda writer: writer.foreachBatch(handle)


def batch_folder_sink(folder):
    """Each micro-batch as `batch_id=<n>`; a repeated batch replaces itself."""

    def handle(rows, batch_id):
        rows.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")

    return batch_sink(handle)


def topic_folder_sink(root, topic):
    """A result topic kept as files, see `sources.topics.file_results`."""
    return batch_folder_sink(f"{root}/topic={topic}")


def line_folder_sink(folder):
    """Lines appended as text files, exactly once through the sink's own log."""
    return lambda writer: writer.format("text").option("path", folder)


# Batch sinks.


def write_split_files(lines, folder, rows_per_file=50_000):
    """Text files of at most `rows_per_file` lines."""
    lines.write.option("maxRecordsPerFile", rows_per_file).text(folder)


def write_numbered_lines(numbered, folder, rows_per_file=50_000, most_tasks=10_000):
    """Text files of exactly `rows_per_file` lines, but for the last, that follow each other by name.

    Takes `value, line` with lines numbered from 0. A task writes one file, or of very many
    files some that follow each other.
    """
    files = -(-((numbered.agg(F.max("line")).first()[0] or 0) + 1) // rows_per_file)
    each = -(-files // most_tasks)
    task = F.floor(F.col("line") / F.lit(rows_per_file * each)).cast("int")
    ordered = numbered.repartitionById(-(-files // each), task).sortWithinPartitions("line")
    ordered.select("value").write.option("maxRecordsPerFile", rows_per_file).text(folder)


def hash_part(column, parts):
    """The folder of a value in what `write_by_hash` wrote."""
    return F.pmod(F.xxhash64(column), F.lit(parts)).cast("int")


def write_by_hash(rows, folder, column, parts):
    """Parquet in folders `part=<hash of a column>`: a reader that knows its values opens few of them."""
    placed = rows.withColumn("part", hash_part(column, parts))
    placed.repartition("part").write.mode("overwrite").partitionBy("part").parquet(folder)


def write_views(views, folder, compression="none"):
    """Raw tab-separated files, as `scan_views` reads them."""
    writer = views.write.option("sep", "\t").option("quote", "").option("emptyValue", "")
    writer.option("escape", "").option("compression", compression).csv(folder)


def write_bucketed(rows, table, column, buckets, path=None):
    """A table laid out by hash of a column, as parquet.

    A join on the column then reads it in place instead of shuffling it. That counts
    most for a table a stream joins, which is read again for every micro-batch.
    """
    writer = rows.write.mode("overwrite").bucketBy(buckets, column).sortBy(column)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


def write_indexed_csv(numbered_rows, folder, index="idx"):
    """CSV with a header whose first column, the index, has no name."""
    unnamed = numbered_rows.withColumnRenamed(index, "")
    (
        unnamed.write.option("header", True)
        .option("escape", '"')
        .option("emptyValue", "")
        .csv(folder)
    )

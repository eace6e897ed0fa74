"""Files: tab-separated dumps, and text lines with their place."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagestream import schemas
from pagestream.functions.text import strict_bigint


def scan_views(spark, path, quoted=False, on_malformed="FAILFAST"):
    """All tab-separated files of a folder as page views, no header line.

    Dump fields are raw text, so quotes mean nothing unless `quoted`. A line that
    does not fit, an empty count included, fails the job, or is dropped with
    `on_malformed="DROPMALFORMED"`.
    """
    texts = ", ".join(f"{name} string" for name in schemas.VIEW.names)
    reader = spark.read.schema(texts).option("sep", "\t").option("mode", on_malformed)
    # A line is judged by all its fields, whichever a query needs: no pruning, and the
    # filter makes even a bare count read them.
    reader = reader.option("columnPruning", False).option("quote", '"' if quoted else "")
    if quoted:
        reader = reader.option("escape", '"')
    n = strict_bigint(F.col("n"))
    fits = n.isNotNull()
    if on_malformed.upper() == "FAILFAST":
        bad = F.raise_error(F.concat(F.lit("MALFORMED count: "), F.coalesce("n", F.lit(""))))
        fits = F.when(fits, True).otherwise(bad.cast("boolean"))
    rows = reader.csv(path).where(fits)
    # The reader gives null for an empty field.
    columns = [F.coalesce(c, F.lit("")).alias(c) for c in ("prev", "curr", "link")]
    columns.append(n.alias("n"))
    return rows.select(*columns)


def scan_compressed_views(spark, path, partitions, **options):
    """A gzip dump is read by one task per file, so spread its rows for what follows."""
    return scan_views(spark, path, **options).repartition(partitions)


def scan_lines(spark, path):
    """Lines with their place: file, start of the file's block, and number in the task.

    Ordering by the three gives the line order of a file without counting lines and
    without reading the file in one task.
    """
    return spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("line_in_task"),
    )


def numbered_lines(spark, path):
    """`value, line`: lines with their number from 0, files in the order of their names.

    Splits are counted first, a row per split; what lies before each is added to a line's
    number in its split.
    """
    lines = scan_lines(spark, path)
    split = ["file", "block_start"]
    counts = lines.groupBy(*split).agg(F.count(F.lit(1)).alias("rows"), F.min("line_in_task").alias("first"))
    earlier = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("first")
    return lines.join(counts.select(*split, before.alias("shift")), split).select(
        "value", (F.col("line_in_task") + F.col("shift")).alias("line")
    )

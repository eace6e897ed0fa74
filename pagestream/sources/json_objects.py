"""JSON objects written one after another, in whatever layout, found in parallel.

Closing braces separate the records of the scan, so a large file is read in splits. Between
two objects there are only blanks: an object begins where the text after a closing brace goes
on with an opening one, unless that brace lies in a string. Whether it does depends on all
quotes before it, back to the last line break, as a JSON string holds none. Each split is
summed up for both states it may begin in; these sums, a row per split, are put together in
file order and tell each split its first state and the number of its first object.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagestream import schemas
from pagestream.session import shuffle_partitions

_BROKEN = "_broken"
_SPLIT = ["file", "block_start"]
_BYTES_EACH = 64 << 20


def _pieces(spark, path):
    """What lies before each closing brace, with its place and what it does to a string."""
    rows = spark.read.option("lineSep", "}").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.col("_metadata.file_size").alias("file_size"),
        F.monotonically_increasing_id().alias("row"),
    )
    plain = F.regexp_replace("value", r"(?s)\\.", "")  # without escapes, and so without escaped quotes
    last_line = F.substring_index(plain, "\n", -1)
    quotes = F.length(last_line) - F.length(F.replace(last_line, F.lit('"'), F.lit("")))
    return rows.select(
        "*", F.col("value").contains("\n").alias("breaks"), quotes.cast("bigint").alias("quotes"),
        F.col("value").rlike(r"\A\s*\{").alias("opens"),
    )


def _with_states(pieces):
    """For both states a split may begin in, whether each piece begins in a string.

    `after` counts quotes up to the end of a piece, `known` what to add to it, since a line
    break settled the state; before one, the split's first state is added.
    """
    so_far = Window.partitionBy(*_SPLIT).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    counted = pieces.withColumn("after", F.sum("quotes").over(so_far))
    settled = F.when(F.col("breaks"), F.col("quotes") - F.col("after"))
    counted = counted.withColumn("known", F.last(settled, ignorenulls=True).over(so_far))
    in_order = Window.partitionBy(*_SPLIT).orderBy("row")
    before = F.lag(F.col("after"), 1, 0).over(in_order)
    known_before = F.lag(F.col("known")).over(in_order)
    first = (F.col("block_start") == 0) & (F.row_number().over(in_order) == 1)
    placed = counted.select("*", before.alias("before"), known_before.alias("known_before"), first.alias("first"))

    def begins(state):
        inside = F.pmod(F.col("before") + F.coalesce("known_before", F.lit(state)), F.lit(2)) == 1
        return F.col("first") | (F.col("opens") & ~inside)

    return placed.withColumns({"begins_0": begins(0), "begins_1": begins(1)})


def _splits(states):
    """For each split its first state, the objects begun before it, and where its file ends."""
    ends = states.groupBy(*_SPLIT).agg(
        F.max_by("after", "row").alias("quotes"), F.max_by("known", "row").alias("known"),
        *[F.count_if(f"begins_{state}").alias(f"begun_{state}") for state in (0, 1)],
        F.sum(F.octet_length("value") + 1).alias("size"), F.max("row").alias("last_row"), F.max("file_size").alias("file_size"),
    )
    in_file = Window.partitionBy("file").orderBy("block_start")
    so_far = in_file.rowsBetween(Window.unboundedPreceding, 0)
    summed = ends.withColumn("after", F.sum("quotes").over(so_far))
    settled = F.col("known") + F.col("quotes") - F.col("after")
    summed = summed.withColumn("shift", F.last(settled, ignorenulls=True).over(so_far))
    state = F.pmod(F.lag("after", 1, 0).over(in_file) + F.coalesce(F.lag("shift").over(in_file), F.lit(0)), F.lit(2))
    entered = summed.withColumn("state", state)
    begun = F.when(F.col("state") == 0, F.col("begun_0")).otherwise(F.col("begun_1"))
    whole = Window.partitionBy("file")
    return entered.select(
        *_SPLIT, "state", (F.sum(begun).over(so_far) - begun).alias("earlier"),
        (F.sum("size").over(whole) - F.col("file_size")).alias("beyond"),
        (F.col("block_start") == F.max("block_start").over(whole)).alias("last_split"), "last_row",
    )


def scan_json_texts(spark, path):
    """`file, number, value`: each object's text and its number in its file, from 0.

    What is no object, and blank texts aside, counts as one too, up to where the next begins.
    """
    pieces = _pieces(spark, path)
    # Partitions follow the bytes that the splits may hold, so what a task sorts does not grow with the input.
    most = pieces.rdd.getNumPartitions() * spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    partitions = max(shuffle_partitions(spark), -(-most // _BYTES_EACH))
    states = _with_states(pieces.repartition(partitions, *_SPLIT))
    rows = states.join(_splits(states), _SPLIT)
    begins = F.when(F.col("state") == 0, F.col("begins_0")).otherwise(F.col("begins_1"))
    so_far = Window.partitionBy(*_SPLIT).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    number = F.col("earlier") + F.sum(begins.cast("bigint")).over(so_far) - 1
    # The last piece of a file has a brace behind it only if the file ends with one. Of a
    # compressed file the size does not tell, so there a blank rest has none.
    blank = ~F.col("value").rlike(r"\S")
    bare = F.col("last_split") & (F.col("row") == F.col("last_row")) & ((F.col("beyond") == 1) | (F.col("beyond") > 1) & blank)
    text = F.when(bare, F.col("value")).otherwise(F.concat("value", F.lit("}")))
    placed_pieces = rows.select("file", number.alias("number"), "block_start", "row", text.alias("text"))
    placed = F.array_sort(F.collect_list(F.struct("block_start", "row", "text")))
    objects = placed_pieces.repartition(partitions, "file", "number").groupBy("file", "number").agg(placed.alias("parts"))
    value = F.array_join(F.transform("parts", lambda part: part["text"]), "")
    return objects.select("file", "number", value.alias("value")).where(F.col("value").rlike(r"\S"))


def _judged(spark, path, schema):
    """Every text with its record `e` and whether it is broken.

    A broken text may hold more than one object, as one that was cut off runs on into the
    next: there an opening brace in the first column of a line is taken for a new object.
    """
    wide = T.StructType([*schema.fields, T.StructField(_BROKEN, T.StringType())])

    def record(text):
        return F.from_json(text, wide, {"columnNameOfCorruptRecord": _BROKEN})

    def judged(text, e):
        return F.struct(text.alias("value"), e.alias("e"))

    texts = scan_json_texts(spark, path).withColumn("e", F.explode(F.array(record("value"))))
    broken = F.coalesce(F.col(f"e.{_BROKEN}").isNotNull(), F.lit(True))
    parts = F.filter(F.split("value", r"\r?\n(?=\{)"), lambda part: part.rlike(r"\S"))
    again = F.transform(parts, lambda part: judged(part, record(part)))
    one = F.array(judged(F.col("value"), F.col("e")))
    rows = texts.select("file", "number", F.inline(F.when(broken, again).otherwise(one)))
    return rows.withColumn("broken", F.coalesce(F.col(f"e.{_BROKEN}").isNotNull(), F.lit(True)))


def scan_json_objects(spark, path, schema=schemas.CHANGE_EVENT):
    """The objects of all files as column `e`, side by side, indented or one per line.

    An object that is broken, or has no type, gives no row; `broken_json_objects` has the
    broken ones.
    """
    rows = _judged(spark, path, schema).where(~F.col("broken"))
    rows = rows.select(F.struct(*[F.col(f"e.`{name}`") for name in schema.names]).alias("e"))
    return rows.where(F.col("e.type").isNotNull()) if "type" in schema.names else rows


def broken_json_objects(spark, path, schema=schemas.CHANGE_EVENT):
    """`file, number, value` of what is no JSON object."""
    return _judged(spark, path, schema).where("broken").select("file", "number", "value")
